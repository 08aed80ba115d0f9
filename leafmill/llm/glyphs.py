"""Character tables: decompositions, combining classes, look-alike letters, invisible marks.

The Unicode tables come from ``unicodedata`` by rule; only the look-alike pairs and the
apostrophe-like signs are fixed lists.
"""

from __future__ import annotations

import unicodedata
from functools import cache

# Cyrillic letters and the Latin letters of the same shape, position by position.
CYRILLIC_LOOKALIKES = "аеорсухѕіјһԁԛԝАВЕКМНОРСТХУЅІЈԚԜ"
LATIN_LOOKALIKES = "aeopcyxsijhdqwABEKMHOPCTXYSIJQW"
# Letters of other scripts and phonetic signs, and the Latin letters of the same shape.
OTHER_LOOKALIKES = {
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj"),
    "Cyrillic": ("ӀӏҮүԍᴦ", "IlYyGr"),
    "Latin": ("ɑɡᴄᴏᴠᴡᴢꜱ", "agcovwzs"),
    "Armenian": ("ՕօսհոԼ", "OouhnL"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
}
# Signs set as an apostrophe.
APOSTROPHES = "'‘’‛`´ʼʻʽˈʹ′＇｀"
TURNED_COMMA, TUTUQ = "ʻ", "ʼ"

TO_LATIN = dict(zip(CYRILLIC_LOOKALIKES, LATIN_LOOKALIKES)) | {a: b for other, latin in OTHER_LOOKALIKES.values() for a, b in zip(other, latin)}
TO_CYRILLIC = dict(zip(LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES))

#: The planes that hold letters, the supplement of ideographs, and the tags and selectors; the rest of the code space has no mapping.
_ASSIGNED = (range(0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200))
_HANGUL = range(0xAC00, 0xD7A4)
_SURROGATES = range(0xD800, 0xE000)
# Signs that print nothing besides format characters and variation selectors; signs that print a blank.
_NOTHING = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
_BLANKS = "\t\n\r\x0b\x0c\x85\u2800"


def _code_points():
    for block in _ASSIGNED:
        for cp in block:
            if cp not in _SURROGATES:
                yield cp


@cache
def _parts(ch: str) -> str | None:
    """What ``ch`` becomes: '' for a mark that prints nothing, ' ' for a blank, its full decomposition, or None."""
    kind = unicodedata.category(ch)
    if ch in APOSTROPHES:
        return TUTUQ
    if kind == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0000 <= ord(ch) < 0xE0200 or ch in _NOTHING:
        return ""
    if kind in ("Zs", "Zl", "Zp") or ch in _BLANKS:
        return " "
    if not unicodedata.decomposition(ch) or ch == "№":
        return None
    out = unicodedata.normalize("NFKD", ch)
    return None if out[0] == " " and len(out) > 1 else out


@cache
def decompositions() -> tuple[tuple[str, str], ...]:
    """(character, parts) of every code point that does not stay as it is; bounded by Unicode. Syllables of Hangul stay: they are what their letters compose to."""
    found = []
    for cp in _code_points():
        parts = None if cp in _HANGUL else _parts(chr(cp))
        if parts is not None and parts != chr(cp):
            found.append((chr(cp), parts))
    return tuple(found)


@cache
def combining_classes() -> dict[str, int]:
    return {chr(c): k for c in _code_points() if (k := unicodedata.combining(chr(c)))}


@cache
def compositions() -> dict[str, str]:
    """A starter and the one mark after it as one character, by their pair, for every such pair that composes; bounded by Unicode."""
    found = {}
    for cp in _code_points():
        d = unicodedata.decomposition(chr(cp)) if cp not in _HANGUL else ""
        if d and not d.startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in d.split())
            if len(pair) == 2 and unicodedata.normalize("NFC", pair) == chr(cp):
                found[pair] = chr(cp)
    return found


def plain(s: str) -> str:
    """One string's print form, folded to Latin shapes; the same rules as the operator, for vocabularies within a task."""
    if s.isascii() and "'" not in s and "`" not in s:
        return s
    out: list[str] = []
    for ch in s:
        parts = _parts(ch)
        for c in ch if parts is None else parts:
            if c == TUTUQ and out and out[-1] in "oOgG":
                c = TURNED_COMMA
            out.append(TO_LATIN.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


def script_form(s: str) -> str:
    """``s`` in print form with each run of letters in one script: Cyrillic where its unambiguous letters are mostly so."""
    folded = plain(s)
    if folded.isascii():
        return folded
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        cyr = sum(1 for c in run if "Ѐ" <= c <= "ԯ")
        lat = sum(1 for c in run if c.isalpha() and c not in TO_CYRILLIC and not "Ѐ" <= c <= "ԯ" and unicodedata.normalize("NFD", c)[0] not in TO_CYRILLIC)
        if cyr > lat:
            out.append(unicodedata.normalize("NFC", "".join(TO_CYRILLIC.get(c, c) for c in unicodedata.normalize("NFD", "".join(run)))))
        else:
            out.extend(run)
        run.clear()

    for c in folded:
        if c.isalpha() or unicodedata.combining(c) or c in (TURNED_COMMA, TUTUQ):
            run.append(c)
        else:
            flush()
            out.append(c)
    flush()
    return "".join(out)
