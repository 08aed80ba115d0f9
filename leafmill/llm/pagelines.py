"""Printed lines of recognised pages, with their kind and their template paths.

One pass over ``ocr_page``: words with one ``b`` make a line. The line table is the common
input of the operators for repeated lines, page quality and repair.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import glyphs
from leafmill.llm.ragged import coded, flat, rows, slices

LINES = "project string, pos int, b int, ln int, nl int, w0 int, nw int, letters int, kind string, symbols int, chars int, ended boolean, common int, tokens int, key string, path long, front long, back long, first string, last string, edge boolean"
_ARROW = pa.schema([
    ("project", pa.string()), ("pos", pa.int32()), ("b", pa.int32()), ("ln", pa.int32()), ("nl", pa.int32()), ("w0", pa.int32()), ("nw", pa.int32()), ("letters", pa.int32()), ("kind", pa.string()), ("symbols", pa.int32()),
    ("chars", pa.int32()), ("ended", pa.bool_()), ("common", pa.int32()), ("tokens", pa.int32()), ("key", pa.string()), ("path", pa.int64()), ("front", pa.int64()), ("back", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("edge", pa.bool_()),
])

# Letters and signs that a digit is misread as.
DIGIT_FOR = dict(zip("IlıiƖ|!ОоOoQSsZzBgqbзЗчтГ", "1111111000005522899633477"))
_NUMBER = re.compile(r"^[\d]+$")
_CELL = regex.compile(r"^\(?[\d][\d.,:/%°]*\)?$|^[—–-]$")
_ENUM = regex.compile(r"^\(?(\d{1,3}|\p{L})[.)]$|^[•*–·▪◦●○■□‣-]$")
_LEADER = regex.compile(r"(\.{4,}|(\. ){3,}|…{2,}|·{4,}|_{4,})[ .]*(\d+|[ivxlc]+)?$")
_INDEXED = regex.compile(r"^[^,;]{1,40}[,;] .*\p{L}.*?[ ,]\d+(–\d+)?(, ?\d+(–\d+)?)+\.?$")
_READABLE = regex.compile(r"^[«\"“„'(\[—-]{0,2}(\p{Lu}?[\p{Ll}--[ı]][\p{Ll}ʻʼ'’-]+|\p{Lu}[\p{Lu}ʻʼ'’-]+)([^\p{L}].*)?$", regex.V1)
_LETTERS = regex.compile(r"[^\p{L}]+|[ʻʼ]+")
_EDGES = regex.compile(r"^[^\p{L}\p{N}|!]+|[^\p{L}\p{N}|!]+$")
_LIMIT = 400_000
_RUN = 4
#: Measures of a word that are summed over a line.
_MEASURES = 9
#: More digits than the position of a page has, and more letters than a Roman numeral of a position below a million.
_DIGITS, _NUMERAL = 19, 1015
#: A line of one word meets its fellows by so many letters at either end.
_ENDS = 6
#: Half of the range of a hash, which takes it to a signed number.
_HALF = 1 << 63
_digest = xxhash.xxh64_intdigest
_HYPHENS = "-‐‑¬\u00ad"
#: Lines after a hyphen, and at a page's top, of which the first word is kept; pages with so many repeated lines or page numbers are read once more.
REACH = 6
_NOTHING = "\u200b\u200c\u200d\u2060\ufeff"
_STOPS = frozenset(".!?…,;:-‐¬­")
#: Small letters whose capitals have one shape, so that a key is the same in either case.
_CASELESS = str.maketrans({c.lower(): l.lower() for c, l in glyphs.TO_LATIN.items()})


@lru_cache(4096)
def roman(n: int) -> str:
    """``n`` in small Roman numerals; thousands are written out, zero and less are ''."""
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def as_number(core: str) -> int | None:
    """The number that ``core`` shows in digits, also misread ones."""
    digits = "".join(c if c.isdecimal() and c.isascii() else DIGIT_FOR.get(c, "?") for c in core)
    return int(digits) if 0 < len(digits) <= _DIGITS and digits.isascii() and digits.isdecimal() else None


def shows_page(tokens: list[str], pos: int) -> bool:
    """Whether a line's words (in print form) show only the number of page ``pos``, in any style, also misread."""
    if not 0 < len(tokens) <= 4:
        return False
    cores = [c for t in tokens for c in _EDGES.sub("", t).split("-") if c]
    labels = 0
    number = False
    for c in cores:
        if not number and (as_number(c) == pos + 1 or (roman_core(c) == roman(pos + 1))):
            number = True
        elif regex.fullmatch(r"\p{L}{1,6}", c):
            labels += 1
        elif c not in ("|", "!"):
            return False
    return number and labels <= 1


def roman_core(core: str) -> str | None:
    """``core`` in small Roman numerals if it can be read so; 1 or | may stand for i, and letters of another script for theirs."""
    got = core.lower().translate(_ROMAN_FOR) if len(core) <= _NUMERAL else ""
    return got if got and not got.strip("ivxlcdm") else None


_ROMAN_FOR = str.maketrans({"1": "i", "|": "i", "!": "i", "ı": "i", "х": "x", "с": "c", "і": "i", "у": "v", "y": "v"})


_MARKS = re.compile("[̀-ͯ]")
_ACCENTED = re.compile("[à-žș-ỿйёўѝї̀-ͯ]")
_VOWELS = re.compile("[aeiouyаеёиоуўыэюяıъь]")
_LATIN = re.compile("[" + "".join(c for c in map(chr, range(65, 123)) if c.isalpha() and c not in glyphs.TO_CYRILLIC) + "]")
_CYRILLIC = re.compile("[Ѐ-ԯ]")
_HARSH = re.compile("[^aeiouyаеёиоуўыэюяıъь]{5,}")


def pronounceable(form: str, key: str) -> bool:
    """Whether a word is of one script and has vowels between its consonants: random letters mostly have not."""
    return not (not form.isascii() and _CYRILLIC.search(form) and _LATIN.search(form)) and len(_VOWELS.findall(key)) * 6 >= len(key) and not _HARSH.search(key)


class Words:
    """What is needed of a word, kept by spelling; bounded."""

    def __init__(self, common: frozenset[str] = frozenset()) -> None:
        self.known: dict[str, tuple] = {}
        self.common = common

    def __call__(self, t: str) -> tuple:
        """(print form, key without digits and signs, letters, is a number cell, is readable, symbols, form without edge signs, length, number shown, Roman numeral shown, is a common word, the bytes of all measures that are summed over a line, may show a number)."""
        got = self.known.get(t)
        if got is None:
            if len(self.known) >= _LIMIT:
                self.known.clear()
            form = glyphs.plain(t)
            lowered = form.lower()
            if not lowered.isascii():
                lowered = (_MARKS.sub("", unicodedata.normalize("NFD", lowered)) if _ACCENTED.search(lowered) else lowered).translate(_CASELESS)
            marks = form.count(glyphs.TURNED_COMMA) + form.count(glyphs.TUTUQ)
            if form.isalpha():
                core, key, letters, symbols, cell = form, lowered, len(form) - marks, 0, False
            else:
                core = _EDGES.sub("", form)
                key = _LETTERS.sub("", lowered) or ("#" if core else "")
                letters = sum(map(str.isalpha, form)) - marks
                symbols = sum(not c.isalnum() and c not in "ʻʼ.,-!?…" for c in form)
                cell = bool(_CELL.match(form))
            if marks:
                key = _LETTERS.sub("", key)
            short = len(core) <= 3 or not core.isalpha()
            got = (form, key, letters, cell, letters >= 3 and bool(_READABLE.match(form)) and pronounceable(form, key), symbols, core, len(form), as_number(core) if short else None, roman_core(core), key in self.common)
            blank = not form or form in "|¦"
            numeric = got[8] is not None or got[9] is not None or not core.isalpha()
            measures = np.array((letters, symbols, len(form), cell, got[4], key in self.common, blank, letters >= 3, numeric), np.int32)
            got = self.known[t] = (*got, measures.tobytes(), numeric)
        return got


def kind_of(seen: list[tuple], pos: int) -> str:
    """``page``, ``table``, ``list``, ``junk`` or ``prose``: what a line is, by its words alone."""
    return _kind(seen, _sums(seen), pos)


def _sums(seen: list[tuple]) -> list[int]:
    """Letters, symbols, characters, cells, readable words, common words, blank words, words of three letters and words that may show a number of a line."""
    return _measures(seen).sum(0, np.int64).tolist()


def _measures(seen: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join([w[11] for w in seen]), np.int32).reshape(-1, _MEASURES)


def _kind(seen: list[tuple], sums: list[int], pos: int) -> str:
    letters, _, chars, cells, readable, _, blank, wordlike, numeric = sums
    n = len(seen) - blank
    if not n:
        return "junk"
    if n <= 4 and numeric and shows_page([w[0] for w in seen], pos):
        return "page"
    first, last = seen[0][0], seen[-1][0]
    if readable and n > 1:
        if len(first) <= 5 and (len(first) < 2 or first[-1] in ".)\n") and _ENUM.match(first):
            return "list"
        end = last[-1:]
        if end == "." and not cells and last[-2:-1].isalnum():
            pass  # the end of a sentence, no leader
        elif end.isdecimal() or end in ".…_·" or (cells and end.isalnum()):
            text = " ".join([w[0] for w in seen])
            if ("..." in text or "…" in text or ". . ." in text or "__" in text) and _LEADER.search(text):
                return "list"
            if cells and last[:1].isdecimal() and _INDEXED.match(text):
                return "list"
    if cells >= 2 and 2 * cells >= n and seen[-1][3]:
        return "table"
    if cells < n and 3 * readable < n - cells:
        if readable == 0 and (letters < 0.75 * chars or chars <= 3):
            return "junk"
        if n >= 3 and (letters < 0.6 * chars or 3 * readable < wordlike):
            return "junk"
    return "prose"


def key_tokens(seen: list[tuple], pos: int) -> list[str]:
    """The words of a line's template: without punctuation, the digits of a number as #, without an added page number at either end."""
    a, b = 0, len(seen)
    while a < b and _added(seen[a], pos):
        a += 1
    while b > a and _added(seen[b - 1], pos):
        b -= 1
    return [w[1] for w in seen[a:b] if w[1]]


def phrases(kinds: list[str], firsts: list[str], texts: list[list[tuple]]) -> None:
    """Turn ``prose`` lines that are unmarked list entries to ``list``: at least ``_RUN`` in a row, each a separate phrase.

    A phrase begins with a capital or a digit, holds no sentence punctuation and is not continued in small letters by the next line.
    """
    run: list[int] = []
    for i, kind in enumerate([*kinds, ""]):
        if kind == "prose" and len(texts[i]) <= 9 and not firsts[i].islower() and firsts[i].isalnum() and not (i + 1 < len(kinds) and firsts[i + 1].islower()) and not any(w[0][-1:] in _STOPS for w in texts[i]):
            run.append(i)
        elif kind != "page":
            if len(run) >= _RUN:
                for j in run:
                    kinds[j] = "list"
            run = []


def _added(word: tuple, pos: int) -> bool:
    return not word[6] or word[8] == pos + 1 or word[6].strip("|!").isdecimal() or (word[9] is not None and word[9] == roman(pos + 1))


def template_paths(project: str | None, tokens: list[str], key: str | None = None) -> tuple[int, int, int]:
    """Hashes of the template and of its two leaves: of either half of its words, or of either end of its one word; ``key`` are its words joined by blanks."""
    if key is None:
        key = " ".join(tokens)
    stem = f"{project} {len(tokens)} "
    if len(tokens) == 1:
        front, back = key[:_ENDS], key[-_ENDS:]
    else:
        half = len(" ".join(tokens[: (len(tokens) + 1) // 2]))
        front, back = key[:half], key[half + 1 :]
    return _digest(stem + key) - _HALF, _digest(f"{stem}front {front}") - _HALF, _digest(f"{stem}back {back}") - _HALF


def block_lines(texts: list[str | None]) -> list[tuple[int, str]]:
    """(block, line) of every printed line of a page's block texts that is not blank, in order."""
    return [(k, line) for k, text in enumerate(texts) for line in (text or "").split("\n") if line.strip()]


def wordless() -> Column:
    """Whether a page has no words, so that its block texts stand in."""
    return F.coalesce(F.size("words"), F.lit(0)) <= 0


def block_texts() -> Column:
    """The text of each block of a page."""
    return F.transform("blocks", lambda k: F.concat_ws("", F.transform(F.coalesce(k["spans"], F.array()), lambda s: s["text"])))


_WORDS: dict[frozenset[str], Words] = {}


def _objects(items: list) -> np.ndarray:
    return np.fromiter(items, object, len(items))


def _cut(b: np.ndarray, spans: list[tuple[int, int]], codes: np.ndarray, measures: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Where lines begin among the words of pages at ``spans``, of which ``b`` has the lines and ``codes`` the rows of ``measures``; and the sums over each line."""
    if not len(codes):
        return np.array([], np.int64), []
    new = np.ones(len(codes), bool)
    new[1:] = b[1:] != b[:-1]
    new[[a for a, z in spans if a < z]] = True
    begins = np.flatnonzero(new)
    return begins, np.add.reduceat(measures[codes], begins, 0, np.int64).tolist()


SPELLED = "spelled array<struct<t:string,n:bigint,lo:bigint,hi:bigint>>"
_SPELLED = pa.list_(pa.struct([("t", pa.string()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))


def _counted(spellings: list[str | None], codes: np.ndarray, spans: list[tuple[int, int]], pages: list[int], rows: int) -> pa.Array:
    """One column of ``rows`` rows of which the first holds all spellings with their count and the least and greatest of ``pages``, of which each has a span."""
    lo, hi = np.full(len(spellings), _HALF - 1), np.full(len(spellings), -_HALF)
    of = np.repeat(np.array(pages, np.int64), [z - a for a, z in spans])
    np.minimum.at(lo, codes, of)
    np.maximum.at(hi, codes, of)
    made = pa.StructArray.from_arrays([pa.array(spellings, pa.string()), pa.array(np.bincount(codes, minlength=len(spellings)), pa.int64()), pa.array(lo), pa.array(hi)], fields=list(_SPELLED.value_type))
    none = np.arange(1, rows + 1) > 1
    return pa.ListArray.from_arrays(pa.array(np.array([0, *[len(spellings)] * rows]), pa.int32()), made, _SPELLED, mask=pa.array(none))


def _lines(common: frozenset[str], reach: int, spelled: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _WORDS.setdefault(common, Words(common))  # kept from task to task of a worker
    known = words.known
    for batch in slices(batches, 3000):
        out: list[tuple] = []
        gc.disable()  # until the slice is given: its many small objects hang together in no cycle
        # the spellings of a slice are looked up once, and the lines of all its pages cut and summed together
        spellings, codes, spans = coded(batch.column("t"))
        found = [known.get(t) or words(t or "") for t in spellings]
        b = flat(batch.column("b"))[0]
        begins, summed = _cut(np.array(b), spans, codes, _measures(found))
        bounds = [*begins.tolist(), len(codes)]
        lines_to = np.searchsorted(begins, [z for _, z in spans]).tolist()
        all_words, all_keys = _objects(found)[codes].tolist(), _objects([w[1] for w in found])[codes].tolist()
        shown = _objects(spellings)
        heads, tails = shown[codes[bounds[:-1]]].tolist(), shown[codes[[z - 1 for z in bounds[1:]]]].tolist()
        to = 0
        for (project, pos, texts), until in zip(rows(batch, ("texts",), ("project", "pos")), lines_to):
            at = -9 if pos is None else pos
            since, to = to, until
            if texts:
                whole = [line.split() for _, line in block_lines(texts)]
                seens = [[known.get(t) or words(t) for t in line] for line in whole]
                sums, keys = [_sums(seen) for seen in seens], None
                edges = [(-1 - k, -1, line[0], line[-1]) for k, line in enumerate(whole)]
            else:
                own = bounds[since : to + 1]
                seens = [all_words[i:j] for i, j in zip(own, own[1:])]
                sums, keys = summed[since:to], [all_keys[i:j] for i, j in zip(own, own[1:])]
                edges = [(b[i], i - own[0], first, last) for i, first, last in zip(own, heads[since:to], tails[since:to])]
            n = len(seens)
            kinds = [_kind(seen, c, at) for seen, c in zip(seens, sums)]
            phrases(kinds, [seen[0][6][:1] or "." for seen in seens], seens)
            hyphened = -reach
            for ln, (seen, c, (b_of, w0, first, last)) in enumerate(zip(seens, sums, edges)):
                # words that show no number are no added page number
                tokens = key_tokens(seen, at) if keys is None or seen[0][12] or seen[-1][12] else list(filter(None, keys[ln]))
                end = seen[-1][0][-1:]
                letters = c[0]
                if not letters:
                    tokens = ()
                key = " ".join(tokens)
                paths = template_paths(project, tokens, key) if tokens else (0, 0, 0)
                if not last or (last[-1] not in _HYPHENS and last.rstrip(_NOTHING)[-1:] not in _HYPHENS):
                    last = None
                near = ln < reach or ln - hyphened <= reach or last is not None
                if last is not None:
                    hyphened = ln
                out.append((
                    project, pos, b_of, ln, n, w0, len(seen), letters, kinds[ln], c[1], c[2], end in ".!?…»\"”:;", c[5], len(tokens), key,
                    *paths, first if near else None, last, near,
                ))
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)] if out else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)
        if spelled:
            projects, places = (batch.column(c).to_pylist() for c in ("project", "pos"))
            pages = [_digest(f"{project!r} {pos}") - _HALF for project, pos in zip(projects, places)]
            column = _counted(spellings, codes, spans, pages, len(out)) if out else pa.array([], _SPELLED)
            made = pa.RecordBatch.from_arrays([*made.columns, column], schema=_ARROW.append(pa.field("spelled", _SPELLED)))
        del out
        gc.enable()
        yield made


def page_lines(pages: DataFrame, common_words: frozenset[str] = frozenset(), reach: int = REACH, spelled: bool = False) -> DataFrame:
    """One row per printed line: its place, its kind, its measures, its template key and the paths to its three leaves.

    ``common`` counts words whose key is among ``common_words``; ``last`` is the last word where it ends in a hyphen; ``edge``
    marks these lines, the ``reach`` after them and the first ones of a page, which alone have ``first``, their first word. Where
    ``words`` is null or empty the lines of the block texts stand in, with ``b`` below 0 and ``w0`` -1; null texts
    count as ''; rows repeated in ``pages`` are repeated here; a page without any text gives no line. With ``spelled`` some lines hold, for
    all pages read with theirs, the spellings of ``words``: how often each stands there, and the least and greatest hash of a page with it.
    """
    return pages.select("project", "pos", pages["words"]["t"].alias("t"), pages["words"]["b"].alias("b"), F.when(wordless(), block_texts()).alias("texts")).mapInArrow(partial(_lines, common_words, reach, spelled), f"{LINES}, {SPELLED}" if spelled else LINES)


def common_keys(common_words: DataFrame) -> frozenset[str]:
    """Keys of the frequent small words of a table that does not grow; more than 100,000 words are refused."""
    words = Words()
    found = [r["word"] for r in common_words.where("word is not null").select("word").distinct().limit(100_001).collect()]
    if len(found) > 100_000:
        raise ValueError("common_words is meant to be a short list")
    return frozenset(words(w)[1] for w in found)
