"""Scalar text functions as Columns; inventory ids in the docstrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of one shape in the two scripts, position by position.
LATIN_TWINS = "aceopxyABCEHKMOPTX"
CYRILLIC_TWINS = "асеорхуАВСЕНКМОРТХ"
# Frequent words of the language test.
UZBEK_WORDS = (
    "va", "bilan", "uchun", "bu", "ham", "edi", "bir", "deb", "emas", "lekin", "kabi", "esa", "bo'lib", "boʻlib", "o'z", "oʻz", "yoki", "har", "biz", "siz",
    "u", "endi", "keyin", "juda", "qilib", "bo'lgan", "boʻlgan", "hamda", "ular", "uning", "shu", "nima", "qanday", "men",
)
ENGLISH_WORDS = (
    "the", "and", "of", "to", "is", "in", "that", "it", "was", "for", "with", "as", "on", "he", "she", "you", "this", "be", "are", "at", "by", "from", "his", "her", "they", "which", "have",
)
# Words of one letter that are not noise.
SINGLE_WORDS = ("u", "U", "o", "a", "A", "и", "И", "в", "В", "с", "С", "к", "К", "о", "О", "у", "У", "я", "Я", "а", "А", "—", "–", "-")
# Patterns of page numbers and of chapter heads.
PAGE_NUMBER = r"^[\s\-–—.·•(\[]*(\d{1,4}|[IVXLCDM]{1,7}|[ivxlcdm]{1,7})[\s\-–—.·•)\]]*$"
CHAPTER = r"(?iu)^(bob|qism|bo[ʻ'‘’`]?lim|fasl|глава|часть|раздел|бо[бў]|қисм|бўлим|фасл|chapter|part|section)\b.*"
# Fixed value: white space of a web page, no-break and wide blanks included.
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
HYPHENS = "-‐‑¬­"



def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def key(text: Column) -> Column:
    """small letters only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]", "")


def fold_script(word: Column, prefer_cyrillic: bool = False) -> Column:
    """a word of mixed script in the script of most of its letters, if all other letters have a twin; ties by ``prefer_cyrillic``."""
    cyrillic, latin = _count(word, "[\\u0400-\\u04FF]"), _count(word, "[A-Za-z]")
    to_cyrillic = (cyrillic > latin) | ((cyrillic == latin) & F.lit(prefer_cyrillic))
    return (
        F.when((cyrillic == 0) | (latin == 0), word)
        .when(to_cyrillic & (_count(word, f"[{LATIN_TWINS}]") == latin), F.translate(word, LATIN_TWINS, CYRILLIC_TWINS))
        .when(~to_cyrillic & (_count(word, f"[{CYRILLIC_TWINS}]") == cyrillic), F.translate(word, CYRILLIC_TWINS, LATIN_TWINS))
        .otherwise(word)
    )


def zero_to_letter(word: Column) -> Column:
    """a zero beside a letter becomes an o of the word's script, from left to right, in words of mostly letters.

    The character before is the one already repaired, so the fold runs over the characters.
    """
    letters = _count(word, r"\p{L}")
    fits = (F.length(word) >= 3) & word.contains("0") & (letters >= 2) & (letters >= F.length(word) - 2)
    cyrillic = _count(word, "[\\u0400-\\u04FF]") >= _count(word, "[A-Za-z]")
    chars = F.split(word, "")
    letter = lambda c: F.coalesce(c.rlike(r"^\p{L}$"), F.lit(False))
    upper = lambda c: F.coalesce(c.rlike(r"^\p{Lu}$"), F.lit(False))

    def step(done: Column, at: Column) -> Column:
        here, after = F.get(chars, at), F.get(chars, at + 1)
        before = F.right(done, F.lit(1))
        capital = upper(before) & (after.isNull() | upper(after))
        o = F.when(cyrillic, F.when(capital, "О").otherwise("о")).otherwise(F.when(capital, "O").otherwise("o"))
        return F.concat(done, F.when((here == "0") & (letter(before) | letter(after)), o).otherwise(here))

    return F.when(fits, F.aggregate(F.sequence(F.lit(0), F.length(word) - 1), F.lit(""), step)).otherwise(word)


def uzbek_apostrophe(word: Column) -> Column:
    """any apostrophe after o or g as ʻ, runs of them as one."""
    return F.regexp_replace(F.regexp_replace(word, "([oOgG])['‘’`ʼ´]", "$1ʻ"), "ʻ['‘’`ʼ´ʻ\"“]+", "ʻ")


def fix_word(word: Column, prefer_cyrillic: bool = False, uzbek_latin: bool = False) -> Column:
    """F26, F27 and F28 one after the other."""
    out = zero_to_letter(fold_script(word, prefer_cyrillic))
    return uzbek_apostrophe(out) if uzbek_latin else out


def is_noise(text: Column, confidence: Column) -> Column:
    """recognised marks that are no text, by six rules in order."""
    t = F.trim(text)
    n, alnum = F.length(t), _count(t, r"[\p{L}\p{N}]")
    return (
        F.when(n == 0, True)
        .when(alnum == 0, ((confidence < 40) & (n > 2)) | t.rlike(r"^[|_~^=<>\\/*#@]+$"))
        .when((confidence < 45) & (n <= 2) & ~t.rlike(r"\p{N}"), True)
        .when((n == 1) & (confidence < 75) & ~t.isin(*SINGLE_WORDS) & ~t.rlike(r"\p{N}"), True)
        .when((confidence < 25) & (n <= 4), True)
        .when((confidence < 40) & (alnum / n < 0.5), True)
        .otherwise(False)
    )


def is_stray_script(text: Column, confidence: Column, cyrillic_book: bool) -> Column:
    """a word wholly in the other script, unless it is long and confident."""
    cyrillic, latin = _count(text, "[\\u0400-\\u04FF]"), _count(text, "[A-Za-z]")
    foreign, native = (latin, cyrillic) if cyrillic_book else (cyrillic, latin)
    return (foreign > 0) & (native == 0) & ((confidence < 75) | (foreign <= 2))


def detect_language(text: Column) -> Column:
    """a label such as ``uzb+eng`` from letters, frequent words and affixes; null below 60 letters."""
    cyrillic, latin = _count(text, "[\\u0400-\\u04FF]"), _count(text, "[A-Za-z]")
    uzbek, russian = _count(text, "[ўқғҳЎҚҒҲ]"), _count(text, "[щыЩЫ]")
    words = F.filter(F.split(F.lower(text), r"[^\p{L}'ʻʼ‘’]+"), lambda w: w != "")
    one = lambda c: F.when(c, 1).otherwise(0)
    score = lambda f: F.aggregate(words, F.lit(0), lambda a, w: a + f(w))
    uz = score(lambda w: one(w.isin(*UZBEK_WORDS)) + one(w.rlike("[og]['ʻ‘]")) + one(w.startswith("sh") | w.startswith("ch") | w.endswith("lar") | w.endswith("ning")))
    en = score(lambda w: one(w.isin(*ENGLISH_WORDS)) + one((w.endswith("ing") & ~w.endswith("ning")) | w.endswith("tion") | w.startswith("th")))
    return (
        F.when(cyrillic + latin < 60, None)
        .when(cyrillic > latin, F.when((uzbek >= 3) & (uzbek / cyrillic > 0.004) & (uzbek > russian), "uzb_cyrl+rus").otherwise("rus+eng"))
        .otherwise(F.when(uz >= en, "uzb+eng").otherwise("eng"))
    )


def is_page_number(line: Column) -> Column:
    """F32."""
    return F.trim(line).rlike(PAGE_NUMBER)


def is_chapter(line: Column) -> Column:
    """F33."""
    return line.rlike(CHAPTER)


def _end(text: Column) -> Column:
    """Without white space at the end, line breaks included."""
    return F.regexp_replace(text, r"\s+$", "")


def ends_terminal(text: Column) -> Column:
    """a sentence ends here, also within closing quotes."""
    return _end(text).rlike(r"[.!?…]$|[.!?…][»\"”)'’]$")


def ends_clause(text: Column) -> Column:
    """F34."""
    return ends_terminal(text) | _end(text).rlike(r"[:»\"”]$")


def starts_lower(text: Column) -> Column:
    """the first letter is a small one."""
    return F.regexp_extract(text, r"^[^\p{L}]*(\p{L})", 1).rlike(r"^\p{Ll}$")


def dehyphenate(text: Column) -> Column:
    """F35, first case: a letter, a hyphen, a line break and a small letter are joined."""
    return F.regexp_replace(text, r"(\p{L})[-‐‑¬­][ \t]*\n\s*(\p{Ll})", "$1$2")


def plain_text(blocks: Column) -> Column:
    """K1: texts of all blocks but images, joined by blank lines."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] != "IMAGE"), lambda b: F.concat_ws("", F.transform(b["spans"], lambda s: s["text"])))
    return F.array_join(texts, "\n\n")


# What is taken out of foreign markup, in this order, and what stands in its place; closing tags left alone and addresses without quotes go too.
SANITISED = (
    (r"(?is)<script\b.*?</script\s*>", ""),
    (r"(?is)<(iframe|object|embed|frameset|frame|applet|form)\b.*?(</\1\s*>|/?>)", ""),
    (r"(?is)</?(script|iframe|object|embed|frameset|frame|applet|form|meta|base|link)\b[^>]*>", ""),
    (r"(?i)\son[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", ""),
    (r"(?i)(href|src|xlink:href)\s*=\s*([\"'])\s*(javascript|vbscript|data:text/html)[^\"']*\2", '$1="#"'),
    (r"(?i)(href|src|xlink:href)\s*=\s*(javascript|vbscript|data:text/html)[^\s>]*", '$1="#"'),
)


def sanitise(html: Column) -> Column:
    """without scripts, tags of embedded objects, frames and forms, meta tags, event attributes and script addresses; what stands between the tags of a frame stays."""
    for pattern, by in SANITISED:
        html = F.regexp_replace(html, pattern, by)
    return html


def decode_entities(text: Column) -> Column:
    """the named entities, ``&amp;`` last; numeric ones of the whole code space, those beyond it and surrogates as nothing."""
    numbers = F.regexp_extract_all(text, F.lit(r"&#(x[0-9A-Fa-f]{1,6}|\d{1,7});"), F.lit(1))
    code = lambda n: F.when(n.startswith("x"), F.conv(F.substring(n, 2, 8), 16, 10)).otherwise(n).cast("int")
    # a code point as its four bytes
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32")
    out = F.aggregate(F.array_distinct(numbers), text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), F.when(code(n).between(1, 0x10FFFF) & ~code(n).between(0xD800, 0xDFFF), char(n)).otherwise("")))
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def escape_html(text: Column) -> Column:
    """F25."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def human_size(size: Column) -> Column:
    """bytes as B, KB, MB or GB; unknown sizes as a dash."""
    return (
        F.when(size.isNull() | (size < 0), "—")
        .when(size < 1024, F.format_string("%d B", size))
        .when(size < 1024**2, F.format_string("%d KB", (size / 1024).cast("bigint")))
        .when(size < 1024**3, F.format_string("%.1f MB", size / 1024**2))
        .otherwise(F.format_string("%.2f GB", size / 1024**3))
    )


def length_in_points(measure: Column) -> Column:
    """``2.5cm``, ``1in``, ``12pt``, ``10mm``, ``3pc`` or ``16px`` in points; anything else null."""
    number = F.regexp_extract(measure, r"^(-?\d+(?:\.\d+)?)(cm|mm|in|pt|pc|px)$", 1).try_cast("double")
    unit = F.regexp_extract(measure, r"^(-?\d+(?:\.\d+)?)(cm|mm|in|pt|pc|px)$", 2)
    factor = F.when(unit == "cm", 72 / 2.54).when(unit == "mm", 72 / 25.4).when(unit == "in", 72.0).when(unit == "pt", 1.0).when(unit == "pc", 12.0).when(unit == "px", 0.75)
    return number * factor


def space_count(text: Column) -> Column:
    """the number of blanks, an estimate of words."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def statistics(text: Column) -> Column:
    """Q7: words, characters with white space collapsed, characters without, paragraphs."""
    collapsed = F.trim(F.regexp_replace(text, BLANK + "+", " "))
    return F.struct(
        F.size(F.filter(F.split(collapsed, " "), lambda w: w != "")).alias("words"), F.length(collapsed).alias("chars"),
        F.length(F.regexp_replace(text, BLANK + "+", "")).alias("letters"), F.size(F.filter(F.split(text, "\n"), lambda p: F.regexp_replace(p, BLANK + "+", "") != "")).alias("paragraphs"),
    )


def roman(n: Column) -> Column:
    """small Roman numerals of 1 to 3999; other numbers as digits."""
    out, rest = F.lit(""), n.cast("int")
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out = F.concat(out, F.repeat(F.lit(sign), (rest / value).cast("int")))
        rest = rest % value
    return F.when(n.between(1, 3999), out).otherwise(n.cast("string"))


def to_markup(blocks: Column) -> Column:
    """headings with # and ##, bold spans with **, images as [rasm], blocks apart by a blank line."""

    def one(b: Column) -> Column:
        spans = F.concat_ws("", F.transform(b["spans"], lambda s: F.when(s["bold"] & (F.trim(s["text"]) != ""), F.concat(F.lit("**"), s["text"], F.lit("**"))).otherwise(s["text"])))
        plain = F.concat_ws("", F.transform(b["spans"], lambda s: s["text"]))
        return F.when(b["type"] == "IMAGE", "[rasm]").when(b["type"] == "HEADING1", F.concat(F.lit("# "), plain)).when(b["type"] == "HEADING2", F.concat(F.lit("## "), plain)).otherwise(spans)

    return F.array_join(F.transform(blocks, one), "\n\n")


def from_markup(text: Column) -> Column:
    """blocks of type and spans out of markup; ** toggles bold."""
    parts = F.filter(F.split(text, r"\n[ \t]*\n+"), lambda p: F.trim(p) != "")

    def one(p: Column) -> Column:
        p = F.trim(p)
        kind = F.when(p == "[rasm]", "IMAGE").when(p.startswith("## "), "HEADING2").when(p.startswith("# "), "HEADING1").otherwise("PARAGRAPH")
        body = F.when(kind == "IMAGE", "").otherwise(F.regexp_replace(p, r"^#{1,2} ", ""))
        spans = F.filter(F.transform(F.split(body, r"\*\*"), lambda s, i: F.struct(s.alias("text"), ((i % 2) == 1).alias("bold"))), lambda s: s["text"] != "")
        return F.struct(kind.alias("type"), spans.alias("spans"))

    return F.transform(parts, one)


# Names of the languages of a book, long and short.
LANGUAGE_NAMES = {"uzb": ("Oʻzbek (lotin)", "UZ"), "uzb_cyrl": ("Ўзбек (кирилл)", "ЎЗ"), "rus": ("Русский", "RU"), "eng": ("English", "EN"), "auto": ("Auto", "A")}


def language_name(label: Column, short: bool = False) -> Column:
    """the languages of a label such as ``uzb+eng`` by name; unknown ones as they are."""
    known = F.create_map(*[F.lit(x) for k, v in LANGUAGE_NAMES.items() for x in (k, v[short])])
    return F.array_join(F.transform(F.split(label, r"\+"), lambda l: F.coalesce(F.try_element_at(known, l), l)), "+" if short else " + ")
