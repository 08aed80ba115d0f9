import pytest
from pyspark.sql import functions as F

from leafmill.functions import numbers as N
from leafmill.functions import text as X


def ask(spark, column, **values):
    names = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(names.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in names.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, prefer, expected", [("Мocквa", True, "Москва"), ("Мocквa", False, "Мocквa"), ("plain", True, "plain"), ("aб", True, "аб"), ("aю", False, "aю"), ("", True, "")])
def test_fold_script(spark, word, prefer, expected):
    assert ask(spark, X.fold_script(F.col("w"), prefer), w=word) == expected


@pytest.mark.parametrize("word, expected", [("м0сква", "москва"), ("h0me", "home"), ("B00K", "BooK"), ("10", "10"), ("a0", "a0"), ("2024y", "2024y")])
def test_zero(spark, word, expected):
    assert ask(spark, X.zero_to_letter(F.col("w")), w=word) == expected


def test_apostrophe(spark):
    assert ask(spark, X.uzbek_apostrophe(F.col("w")), w="o'zbek") == "oʻzbek"
    assert ask(spark, X.uzbek_apostrophe(F.col("w")), w="Gʻ''") == "Gʻ"


@pytest.mark.parametrize("text, conf, expected", [("|", 99, True), ("x", 70, True), ("7", 60, False), ("", 99, True), ("и", 60, False), ("abcd", 20, True), ("a--|", 30, True), ("kitob", 90, False)])
def test_noise(spark, text, conf, expected):
    assert ask(spark, X.is_noise(F.col("t"), F.col("c")), t=text, c=conf) is expected


@pytest.mark.parametrize("text, expected", [("short", None), ("zzz " * 20, "uzb+eng"), ("the and of to is in that it was for with as on he she you this be are at by from his", "eng"), ("ўқғ щит " + "кир " * 20, "uzb_cyrl+rus"), ("слово " * 20, "rus+eng")])
def test_language(spark, text, expected):
    assert ask(spark, X.detect_language(F.col("t")), t=text) == expected


@pytest.mark.parametrize("line, expected", [("- 12 -", True), ("xiv", True), ("12a", False), ("[3]", True)])
def test_page_number(spark, line, expected):
    assert ask(spark, X.is_page_number(F.col("l")), l=line) is expected


@pytest.mark.parametrize("line, expected", [("ГЛАВА 2", True), ("Chapter one", True), ("chapters", False), ("Бўлим 1", True)])
def test_chapter(spark, line, expected):
    assert ask(spark, X.is_chapter(F.col("l")), l=line) is expected


def test_key_and_entities(spark):
    assert ask(spark, X.key(F.col("t")), t="Chapter 1: Ab-c") == "chapterabc"
    assert ask(spark, X.decode_entities(F.col("t")), t="&#65;&#x416;&lt;b&gt;&amp;amp;") == "AЖ<b>&amp;"


def test_sanitise(spark):
    html = '<p onclick="x()">a<script>bad()</script><a href="javascript:y()">b</a><iframe src=z></iframe></p>'
    assert ask(spark, X.sanitise(F.col("h")), h=html) == '<p>a<a href="#">b</a></p>'


def test_roman_and_length(spark):
    assert ask(spark, X.roman(F.col("n")), n=1994) == "mcmxciv"
    assert abs(ask(spark, X.length_in_points(F.col("m")), m="2.54cm") - 72) < 1e-9
    assert ask(spark, X.length_in_points(F.col("m")), m="wide") is None


def test_markup_round_trip(spark):
    text = "# T\n\na **b** c\n\n[rasm]\n\n## U"
    assert ask(spark, X.to_markup(F.transform(X.from_markup(F.col("t")), lambda b: b)), t=text) == text


@pytest.mark.parametrize("raw, expected", [("1 234,5", 1234.5), ("1,234.5", None), ("12%", 0.12), ("3.5e2", 350), ("01.02.2024", 45323), ("31.02.2024", 45353), ("01.13.2024", None), ("007", None), ("1234567890123456", None), ("", None)])
def test_typed_number(spark, raw, expected):
    got = ask(spark, N.typed_number(F.col("s")), s=raw)
    assert got == expected or abs(got - expected) < 1e-12


def test_rounding(spark):
    assert ask(spark, N.round_half_up(F.col("x")), x=-2.5) == -2
    assert ask(spark, N.round_up(F.col("x")), x=-1.1) == -2
    assert ask(spark, N.modulo(F.col("x"), F.lit(-3.0)), x=7.0) == -2
    assert ask(spark, N.modulo(F.col("x"), F.lit(0.0)), x=7.0) is None
    assert ask(spark, N.mid(F.col("s"), F.lit(0), F.lit(2)), s="abc") == "c"
    assert ask(spark, N.utf16_length(F.col("s")), s="a😀") == 3


@pytest.mark.parametrize("x, expected", [(5.0, "5"), (0.1, "0.1"), (1234.5678, "1234.5678"), (1 / 3, "0.3333333333")])
def test_general(spark, x, expected):
    assert ask(spark, N.general(F.col("x")), x=x) == expected


def test_cell_reference(spark):
    assert tuple(ask(spark, N.cell_reference(F.col("r")), r="$AB$12")) == (11, 27)
    assert ask(spark, N.cell_reference(F.col("r")), r="12A") is None
