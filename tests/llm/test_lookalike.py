import random
import unicodedata

import pytest

from leafmill.llm import glyphs
from leafmill.llm.lookalike import canonical, same_look

PAGE = "project string, pos int, blocks array<struct<type:string,spans:array<struct<text:string>>>>, words array<struct<t:string>>"
LEXICON = "term_id int, term string, kind string"


def forms(spark, *texts):
    df = spark.createDataFrame([(t, "x") for t in texts], "raw string, canon string")
    return {r.raw: (r.canon, r.look) for r in canonical(df, "raw").collect()}


def test_one_form_for_one_look(spark):
    same = ["Saluboy", "Ｓａｌｕｂｏｙ", "Ѕaluboy", "Sal­u​boy", "Sаlubоy﻿"]
    got = forms(spark, *same)
    assert {got[t][0] for t in same} == {"Saluboy"} and len({got[t][1] for t in same}) == 1


def test_script_by_unambiguous_letters(spark):
    got = forms(spark, "Мocквa", "Дapдapcoй", "yйўл")
    assert got["Мocквa"][0] == "Москва" and got["Дapдapcoй"][0] == "Дардарсой" and got["yйўл"][0] == "уйўл"


def test_marks_are_ordered_and_composed(spark):
    a, b = "ậ", "ậ"
    got = forms(spark, a, b, "ö", "q̈", "й", "й")
    assert got[a][0] == got[b][0] == unicodedata.normalize("NFC", a)
    assert got["ö"][0] == "ö" and got["q̈"][0] == "q̈" and got["й"][1] == got["й"][1]


def test_composition_is_that_of_unicode(spark):
    rng = random.Random(1)
    marks = [chr(c) for c in range(0x300, 0x345) if unicodedata.combining(chr(c))]
    texts = ["".join(rng.choice("abuzwkAU") + "".join(rng.choices(marks, k=rng.randint(0, 4))) for _ in range(3)) for _ in range(300)] + ["\u1112\u1161\u11ab\u1100\u1173", "한글", "\u1112x\u1161", "\U0002f81a"]
    got = forms(spark, *texts)
    assert [t for t in got if got[t][1] != unicodedata.normalize("NFKC", t)] == []


def test_whole_code_space(spark):
    got = forms(spark, "a\U000e0101b\U000e0041", "x\u2800y", "ka\u180bt\u115f", "\u0251\u04cf")
    assert [v[1] for v in got.values()] and got["a\U000e0101b\U000e0041"][1] == "ab" and got["x\u2800y"][1] == "x y" and got["ka\u180bt\u115f"][1] == "kat" and got["\u0251\u04cf"][1] == "al"


def test_apostrophes_blanks_ligatures(spark):
    got = forms(spark, "o'g`on", "oʻgʻon", "a b", "a b", "ﬁn", "she'r", "sheʼr", "№")
    assert got["o'g`on"][0] == got["oʻgʻon"][0] == "oʻgʻon" and got["a b"][0] == "a b" and got["ﬁn"][0] == "fin"
    assert got["she'r"][0] == got["sheʼr"][0] == "sheʼr" and got["№"][0] == "№"


def test_what_stays_different(spark):
    got = forms(spark, "Saluboy", "saluboy", "Sälubоy", "Salub0y")
    assert len({v[1] for v in got.values()}) == 4


def test_empty_long_and_null(spark):
    long = "оo" * 20_000
    got = forms(spark, "", "​", None, long)
    assert got[""] == ("", "") and got["​"] == ("", "") and got[long][1] == "oo" * 20_000 and None not in got
    assert canonical(spark.createDataFrame([], "raw string"), "raw").count() == 0


@pytest.mark.parametrize("text", ["Vo⁠dа⁠r­tonе", "oʻz B5", "Ｂｕ qoringiz", "кӱ", "ÀÉ ﬂ", "Ѐ 한글 日本"])
def test_plain_agrees_with_the_operator(spark, text):
    assert forms(spark, text)[text][1] == glyphs.plain(text)


def test_cases(spark):
    words = [{"t": t} for t in ("«Ѕaluboy»,", "Saluboy", None, "SALUBOY", "Saluboyga")]
    blocks = [{"type": "HEADING1", "spans": [{"text": "Old "}, {"text": "ink"}]}, {"type": "PARAGRAPH", "spans": [{"text": "Old ink"}]}, {"type": "HEADING2", "spans": None}, {"type": "HEADING2", "spans": [{"text": "Old ink"}]}]
    row = ("p", 0, [(b["type"], b["spans"]) for b in blocks], [(w["t"],) for w in words])
    pages = spark.createDataFrame([row, row, ("p", 1, None, None)], PAGE)
    lexicon = spark.createDataFrame([(1, "Saluboy", "word"), (2, "Old ink", "head"), (3, None, "word")], LEXICON)
    got = sorted(tuple(r) for r in same_look(pages, lexicon).select("project", "pos", "place", "idx", "term_id").collect())
    assert got == [("p", 0, "block", 0, 2), ("p", 0, "word", 0, 1)]
    assert same_look(pages.where("false"), lexicon).count() == 0
