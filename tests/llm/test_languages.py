import random

import numpy as np

from leafmill.llm.languages import LANGUAGES, Languages, Trigrams, bare, book_labels, fit, mixture, named_language
from tests.llm.pages import frame, page

TEXTS = {
    "uzb": "Katta daryoda kichik baliqlar yurdi va bolalar bilan otalari bogʻda uzoq vaqt suhbat qildi keyin hammasi uyga qaytib keldi",
    "uzb_cyrl": "Катта дарёда кичик балиқлар юрди ва болалар билан оталари боғда узоқ вақт суҳбат қилди кейин ҳаммаси уйга қайтиб келди",
    "rus": "Большая река течёт через тихий город и дети долго говорили с отцом в саду потом все вернулись домой когда стало темно",
    "eng": "The large river runs through the quiet town and the children talked with their father in the garden until they all went home",
}


def test_models_and_held_out_words():
    model = fit([(lang, t) for lang, t in TEXTS.items() for _ in range(5)])
    for lang, word in (("eng", "through"), ("rus", "городом"), ("uzb", "baliqlari"), ("uzb_cyrl", "балиқлари")):
        assert LANGUAGES[int(np.argmax(model.score(word)))] == lang


def test_wrong_labels_are_outvoted():
    texts = [(lang, t) for lang, t in TEXTS.items() for _ in range(6)] + [("rus", TEXTS["uzb"])]
    model = fit(texts)
    assert LANGUAGES[int(np.argmax(model.score("daryoda")))] == "uzb"


def test_seeds_stand_for_labels():
    model = fit([("uzb", TEXTS["uzb"])] * 3, [("eng", w) for w in TEXTS["eng"].split()] + [("xx", "none")])
    assert LANGUAGES[int(np.argmax(model.score("through")))] == "eng"


def test_mixture_selects_languages():
    strong = lambda i: [0.0 if j == i else -12.0 for j in range(4)]
    scores = np.array([strong(0)] * 30 + [strong(3)] * 30 + [strong(2)] * 20, float)
    shares, allowed = mixture(scores, np.array([0] * 60 + [1] * 20), np.ones(80), 2)
    assert allowed[0].tolist() == [True, False, False, True] and allowed[1].tolist() == [False, False, True, False]
    assert np.allclose(shares[0], [0.5, 0, 0, 0.5], atol=1e-3) and np.allclose(shares.sum(1), 1)


def test_labels(spark):
    df = spark.createDataFrame([("uzb+eng",), ("RU",), ("auto",), ("",), (None,), (" und",), ("uzb_cyrl+rus",)], "l string")
    assert [r.n for r in df.select(named_language(df["l"]).alias("n")).collect()] == ["uzb", "rus", None, None, None, None, "uzb_cyrl"]
    rows = [("a", 1, "eng", None), ("a", 3, "auto", "rus"), ("a", 2, "uzb", None), ("b", 1, "auto", None), ("c", 5, "", "eng"), ("d", 5, None, None), ("d", 5, "eng", None), (None, 1, "eng", None)]
    books = spark.createDataFrame(rows, "id string, updated_at bigint, language string, detected_language string")
    assert {r.project: r.label for r in book_labels(books).collect()} == {"a": "rus", "b": None, "c": None, "d": "eng"}


def pages():
    rng = random.Random(3)

    def text(lang):
        words = TEXTS[lang].split()
        return " ".join(rng.sample(words, len(words)))

    junk = "~~_ ]•[ ;.; №№ ^^ »|"
    return [page("p", i, text("uzb"), text("uzb"), language="uzb+eng") for i in range(6)] + [
        page("p", 6, text("uzb"), text("uzb"), text("rus"), text("uzb"), language="uzb"), page("p", 7, text("uzb"), text("uzb"), language="rus"), page("p", 8, text("uzb"), language=None), page("p", 9, junk, junk, junk, language=None),
        page("p", 10, language="eng"), page("q", 0, TEXTS["rus"], language="rus+eng"), page("q", 0, TEXTS["rus"], language="rus+eng"), page("r", 0, text("eng"), language="eng"), page("r", 1, text("uzb_cyrl"), language="und"), page("r", 2, text("uzb_cyrl"), language="uzb_cyrl"),
    ]


def test_books_pages_blocks(spark):
    books = spark.createDataFrame([("p", 1, "rus", None), ("q", 1, "auto", "rus"), ("r", 1, "", None), ("none", 1, "", None)], "id string, updated_at bigint, language string, detected_language string")
    run = Languages(frame(spark, *pages()), books)
    rows = {(r.project, r.pos): (r.lang, r.declared) for r in run.page_rows.collect()}
    assert rows["p", 7] == ("uzb", "rus") and rows["p", 8] == ("uzb", None) and ("p", 9) not in rows and ("p", 10) not in rows and rows["r", 1] == ("uzb_cyrl", None)
    assert {(r.project, r.lang, r.declared) for r in run.books().collect() if r.project != "r"} == {("p", "uzb", "rus"), ("q", "rus", "rus")} and {r.lang for r in run.books().where("project = 'r'").collect()} == {"uzb_cyrl"}
    assert [(r.project, r.pos, r.block_idx, r.lang) for r in run.foreign_blocks().collect()] == [("p", 6, 2, "rus")]


def test_pages_of_words_alone(spark):
    books = spark.createDataFrame([], "id string, updated_at bigint, language string, detected_language string")
    bare_ = page("p", 50, TEXTS["rus"], TEXTS["rus"], language=None, blocks=[])
    run = Languages(frame(spark, *pages(), bare_), books)
    assert [(r.lang, r.declared) for r in run.page_rows.where("project = 'p' and pos = 50").collect()] == [("rus", None)]


def test_broken_input(spark):
    books = spark.createDataFrame([], "id string, updated_at bigint, language string, detected_language string")
    rows = [("p", 0, None, None, None, "x"), ("p", 1, None, [("PARAGRAPH", None), (None, [(None,)])], None, "x"), ("p", 2, None, [("PARAGRAPH", [("сло " * 30_000,)])], None, "x")]
    run = Languages(frame(spark, *rows), books)
    assert run.books().count() == 0 and run.page_rows.count() <= 1
    assert Languages(frame(spark, *rows).where("false"), books).page_rows.count() == 0
    assert bare("«Oʻz-1»") == "oʻz" and Trigrams({}).score("a")
