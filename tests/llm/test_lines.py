import random

import pytest

from leafmill.llm.boilerplate import page_counts, repeated_lines, repeated_templates
from leafmill.llm.pagelines import Words, as_number, kind_of, page_lines, phrases, roman, shows_page
from leafmill.llm.quality import STATISTICS, exact_ranks, outlier_scores, page_kinds, page_labels, page_statistics, scored_pages
from tests.llm.pages import PROSE, frame, page


def kind(line, pos=0):
    words = Words()
    return kind_of([words(t) for t in line.split()], pos)


@pytest.mark.parametrize(
    "line, expected",
    [
        ("1. Qanday sahifadan issiq quyoshni", "list"), ("• Ва китоблари жуда ;", "list"), ("Toʻgʻri chiroqingiz va .................. 5", "list"), ("Koʻzlarning, har tuzingiz 31, 230", "list"),
        ("Goʻzal raqscha | 07.02.1962 | 70% | 2152", "table"), ("Zarrilmiqoʻrgʻon 6% 33% 89%", "table"), ("~~_ ]•[ ]•[ _~ \\з .^:| ~o~", "junk"), ("zmrn zщrн zqкzжfkшk l/ kкs кiflhx ı|", "junk"),
        ("Katta daryoda kichik baliqlar yurdi va", "prose"), ("— Buğdoydan qorda turdi, suradi.", "prose"), ("И в 5 саду они", "prose"),
    ],
)
def test_kinds(line, expected):
    assert kind(line) == expected


@pytest.mark.parametrize("line, pos, expected", [("12", 11, True), ("[12]", 11, True), ("— 12 –", 11, True), ("I2", 11, True), ("l", 0, True), ("xii", 11, True), ("p. 12", 11, True), ("12-bet", 11, True), ("стр. 12", 11, True), ("1987", 11, False), ("12 may", 12, False), ("IO", 9, True), ("2О", 19, True)])
def test_page_numbers(line, pos, expected):
    words = Words()
    assert shows_page([words(t)[0] for t in line.split()], pos) is expected


def test_numerals():
    assert [roman(n) for n in (1, 4, 9, 14, 40, 399)] == ["i", "iv", "ix", "xiv", "xl", "cccxcix"] and [roman(n) for n in (401, 412, 944, 1999)] == ["cdi", "cdxii", "cmxliv", "mcmxcix"] and roman(0) == ""
    assert as_number("1234567") == 1234567 and shows_page(["CDXII"], 411) and shows_page(["1234568"], 1234567)
    assert as_number("I0") == 10 and as_number("ab") is None and as_number("") is None


def test_unmarked_entries_need_a_run():
    words = Words()
    lines = [[words(t) for t in x.split()] for x in ("Katta bogʻda", "Kichik suv", "Qora tun", "Oq non", "Uzun yoʻl boʻylab", "yurdi.")]
    kinds = ["prose"] * 6
    phrases(kinds, [x[0][6][:1] for x in lines], lines)
    assert kinds == ["list"] * 4 + ["prose"] * 2


def test_spellings_counted_with_the_lines(spark):
    rows = [page("p", 0, "katta suv katta", "keldi 1987. suv-"), page("p", 1, "suv keldi"), page("p", 1, "suv keldi"), page("q", 1, "uzun"), page("q", 1, "uzun"), ("p", 2, "uzb", [("PARAGRAPH", [("suv uzun",)])], None, "x"), ("p", 3, None, None, [(None, 1), ("", 1)], "x")]
    pages = frame(spark, *rows)
    expected = {}
    for project, pos, _, _, words, _ in rows:
        for t, _ in words or ():
            expected.setdefault(t, []).append((project, pos))
    got = page_lines(pages, spelled=True).selectExpr("inline(spelled)").groupBy("t").agg({"n": "sum", "lo": "min", "hi": "max"}).collect()
    assert {r["t"]: (r["sum(n)"], r["min(lo)"] < r["max(hi)"]) for r in got} == {t: (len(at), len(set(at)) > 1) for t, at in expected.items()}
    rest = lambda df: sorted(map(str, df.drop("spelled").collect()))
    assert rest(page_lines(pages, spelled=True)) == rest(page_lines(pages))
    assert page_lines(pages.limit(0), spelled=True).collect() == []


@pytest.mark.parametrize("line, expected", [("Katta daryo . . . . .", "list"), ("Katta daryo ....", "list"), ("Katta daryo keldi.", "prose"), ("Suv bor…… 12", "list"), ("7) Katta daryo", "list"), ("a. Katta daryo", "list"), ("Katta daryo, suvlar 31, 230.", "list"), ("Katta daryo ____.", "list")])
def test_kinds_by_ends(line, expected):
    assert kind(line) == expected


def boilerplate(spark, pages, n=10, misread=()):
    rows = []
    for pos in range(n):
        head = "Share this page with readers" if pos % 2 == 0 else "SHARE THIS PAGE, WITH READERS"
        if pos in misread:
            head = head.replace("page", "pa9e").replace("PAGE", "PACIE")
        rows.append(page("p", pos, f"{head} {pos + 1}" if pos % 3 else head, *PROSE, f"Unique line number here {'abcdefghij'[pos] * 4}"))
    return frame(spark, *rows, *pages)


def found(spark, pages, **limits):
    lines = page_lines(pages)
    return sorted({(r.project, r.pos, r.b) for r in repeated_lines(lines, pages, **limits).collect() if r.b >= 0})


def test_repeated_lines_with_misread_words(spark):
    pages = boilerplate(spark, [page("q", 0, "Share this page with readers")], misread=(2, 3))
    got = found(spark, pages)
    # the prose is the same on each page here, so it is found as well
    assert {x for x in got if x[2] == 100} == {("p", i, 100) for i in range(10)} and all(x[0] == "p" for x in got)
    assert not [x for x in got if x[2] == 140]


def test_repeated_rows_count_once(spark):
    row = page("p", 0, "A line of many letters here")
    others = [page("p", i, f"other {'xyzuvw'[i] * 9} {'klmnop'[i] * 7}") for i in range(1, 6)]
    assert found(spark, frame(spark, row, row, row, *others)) == []


def test_lines_hang_together_by_any_number_of_links(spark):
    words = "kitob yangi bogʻimiz zalida oʻqildi".split()
    changed = [words, ["kitoh", *words[1:]], ["kitoh", "yangl", *words[2:]], ["kitoh", "yangl", "bogʻlmiz", *words[3:]], ["kitoh", "yangl", "bogʻlmiz", "zaliba", words[4]]]
    rows = [page("p", i, " ".join(c), f"{'xyzuvw'[i] * 9} {'klmnop'[i] * 7} bilan") for i, c in enumerate(changed)]
    assert [x[1] for x in found(spark, frame(spark, *rows)) if x[2] == 100][:4] == [0, 1, 2, 3]


def test_lines_of_one_word_and_of_hidden_letters(spark):
    rows = [page("p", i, "Elektronkutubxonamiz" if i else "E1ektronkutubxonamiz", f"{'12 3 4 5 6 7 yangi kitob' if i == 2 else 'Bizning yangi kitob'} {i}", f"{'xyzuvw'[i] * 9} {'klmnop'[i] * 7}") for i in range(4)]
    assert {x[1] for x in found(spark, frame(spark, *rows)) if x[2] == 100} == {0, 1, 2, 3}


def test_two_true_lines_in_one_slot(spark):
    heads = ["Kitob mevaimiz oquv zalida"] * 5 + ["Kitob chuqurlik oquv zalida"] * 4 + ["Kitob chuqurlrik oquv zalida"]
    rows = [page("p", i, h, f"{'abcdefghij'[i] * 9} {'klmnopqrst'[i] * 7}") for i, h in enumerate(heads)]
    assert [x[1] for x in found(spark, frame(spark, *rows)) if x[2] == 100] == list(range(10))


def test_share_of_pages(spark):
    rows = [page("p", i, "The same line of many letters" if i < 3 else f"different {'abcdefghijklmnopqrst'[i] * 9} {'bcdefghijklmnopqrstu'[i] * 8}") for i in range(16)]
    assert found(spark, frame(spark, *rows)) == []
    assert len(found(spark, frame(spark, *rows[:15]))) == 3


def test_brute_force(spark):
    rng = random.Random(1)
    words = ["daryo", "kitob", "bogʻda", "uzun", "keldi", "katta", "suvlar", "qaytdi"]
    common = [" ".join(rng.choices(words, k=5)) for _ in range(4)]
    rows = [page("p" if i % 2 else "hot", i, *rng.sample(common, 2), " ".join(rng.choices(words, k=7))) for i in range(40)]
    pages = frame(spark, *rows)
    expected = set()
    for project in ("p", "hot"):
        own = [r for r in rows if r[0] == project]
        at: dict[str, set] = {}
        for r in own:
            for b in {w[1] for w in r[4]}:
                at.setdefault(" ".join(t for t, k in r[4] if k == b), set()).add((r[1], b))
        for text, places in at.items():
            pos = {p for p, _ in places}
            if len(pos) >= 3 and len(pos) >= len(own) / 5 and sum(c.isalpha() and c != "ʻ" for c in text) >= 15:
                expected |= {(project, *p) for p in places}
    assert set(found(spark, pages)) >= expected


def test_lines_of_broken_input(spark):
    rows = [("p", 0, None, None, None, "x"), ("p", 1, None, [("PARAGRAPH", [("from blocks\nsecond",)]), ("IMAGE", None)], None, "x"), ("p", 2, None, [], [], "x"), ("p", 3, None, None, [(None, 1), ("a", 1)], "x"), (None, None, None, None, [("word " * 5, 1)], "x"), ("p", 4, None, None, [("x" * 100_000, 1)], "x")]
    got = page_lines(frame(spark, *rows)).collect()
    assert sorted((r.pos or -1, r.b, r.nw) for r in got) == [(-1, 1, 1), (1, -2, 1), (1, -1, 2), (3, 1, 2), (4, 1, 1)]
    empty = frame(spark, *rows).where("false")
    assert page_lines(empty).count() == 0 and repeated_templates(page_lines(empty), page_counts(empty)).count() == 0


def test_exact_ranks(spark):
    rng = random.Random(2)
    values = [("g", "s", float(rng.choice([0, 0, 0, 1, 2, 5.5]))) for _ in range(300)] + [("h", "s", 1.0), ("h", "s", None), ("h", "s", float("nan"))]
    got = {(r.grp, r.value): (r.below, r.upto, r.n) for r in exact_ranks(spark.createDataFrame(values, "grp string, stat string, value double")).collect()}
    g = [v for grp, _, v in values if grp == "g"]
    assert got == {**{("g", v): (sum(x < v for x in g), sum(x <= v for x in g), 300) for v in set(g)}, ("h", 1.0): (0, 1, 1)}


def test_page_kinds(spark):
    rng = random.Random(3)
    words = "katta kichik daryo kitob bogʻda uzun keldi suvlar qaytdi yangi eski qalin sokin bilan uchun".split()
    prose = [page("p", i, *[f"{' '.join(rng.choices(words, k=8))}." for _ in range(8)]) for i in range(40)]
    special = [
        page("p", 40, *[f"{i}. {' '.join(rng.choices(words, k=3))}" for i in range(1, 9)]), page("p", 41, *[f"{rng.choice(words)} | {i}% | {i * 7},5 | —" for i in range(1, 9)]), page("p", 42, *["~~_ ]•[ ;.; №№ ^^ »|"] * 8), page("p", 43, "43"),
    ]
    pages = frame(spark, *prose, *special, special[0])
    lines = page_lines(pages, frozenset({"bilan", "uchun"}))
    none = spark.createDataFrame([], "path bigint")
    got = {(r.pos, r.kind) for r in page_kinds(scored_pages(page_labels(pages), lines, none)).collect()}
    assert got == {(40, "list"), (41, "table"), (42, "junk")}
    stats = page_statistics(lines.where("false"), none)
    assert stats.count() == 0 and set(STATISTICS) <= set(stats.columns)
    assert outlier_scores(stats.withColumn("grp", stats["project"])).count() == 0


def test_scores_decide(spark):
    rng = random.Random(3)
    words = "katta kichik daryo kitob bogʻda uzun keldi suvlar qaytdi yangi eski qalin sokin bilan uchun".split()
    rows = [page("p", i, *[f"{' '.join(rng.choices(words, k=8))}." for _ in range(8)]) for i in range(20)] + [page("p", 20, *[f"{i}. {' '.join(rng.choices(words, k=3))}" for i in range(1, 9)])]
    pages = frame(spark, *rows)
    scored = scored_pages(page_labels(pages), page_lines(pages), spark.createDataFrame([], "path bigint"))
    assert page_kinds(scored).count() == 1
    # shares alone find nothing: a constant score is below every bound, and a greater one above that of the kind that stands in the language
    assert page_kinds(scored.withColumn("list_score", scored["list_score"] * 0)).count() == 0
    assert page_kinds(scored.withColumn("list_score", scored["list_score"] * 0 + 99)).count() == 21


def test_page_kinds_where_the_kind_is_common(spark):
    # most pages of one language are lists, and a label stands on one page alone
    pages = frame(spark, *[page("p", i, *[f"{k}. Katta kitob" for k in range(1, 8)]) for i in range(5)], page("p", 5, *PROSE), page("p", 6, *[f"{k}. Книга" for k in range(1, 8)], language="rus"))
    lines, none = page_lines(pages), spark.createDataFrame([], "path bigint")
    got = {(r.pos, r.kind) for r in page_kinds(scored_pages(page_labels(pages), lines, none)).collect()}
    assert got == {(i, "list") for i in (0, 1, 2, 3, 4, 6)}
