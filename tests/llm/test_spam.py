import math
import random

import pytest

from leafmill.llm.spam import TAIL, Classes, Trigrams, fit, repeats, scores, sequences, stuffed, trigrams_of

WORDS = "katta kichik daryo kitob bogʻda uzun suvlar yangi eski qalin sokin oqshom shamol tongda yulduz qushlar".split()
COMMON = frozenset({"bilan"})


MANY = [a + b + c for a in ("bo", "ki", "du", "sa", "no", "le") for b in ("ra", "ti", "mo", "zu", "ne") for c in ("n", "lar", "da", "ning", "ga", "m", "cha", "li", "siz", "dan")]


def sentence(rng):
    return " ".join(rng.choices(MANY, k=rng.randint(4, 8))).capitalize() + " bilan " + rng.choice(MANY) + rng.choice(".!")


def prose(rng, n=8):
    return " ".join(sentence(rng) for _ in range(n))


def signed(text):
    """Share of a text's tokens that are of the classes of links, tags, products and repeated keywords."""
    signs = [s for _, item in Classes(COMMON).items(text) for s in item]
    return sum(map(bool, signs)) / max(len(signs), 1)


@pytest.mark.parametrize(
    "text, share",
    [
        ("#arzon #kitob #bepul #onlayn", 1.0), ("Katta kitob arzon A4 49 000 UZS\nEski daryo bepul 5 000 $", 1.0), ("https://a.example/x\nwww.b.test/y?id=3\n[Katta](https://c.test/z)\n» Uy (d.example)", 1.0),
        ("arzon kitob arzon kitob arzon kitob arzon kitob", 1.0), ("bepul kitob | bepul kitob | bepul kitob | bepul kitob", 1.0), ("", 0.0), ("Muallif B. Kitob nomi. Toshkent, 1987. 73 b. https://a.example/1", 0.0), ("Sahifani ulashing polka.example", 0.0),
        ("shop.kitob.dev\nuy.daryo.cloud\nbogʻ.katta.travel/x", 1.0),
    ],
)
def test_signs(text, share):
    assert abs(signed(text) - share) < 0.01


def test_wide_letters_hide_nothing():
    assert signed("ｈｔｔｐｓ：//a.example/x\n#ar­zon") > 0.9
    assert signed("arzоn kitоb аrzon kitob arzon kitob аrzоn kitob") > 0.9


def test_refrain_is_no_keyword():
    verses = [line for i in range(5) for line in (f"{WORDS[i]} suv oqar {WORDS[i + 5]} tomon,", f"Qush uchar {WORDS[i + 2]} {WORDS[i + 7]} sari,", "Ona yer uyquda tongni kutar")]
    assert signed("\n".join(verses)) < 0.5


def test_repeats_windows():
    assert repeats(["a"] * 0) == [] and not any(repeats("bir ikki uch toʻrt".split()))
    tokens = ["aa", "bb"] * 120 + [f"w{'x' * (i % 40)}{i}" for i in range(130)]
    assert len(repeats(tokens)) == len(tokens) and all(repeats(tokens)[:200])


def test_model_prefers_prose():
    rng = random.Random(1)
    classes = Classes(COMMON)
    model = Trigrams(trigrams_of([classes(prose(rng))[1] for _ in range(50)]))
    mean = lambda t: sum(b := model.bits(classes(t)[1])) / len(b)
    assert mean(prose(rng)) < mean("#a #b #c #d #e #f") and model.bits([]) == [] and Trigrams({}).bits(["/ low"]) != []


def rows(rng):
    spam = "\n".join(f"Katta {rng.choice(WORDS)} arzon A4 {rng.randint(2, 90)} 000 UZS" for _ in range(30))
    list_ = "\n".join(f"{i}. {rng.choice(WORDS)} {rng.choice(WORDS)}" for i in range(40))
    return [(i, prose(rng)) for i in range(60)] + [(100, list_), (101, spam), (102, prose(rng) + "\n#a #b #c"), (103, None), (104, ""), (105, "  \n"), (106, spam), (107, "so'z " * 30_000), (108, prose(rng, 2) + "\n" + spam)]


def test_documents(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows(random.Random(2))], "doc_id bigint, text string, stretches string")
    made = sequences(docs, COMMON)
    scored = scores(made, fit(made))
    assert {r.doc_id for r in stuffed(scored).collect()} == {101, 106, 107, 108}
    assert {r.doc_id: (r.perplexity, r.abnormal) for r in scored.where("doc_id between 103 and 105").collect()} == {d: (None, 0.0) for d in (103, 104, 105)}
    twice, none = sequences(docs.unionAll(docs), COMMON), sequences(docs.where("false"), COMMON)
    assert stuffed(scores(twice, fit(twice))).count() == 4 and scores(none, fit(none)).count() == 0


def test_perplexity_decides(spark):
    made = sequences(spark.createDataFrame(rows(random.Random(2)), "doc_id bigint, text string"), COMMON)
    # a model to which all classes are alike finds nothing
    assert stuffed(scores(made, Trigrams({("^", "^", "none"): 1}))).count() == 0 < stuffed(scores(made, fit(made))).count()


def test_bounds_are_those_of_all_prose(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(2, 12)) for _ in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (100, "#a #b #c")], "doc_id bigint, text string")
    made = sequences(docs, COMMON)
    model = fit(made)
    classes = Classes(COMMON)
    own = [classes(t) for t in texts]
    assert model.three == trigrams_of([stretches for is_prose, stretches, _ in own if is_prose])
    bits = [model.bits(stretches) for _, stretches, _ in own]
    every = sorted(b for (is_prose, *_), of in zip(own, bits) if is_prose for b in of)
    low, high = every[int(TAIL * (len(every) - 1))], every[math.ceil((1 - TAIL) * (len(every) - 1))]
    got = {r.doc_id: r.abnormal for r in scores(made, model).collect()}
    for i, ((_, _, sizes), of) in enumerate(zip(own, bits)):
        assert abs(got[i] - sum(n for n, b in zip(sizes, of) if not low <= b <= high) / sum(sizes)) < 1e-9
    # where no document is prose everything is found
    alone = sequences(docs.where("doc_id = 100"), COMMON)
    assert [r.doc_id for r in stuffed(scores(alone, fit(alone))).collect()] == [100]
