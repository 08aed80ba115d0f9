import random
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.bpe import TOKENIZERS, VOCABULARY, Encoder, encode, load_ranks
from leafmill.llm.packing import Index, fill, pack

tokenizers = pytest.importorskip("tokenizers")
RANKS = load_ranks(f"{TOKENIZERS}/{VOCABULARY}")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    e = Encoder(RANKS)
    return lambda s: [i for w in e([s])[0] for i in w]


ODD = ["", " ", "\n\n x", "<|endoftext|>", "aaaaaaaaaaaaaaa", "é́", "日本語 😀😀", "don't 's S", "x y  z", "\x00\x01", "1234567 8", "кто-то пришёл", "a" * 20_000]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text, reference, encoder):
    assert encoder(text) == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    e = Encoder(RANKS)
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json") if not hasattr(test_any_text, "t") else test_any_text.t
    t.encode_special_tokens = True
    test_any_text.t = t
    assert [i for w in e([text])[0] for i in w] == t.encode(text, add_special_tokens=False).ids


def test_encode_in_spark(spark, reference):
    df = spark.createDataFrame([(1, "Salom, dunyo!", "x"), (2, None, "x"), (3, "", "x"), (1, "Salom, dunyo!", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode(df).collect())
    assert got == [(1, reference("Salom, dunyo!"))] * 2 + [(2, []), (3, [])]
    assert encode(df.where("false")).count() == 0


def test_pack_holds_every_item_once():
    rng = random.Random(4)
    for capacity in (1, 7, 100):
        sizes = [rng.randint(0, capacity) for _ in range(400)]
        near = lambda seed, unused: [i for i in rng.sample(range(len(sizes)), 5) if unused[i] and i != seed]
        bins = pack(sizes, capacity, near)
        assert sorted(i for b in bins for i in b) == [i for i, s in enumerate(sizes) if s]
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)


def test_neighbours_against_brute_force():
    import math
    from collections import Counter

    import numpy as np

    rng = random.Random(6)
    bags = [Counter(rng.choices("abcdefghijkl", k=rng.randint(3, 9))) for _ in range(40)]
    index = Index(bags)
    n, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log(1 + (n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    unused = np.array([i % 3 != 0 for i in range(n)])
    for seed in range(0, n, 7):
        terms = [t for t in bags[seed] if df[t] > 1]
        score = {d: sum(idf[t] * bags[d][t] * 2.2 / (bags[d][t] + 1.2 * (0.25 + 0.75 * sum(bags[d].values()) / mean)) for t in terms if t in bags[d]) for d in range(n) if d != seed and unused[d]}
        expected = [d for d, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0])) if s > 0]
        got = index.ranked(seed, unused)
        assert set(got) <= set(score) and np.allclose([score[d] for d in got], [score[d] for d in expected], atol=1e-5)


def test_seed_reaches_every_neighbour_that_fits():
    from collections import Counter

    # 30 neighbours too large for the room rank above the one that fits; only a frequent term leads there; one without a common term is larger
    bags = [Counter({"a": 1, "b": 1, **{f"r{k}": 1 for k in range(14)}})] + [Counter({f"r{k % 14}": 3, f"x{k}": 1, "b": 1}) for k in range(30)] + [Counter({"a": 1, "y": 9}), Counter({"z": 5}), Counter({"a": 1, "z": 2})]
    sizes = [90, *[50] * 30, 5, 10, 40]
    assert next(b for b in pack(sizes, 100, Index(bags).ranked) if 0 in b) == [0, 31]


def test_rests_are_packed_with_an_index():
    import pyarrow as pa

    from leafmill.llm.packing import _repack

    texts = ["river stone garden", "house cat tree", "river stone boat", "sun moon star"]
    group = pa.table({"container": ["s"] * 4, "capacity": pa.array([100] * 4, pa.int32()), "salt": [0] * 4, "doc_id": [1, 2, 3, 4], "part": pa.array([0] * 4, pa.int32()), "tokens": [60, 40, 30, 38], "text": texts})
    rows = _repack(SimpleNamespace(value=RANKS))(group).to_pylist()
    assert {r["doc_id"] for r in rows if r["bin"] == "r0-0"} == {1, 3}


def test_bins_hold_what_is_alike():
    from collections import Counter

    rng = random.Random(13)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(12)]
    of = [rng.randrange(12) for _ in range(600)]
    bags = [Counter(rng.choices(topics[k], k=20) + rng.choices(["and", "of", "the"], k=10)) for k in of]
    sizes = [rng.randint(20, 60) for _ in bags]

    def alike(bins):
        pairs = [(of[a], of[b]) for content in bins for a, b in zip(content, content[1:])]
        return sum(a == b for a, b in pairs) / len(pairs)

    by_index, by_size = pack(sizes, 400, Index(bags).ranked), pack(sizes, 400, lambda seed, fits: ())
    assert alike(by_index) > 0.6 > 0.3 > alike(by_size)


def test_fill(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["river", "stone", "garden", "кит", "уй"], k=rng.randint(1, 90))) for _ in range(200)] + [None, "", "long " * 700, "dup", "dup"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")], "doc_id bigint, text string, tokens string")
    kinds = spark.createDataFrame([("s", 64), ("l", 512), ("none", None), ("zero", 0)], "container string, capacity int")
    rows = fill(docs, kinds).collect()
    sizes = {r.doc_id: len(r.ids) for r in encode(docs).collect()}
    for kind, capacity in (("s", 64), ("l", 512)):
        own = [r for r in rows if r.container == kind]
        filled, tokens = {}, {}
        for r in own:
            filled[r.bin] = filled.get(r.bin, 0) + r.tokens
            tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.tokens
            assert r.tokens <= capacity and (sizes[r.doc_id] > capacity or r.part == 0)
        assert max(filled.values()) <= capacity
        assert tokens == {d: n * (2 if d == 7 else 1) for d, n in sizes.items()}
        assert sum(filled.values()) > 0.9 * capacity * len([f for f in filled.values() if f]) - 2 * capacity
    assert fill(docs.where("false"), kinds).count() == 0 and fill(docs, kinds.where("false")).count() == 0
