"""Problem 8: pages of stuffed keywords, links or product tags.

Every token becomes a class: a function word itself, a number, a price, a sign, a word by its shape, with its closing
punctuation. A token that stands in an item of links, of tags or of products, or whose pair keeps coming back, is of another
class than the same word in a sentence. A trigram model over the class sequences of all prose documents, which are those without such tokens,
gives every stretch of a document a perplexity. A document is found if more than half of its text lies in
stretches whose perplexity is abnormally high or low, by exact quantiles over the stretches of all prose documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import glyphs
from leafmill.llm.pagelines import Words, common_keys
from leafmill.llm.quality import exact_ranks
from leafmill.llm.ragged import slices
from leafmill.plans.staging import stage, table

#: Tokens of a stretch, and the share of prose stretches that each abnormal tail holds.
STRETCH, TAIL = 40, 0.002
#: Least share of abnormal text of a case.
SPAM_SHARE = 0.5
#: Trigrams rarer than this among all are left to the shorter contexts, so that a model has at most a million of them.
RAREST = 1e-6
#: A pair of words is a repeated keyword where it stands this often among ``WINDOW`` tokens.
REPEATS, WINDOW = 3, 100
#: An item of at most so many words is a tag where a word of it stands so often in a stretch of items.
TAG_WORDS, TAG_REPEATS = 5, 6
#: A link is named by at most so many words before it, and an item of at most so many beside links is one of links.
_NAMED = 8
#: An item of a product has at most so many words.
_PRODUCT = 10

_LINK = regex.compile(r"(?i:(https?:)?//\S+|www\.\S+)|\b[\w-]+(\.[\w-]+)*\.[a-z]{2,24}\b(/\S*)?|\b[\w-]+ ?\[\.\] ?\w+")
_LINK_HINT = re.compile(r"//|[wW]{3}\.|\[\.\]|\w\.[a-z]{2}")
_PRICE = regex.compile(r"\d[\d ]*(\$|€|₽|UZS|USD|EUR|RUB|soʻm|so'm|сўм|сум|руб)|[$€]\s?\d", regex.I)
_NUMBER = regex.compile(r"^[\d.,:/%–-]+$")
_CITED = regex.compile(r"\b(1[89]|20)\d\d[.,]")
_PLAIN_DOMAIN = regex.compile(r"^[^/:»(\[<]*\p{L}\s+[\w-]+\.[a-z]+\W*$", regex.I)
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]+")
_SEGMENT = regex.compile(r"\s+[•|·]\s+|  +")
_CURRENCY = frozenset("$ € ₽ UZS USD EUR RUB soʻm so'm сўм сум руб".split())
#: What an entry of a list begins with.
_ENTRY = regex.compile(r"^\(?\d{1,3}[.)]$|^[*–-]$")
_NOT_KEY = regex.compile(r"[^\p{L}ʻʼ'-]+")
#: Signs of the classes of tokens in items of links, of products and of tags, and of repeated pairs.
LINKED, PRICED, TAGGED, REPEATED = "@", "$", "#", "+"
#: The class that begins every item.
ITEM = "/"

SEQUENCES = "doc_id bigint, prose boolean, stretches array<string>, sizes array<bigint>"


_KEYS: dict[str, str] = {}


def keyed(token: str) -> str:
    """A word's letters in small print form; kept by spelling, bounded."""
    got = _KEYS.get(token)
    if got is None:
        if len(_KEYS) > 300_000:
            _KEYS.clear()
        got = _KEYS[token] = _NOT_KEY.sub("", glyphs.plain(token).lower())
    return got


def windows(n: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, first new) of stretches of ``WINDOW`` tokens; the last reaches back to be whole."""
    for i in range(0, n, WINDOW):
        yield (i if i + WINDOW <= n else max(0, n - WINDOW)), min(i + WINDOW, n), i


def repeats(tokens: list[str]) -> list[bool]:
    """For every token whether a pair that it is in stands ``REPEATS`` times in its stretch."""
    out: list[bool] = []
    keys = [keyed(t) for t in tokens]
    for start, end, new in windows(len(keys)):
        window = keys[start:end]
        pairs = Counter(zip(window, window[1:]))
        hit = [False] * len(window)
        for (j, a), b in zip(enumerate(window), window[1:]):
            if pairs[a, b] >= REPEATS and a and b and (len(a) > 1 or len(b) > 1):
                hit[j] = hit[j + 1] = True
        out += hit[new - start :]
    return out


def tagged(items: list[list[str]]) -> list[bool]:
    """For every item of a few words whether a common noun or verb of it keeps coming back in the items around it.

    Names, which begin with a capital, and items that are sentences or parts of them do not count.
    """
    tokens = [(i, keyed(t)) for i, item in enumerate(items) for t in item if t[:1].islower() and len(t) > 2]
    out = [False] * len(items)
    for start, end, new in windows(len(tokens)):
        often = Counter(k for _, k in tokens[start:end])
        for i, k in tokens[new:end]:
            if often[k] >= TAG_REPEATS and len(k) > 2:
                out[i] = True
    return [hit and len(item) <= TAG_WORDS for hit, item in zip(out, items)]


class Classes:
    """Classes of the tokens of a text."""

    def __init__(self, common: frozenset[str]) -> None:
        self.common = common
        self.words = Words()
        self.known: dict[str, str] = {}

    def of(self, token: str) -> str:
        """The class of a token by itself."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            end = "," if token[-1] in ",;:" else "." if token[-1] in ".!?…" else ""
            if token[0] == "#" and len(token) > 1:
                got = "TAG"
            elif _LINK_HINT.search(token):
                got = "LINK"
            elif token in _CURRENCY:
                got = "PRICE"
            elif _NUMBER.match(token):
                got = "NUM" + end
            else:
                key = self.words(token)[1]
                if key in self.common:
                    got = "=" + key + end
                elif not any(c.isalpha() for c in token):
                    got = "SIGN"
                else:
                    got = ("Cap" if token.lstrip("«\"“(—")[:1].isupper() else "low") + end
            self.known[token] = got
        return got

    def items(self, text: str) -> list[tuple[list[str], list[str]]]:
        """(tokens, signs of their classes) of every item: of every line, or of what signs or wide blanks part it into."""
        # in print form, so that wide letters and invisible marks hide nothing
        lines = [line for line in _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).split("\n") if line.strip()]
        heard = Counter(lines)
        refrains = 3 * len(heard) >= len(lines)
        out: list[tuple[list[str], list[str]]] = []
        plain: list[int] = []
        for line in lines:
            # a refrain comes back as a whole line of verse; it counts as a keyword only where most lines come back
            refrain = refrains and heard[line] > 1 and len(line.split()) >= 4
            for segment in _SEGMENT.split(line) if "•" in line or "|" in line or "·" in line or "  " in line else (line,):
                tokens = segment.split()
                if not tokens:
                    continue
                signs = [""] * len(tokens)
                if _LINK_HINT.search(segment) and (links := _linked(segment, tokens)) is not None:
                    signs = links
                elif len(tokens) <= _PRODUCT and _PRICE.search(segment):
                    signs = [PRICED] * len(tokens)
                elif not refrain:
                    plain.append(len(out))
                if "#" in segment:
                    signs = [TAGGED if t[0] == "#" and len(t) > 1 else s for t, s in zip(tokens, signs)]
                out.append((tokens, signs))
        self._repeated([out[i] for i in plain])
        return out

    @staticmethod
    def _repeated(items: list[tuple[list[str], list[str]]]) -> None:
        """Sign the tokens of repeated pairs, and those of short items whose words keep coming back."""
        own = [[k for k, sign in enumerate(signs) if not sign] for _, signs in items]
        again = iter(repeats([tokens[k] for (tokens, _), ks in zip(items, own) for k in ks]))
        for (_, signs), ks in zip(items, own):
            for k in ks:
                if next(again):
                    signs[k] = REPEATED
        short = [[tokens[k] for k in ks] for (tokens, _), ks in zip(items, own)]
        short = [item if 0 < len(item) <= TAG_WORDS and item[-1][-1] not in ".!?…," and not _ENTRY.match(item[0]) else [] for item in short]
        if sum(map(bool, short)) >= TAG_REPEATS:
            for (_, signs), tag in zip(items, tagged(short)):
                if tag:
                    signs[:] = [s or TAGGED for s in signs]

    def __call__(self, text: str) -> tuple[bool, list[str], list[int]]:
        """(whether no token is signed, classes of each stretch of at most ``STRETCH`` tokens, its characters that print).

        A stretch lies in one item, and a short rest joins the stretch before it. The first stretch of an item begins with ``ITEM``.
        """
        prose, stretches, sizes = True, [], []
        for tokens, signs in self.items(text):
            prose = prose and not any(signs)
            named = [self.of(t) + s for t, s in zip(tokens, signs)]
            cuts = list(range(0, len(tokens), STRETCH))
            if len(cuts) > 1 and len(tokens) - cuts[-1] < STRETCH // 2:
                cuts.pop()
            for i, j in zip(cuts, [*cuts[1:], len(tokens)]):
                stretches.append((ITEM + " " if i == 0 else "") + " ".join(named[i:j]))
                sizes.append(sum(map(len, tokens[i:j])))
        return prose, stretches, sizes


def _linked(segment: str, tokens: list[str]) -> list[str] | None:
    """The signs of an item with links: of all tokens if few others stand there, else of links and of the few words before each that name it; none for a cited source."""
    rest = _LINK.sub(" ", segment)
    if _CITED.search(rest):
        return [""] * len(tokens)
    if len(rest.split()) <= _NAMED:
        return [""] * len(tokens) if _PLAIN_DOMAIN.match(segment) else [LINKED] * len(tokens)
    signs, since = [""] * len(tokens), 0
    for i, t in enumerate(tokens):
        if not _LINK_HINT.search(t):
            continue
        if since or "/" in t:
            signs[i] = LINKED
        if i - since <= _NAMED and not any(x[-1] in ".!?…" for x in tokens[since:i]):
            signs[since:i] = [LINKED] * (i - since)
        since = i + 1
    return signs if any(signs) else None


class Trigrams:
    """Interpolated class trigrams from their counts; unseen classes have a small floor."""

    def __init__(self, counts: dict[tuple[str, str, str], int]) -> None:
        self.three = counts
        self.one: Counter = Counter()
        self.two: Counter = Counter()
        self.before: Counter = Counter()
        self.before2: Counter = Counter()
        for (a, b, c), k in counts.items():
            self.one[c] += k
            self.two[b, c] += k
            self.before[b] += k
            self.before2[a, b] += k
        self.n = max(sum(self.one.values()), 1)
        self.cache: dict[tuple, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        """Bits of ``c`` after ``a`` and ``b``."""
        got = self.cache.get((a, b, c))
        if got is None:
            p = 0.6 * self.three.get((a, b, c), 0) / max(self.before2[a, b], 1) + 0.3 * self.two[b, c] / max(self.before[b], 1) + 0.1 * (self.one[c] + 0.5) / (self.n + 0.5 * (len(self.one) + 1))
            got = self.cache[a, b, c] = -math.log2(p)
        return got

    def bits(self, stretches: list[str]) -> list[float]:
        """Mean bits of the tokens of each stretch of a text, to a hundredth, so that equal ones are counted together."""
        out = []
        a = b = "^"
        for stretch in stretches:
            total, n = 0.0, 0
            for c in stretch.split(" "):
                if c != ITEM:
                    total += self.cost(a, b, c)
                    n += 1
                a, b = b, c
            out.append(round(total / max(n, 1), 2))
        return out


def trigrams_of(sequences: list[list[str]]) -> Counter:
    """How often each trigram stands in the stretches of texts."""
    out: Counter = Counter()
    for stretches in sequences:
        classes = " ".join(stretches).split(" ") if stretches else []
        out.update(zip(["^", "^", *classes], ["^", *classes], classes))
    return out


_CLASSES: dict[frozenset[str], Classes] = {}


def _sequences(common: frozenset[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = _CLASSES.setdefault(common, Classes(common))  # kept from task to task of a worker
    for batch in slices(batches):
        made = [classes(text) if text else (False, [], []) for text in batch.column("text").to_pylist()]
        prose, stretches, sizes = zip(*made)
        kinds = (pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip((prose, stretches, sizes), kinds))], names=["doc_id", "prose", "stretches", "sizes"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 5000):
        found = trigrams_of(batch.column("stretches").to_pylist())
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in found], pa.string()) for i in range(3)), pa.array(list(found.values()), pa.int64())], names=["a", "b", "c", "n"])


def sequences(documents: DataFrame, common: frozenset[str]) -> DataFrame:
    """Class sequences of every row of ``documents``, and whether it is prose: text without a signed token. Null, empty and blank texts have no stretch."""
    return documents.select("doc_id", "text").mapInArrow(partial(_sequences, common), SEQUENCES)


def fit(made: DataFrame) -> Trigrams:
    """The model of all prose of ``sequences``; of its trigrams those at least as frequent as ``RAREST`` come to the driver."""
    counted = stage(made.where("prose and size(stretches) > 0").select("stretches").mapInArrow(_counts, "a string, b string, c string, n bigint").groupBy("a", "b", "c").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = counted.where(F.col("n") >= math.ceil(RAREST * total)).collect()
    return Trigrams({(r["a"], r["b"], r["c"]): r["n"] for r in rows})


def _measure(model):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Trigrams = model.value
        for batch in slices(batches):
            bits = [own.bits(s) for s in batch.column("stretches").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "prose", "sizes")), pa.array(bits, pa.list_(pa.float64()))], names=["doc_id", "prose", "sizes", "bits"])

    return measure


def prose_bounds(measured: DataFrame) -> tuple[float, float] | None:
    """The bits between which the stretches of all prose documents lie but for ``TAIL`` at either end, as exact quantiles; none without prose."""
    values = measured.where("prose").select(F.lit("prose").alias("grp"), F.lit("bits").alias("stat"), F.explode("bits").alias("value"))
    # outwards, so that of few stretches none is abnormal
    at = [F.floor(F.lit(TAIL) * (F.col("n") - 1)), F.ceil(F.lit(1 - TAIL) * (F.col("n") - 1))]
    holds = [(F.col("below") <= k) & (k < F.col("upto")) for k in at]
    ends = sorted(r["value"] for r in exact_ranks(values).where(holds[0] | holds[1]).select("value").collect())
    return (ends[0], ends[-1]) if ends else None


def scores(made: DataFrame, model: Trigrams) -> DataFrame:
    """Characters that print, perplexity and share of abnormal text of every row of ``sequences``.

    Null, empty and blank texts have no perplexity and nothing abnormal; repeated rows stay repeated; other columns are not read.
    Where no document is prose, or the model has seen none, all text is abnormal.
    """
    shared = made.sparkSession.sparkContext.broadcast(model)
    measured = stage(made.mapInArrow(_measure(shared), "doc_id bigint, prose boolean, sizes array<bigint>, bits array<double>"))
    bounds = prose_bounds(measured) if model.one else None
    low, high = bounds or (math.inf, -math.inf)
    pairs = F.arrays_zip("sizes", "bits")
    outside = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda n, s: n + F.when((s["bits"] < low) | (s["bits"] > high), s["sizes"]).otherwise(0))
    chars = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda n, s: n + s)
    bits = F.aggregate(pairs, F.lit(0.0), lambda n, s: n + s["bits"] * s["sizes"])
    return measured.select("doc_id", chars.alias("chars"), F.try_divide(outside, F.greatest(chars, F.lit(1))).alias("abnormal"), F.pow(F.lit(2.0), F.try_divide(bits, chars)).alias("perplexity"))


def stuffed(scored: DataFrame) -> DataFrame:
    """``doc_id`` of the documents of which more than ``SPAM_SHARE`` is abnormal."""
    return scored.where(F.col("abnormal") > SPAM_SHARE).select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stage(sequences(table(spark, sf_dir, "documents"), common_keys(table(spark, sf_dir, "common_words"))))
    return scores(made, fit(made))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed(p8_scores(spark, sf_dir))
