"""Problem 5: languages of books, pages and blocks.

A page is a mixture of languages. Character trigram models give every word a likelihood under each
language; expectation-maximisation estimates the page's proportions, for all pages of an Arrow batch at once, and a
language stays in the page's set only if its share raises the penalised likelihood. A block's
language is its most probable one under the page's mixture, with that probability as confidence.

The models are fitted on a bounded sample of labelled pages (``SAMPLE_PAGES``, those with the smallest hash), first by
the labels as they are, then again by the languages the first models give. Everything else reads all pages.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import glyphs
from leafmill.llm.boilerplate import page_counts, repeated_templates
from leafmill.llm.pagelines import Words, key_tokens, kind_of, template_paths
from leafmill.llm.ragged import rows, slices
from leafmill.plans.staging import hashed_sample, small, stage, table

# The languages and other spellings of their labels.
LANGUAGES = ("uzb", "uzb_cyrl", "rus", "eng")
ALIASES = {"uz": "uzb", "uz_latn": "uzb", "uz_cyrl": "uzb_cyrl", "ru": "rus", "en": "eng", "uzb_latn": "uzb"}

SAMPLE_PAGES = 3000
ROUNDS = 8
#: A language's log likelihood gain must exceed this many times the logarithm of the page's words.
PENALTY = 2.0
MIN_BLOCK_LETTERS = 60
#: Mean log likelihood of a trigram below which a page's lines are examined for junk.
DOUBTFUL = -5.0
#: Characters of a page of the sample.
SAMPLE_CHARS = (100, 20_000)
#: Type of what stands in for the blocks of a page that has only words.
WORDS = "WORDS"
_LIMIT = 400_000

BLOCKS = "project string, pos int, b int, type string, letters int, lang string, confidence double, single boolean, junk int, lines int, key string, tokens int, path long, front long, back long"


def named_language(label: Column) -> Column:
    """The first language that a label names; null where it names none."""
    first = F.lower(F.trim(F.substring_index(F.coalesce(label, F.lit("")), "+", 1)))
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.when(first.isin(*LANGUAGES), first).otherwise(F.try_element_at(alias, first))


def book_labels(projects: DataFrame) -> DataFrame:
    """(project, label) of each book's latest row: ``language``, or ``detected_language`` where that is ``auto``.

    Of rows with one ``updated_at`` a row that names a language wins, then the greater label; rows without id are left out.
    """
    counts = F.when(F.lower(F.trim("language")) == "auto", F.col("detected_language")).otherwise(F.col("language"))
    label = named_language(counts)
    return projects.where("id is not null").groupBy(F.col("id").alias("project")).agg(F.max(F.struct("updated_at", label.alias("label"))).getField("label").alias("label"))


class Trigrams:
    """Log probabilities of character trigrams of words by language."""

    def __init__(self, samples: dict[str, Counter]) -> None:
        counts: list[Counter] = []
        for language in LANGUAGES:
            grams: Counter = Counter()
            for word, n in samples.get(language, {}).items():
                for g in self.grams(word):
                    grams[g] += n
            counts.append(grams)
        seen = set().union(*counts)
        size = [sum(c.values()) + 0.05 * len(seen) + 1 for c in counts]
        self.known = {g: tuple(math.log((c[g] + 0.05) / s) for c, s in zip(counts, size)) for g in seen}
        self.unseen = tuple(math.log(0.05 / s) if sum(c.values()) else -14.0 for c, s in zip(counts, size))

    @staticmethod
    def grams(word: str) -> list[str]:
        w = f"  {word} "
        return [w[i : i + 3] for i in range(len(w) - 2)]

    def score(self, word: str) -> list[float]:
        total = [0.0] * len(LANGUAGES)
        for g in self.grams(word):
            for i, v in enumerate(self.known.get(g, self.unseen)):
                total[i] += v
        return total


def bare(t: str) -> str:
    """A word's letters in small print form, in one script; '' if it has none."""
    return "".join(c for c in glyphs.script_form(t).lower() if c.isalpha() or c == glyphs.TURNED_COMMA)


def fit(texts: list[tuple[str, str]], seeds: list[tuple[str, str]] = ()) -> Trigrams:
    """Models from (label, text), fitted again by the languages that the first models give to each text.

    ``seeds`` are (language, words) that are known to be right; they keep a language in reach that few or no labels name.
    """
    bags = [(label, Counter(b for t in text.split() if (b := bare(t)))) for label, text in texts]
    known: dict[str, list[float]] = {}
    model = None
    for _ in range(2):
        samples: dict[str, Counter] = {language: Counter() for language in LANGUAGES}
        for language, words in seeds:
            if language in samples:
                samples[language].update(b for t in words.split() if (b := bare(t)))
        for label, bag in bags:
            if model is not None:
                for word in bag:
                    if word not in known:
                        known[word] = model.score(word)
                best = max(range(len(LANGUAGES)), key=lambda i: sum(n * known[w][i] for w, n in bag.items()))
                label = LANGUAGES[best]
            samples[label].update(bag)
        model, known = Trigrams(samples), {}
    return model


def _texts(blocks: Column) -> Column:
    return F.transform(blocks, lambda k: F.concat_ws("", F.transform(F.coalesce(k["spans"], F.array()), lambda s: s["text"])))


def seed_words(*tables: DataFrame) -> list[tuple[str, str]]:
    """(language, words) of lists (lang, word) that do not grow; more than 100,000 rows are refused."""
    out = []
    for t in tables:
        rows_ = t.where("lang is not null and word is not null").select("lang", "word").limit(100_001).collect()
        if len(rows_) > 100_000:
            raise ValueError("a list of seeds is meant to be short")
        out += [(r["lang"], r["word"]) for r in rows_]
    return out


def fit_on(pages: DataFrame, seeds: list[tuple[str, str]] = ()) -> Trigrams:
    """Models from at most ``SAMPLE_PAGES`` labelled pages, and ``seeds``."""
    label = named_language(F.col("language"))
    sample = hashed_sample(pages.select("project", "pos", "language", "blocks"), ["project", "pos"], SAMPLE_PAGES)
    texts = sample.select(label.alias("label"), F.array_join(_texts(F.col("blocks")), " ").alias("text")).where(F.col("label").isNotNull() & F.length("text").between(*SAMPLE_CHARS))
    return fit([(r["label"], r["text"]) for r in texts.collect()], seeds)


def mixture(scores: np.ndarray, page: np.ndarray, weight: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, allowed) of each page from its words' log likelihoods, by EM with backward selection of languages."""
    k = scores.shape[1]
    allowed = np.ones((pages, k), bool)
    shares = np.full((pages, k), 1.0 / k)
    total = np.maximum(np.bincount(page, weight, pages), 1e-9)

    def run(shares: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            r = scores + np.log(np.maximum(shares, 1e-12))[page]
            r -= r.max(1, keepdims=True)
            np.exp(r, r)
            r *= (weight / r.sum(1))[:, None]
            shares = np.stack([np.bincount(page, r[:, i], pages) for i in range(k)], 1) / total[:, None]
        return shares

    def likelihood(shares: np.ndarray) -> np.ndarray:
        r = scores + np.log(np.maximum(shares, 1e-12))[page]
        top = r.max(1)
        return np.bincount(page, top + np.log(np.exp(r - top[:, None]).sum(1)), pages)

    shares = run(shares, ROUNDS)
    price = PENALTY * np.log(np.bincount(page, minlength=pages) + 2.0)
    for _ in range(k - 1):
        least = np.where(allowed, shares, np.inf).argmin(1)
        at = np.arange(pages)
        without = shares.copy()
        without[at, least] = 0
        without /= np.maximum(without.sum(1, keepdims=True), 1e-9)
        without = run(without, 2)
        drop = (allowed.sum(1) > 1) & (likelihood(shares) - likelihood(without) < price)
        if not drop.any():
            break
        allowed[at[drop], least[drop]] = False
        shares[drop] = without[drop]
    return shares, allowed


def _infer(model):
    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams: Trigrams = model.value
        words = Words()
        ids: dict[str, int] = {}
        scores: list[list[float]] = []
        letters: list[int] = []
        grams: list[int] = []

        def word_id(t: str) -> int:
            b = bare(t)
            scores.append(trigrams.score(b) if b else [0.0] * len(LANGUAGES))
            letters.append(len(b) - b.count(glyphs.TURNED_COMMA))
            grams.append(len(b) + 1 if b else 0)
            ids[t] = len(scores) - 1
            return ids[t]

        for batch in slices(batches):
            if len(ids) > _LIMIT:
                ids.clear(), scores.clear(), letters.clear(), grams.clear()
            found = list(rows(batch, ("texts", "types"), ("project", "pos")))
            at, page_of, block_of, blocks = [], [], [], []
            for p, (_, _, texts, types) in enumerate(found):
                for b, (text, kind) in enumerate(zip(texts, types)):
                    own = [ids[t] if t in ids else word_id(t) for t in (text or "").split()]
                    at += own
                    page_of += [p] * len(own)
                    block_of += [len(blocks)] * len(own)
                    blocks.append((p, b, kind, text or ""))
            if not blocks:
                continue
            index, page, block = np.array(at, np.int64), np.array(page_of, np.int64), np.array(block_of, np.int64)
            table_ = np.array(scores).reshape(-1, len(LANGUAGES))
            ll = table_[index]
            size = np.array(letters, np.int64)[index]
            n = np.array(grams, np.int64)[index]
            keep = n > 0
            shares, _ = mixture(ll[keep], page[keep], size[keep].astype(float), len(found))
            block_ll = np.stack([np.bincount(block, ll[:, i], len(blocks)) for i in range(len(LANGUAGES))], 1)
            block_letters = np.bincount(block, size, len(blocks)).astype(int)
            posterior = block_ll + np.log(np.maximum(shares, 1e-12))[[b[0] for b in blocks]]
            best = posterior.argmax(1)
            posterior -= posterior.max(1, keepdims=True)
            confidence = 1 / np.exp(posterior).sum(1)
            page_n = np.maximum(np.bincount(page, n, len(found)), 1)
            mean = np.stack([np.bincount(page, ll[:, i], len(found)) for i in range(len(LANGUAGES))], 1).max(1) / page_n
            doubtful = (mean < DOUBTFUL) | (np.bincount(page, size, len(found)) < 40)
            out = []
            for i, (p, b, kind, text) in enumerate(blocks):
                project, pos = found[p][:2]
                at = -9 if pos is None else pos
                single = "\n" not in text.strip()
                key, paths, tokens = "", (0, 0, 0), []
                kinds = [k for line in text.split("\n") if line.strip() and (k := kind_of([words(t) for t in line.split()], at)) != "page"] if doubtful[p] else []
                if single and block_letters[i]:
                    tokens = key_tokens([words(t) for t in text.split()], at)
                    key, paths = " ".join(tokens), template_paths(project, tokens) if tokens else (0, 0, 0)
                out.append((project, pos, b, kind, int(block_letters[i]), LANGUAGES[best[i]] if block_letters[i] else None, float(confidence[i]) if block_letters[i] else 0.0, single, kinds.count("junk"), len(kinds), key, len(tokens), *paths))
            kinds_ = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return infer


def block_languages(pages: DataFrame, model: Trigrams) -> DataFrame:
    """One row per block of ``pages``: language, confidence, letters; null texts count as ''; blocks without letters get a null language.

    The words of a page whose blocks hold no text stand in as one block of type ``WORDS``. A block of one line also gets its template paths, so that repeated lines can be told; on pages that no model likes its lines and its junk lines are counted.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    texts = F.coalesce(_texts(F.col("blocks")), F.array().cast("array<string>"))
    bare = ~F.exists(texts, lambda t: F.trim(t) != "") & (F.size("words") > 0)
    words = F.array_join(F.transform("words", lambda w: F.coalesce(w["t"], F.lit(""))), " ")
    return pages.select("project", "pos", F.when(bare, F.array(words)).otherwise(texts).alias("texts"), F.when(bare, F.array(F.lit(WORDS))).otherwise(F.col("blocks")["type"]).alias("types")).mapInArrow(_infer(shared), BLOCKS)


class Languages:
    """Languages of one run over ``pages`` and ``projects``."""

    def __init__(self, pages: DataFrame, projects: DataFrame, seeds: list[tuple[str, str]] = ()) -> None:
        self.pages, self.projects = pages, projects
        blocks = stage(block_languages(pages, fit_on(pages, seeds)))
        lines = blocks.where("single and tokens > 0").withColumn("kind", F.lit("prose"))
        repeated = small(repeated_templates(lines, page_counts(pages)))
        marked = blocks.join(repeated.withColumn("repeated", F.lit(True)), "path", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
        self.blocks = stage(marked.select("project", "pos", F.col("b").alias("block_idx"), "type", "letters", "lang", "confidence", "junk", "lines", "repeated").distinct())
        self.page_rows = stage(self._pages())

    def _pages(self) -> DataFrame:
        """(project, pos, lang, confidence, declared): language of most letters outside repeated lines, of any where all are repeated."""
        own = lambda c: F.sum(F.when(~F.col("repeated"), F.col(c)).otherwise(0))
        by_lang = self.blocks.groupBy("project", "pos", "lang").agg(own("letters").alias("own"), F.sum("letters").alias("all"), own("junk").alias("junk"), own("lines").alias("lines"))
        top = by_lang.groupBy("project", "pos").agg(F.max_by("lang", F.when(F.col("lang").isNotNull(), F.struct("own", "all", "lang"))).alias("lang"), F.max("own").alias("most"), F.sum("own").alias("sum"), (2 * F.sum("junk") > F.sum("lines")).alias("junk"))
        declared = self.pages.select("project", "pos", "language").distinct().select("project", "pos", named_language(F.col("language")).alias("declared"))
        return top.where("not junk and lang is not null").join(declared, ["project", "pos"]).select("project", "pos", "lang", F.coalesce(F.try_divide("most", "sum"), F.lit(0.0)).alias("confidence"), "declared")

    def books(self) -> DataFrame:
        """(project, lang, confidence, declared): the language of most pages."""
        n = self.page_rows.groupBy("project", "lang").agg(F.count("*").alias("n"))
        top = n.groupBy("project").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), (F.max("n") / F.sum("n")).alias("confidence"))
        return top.join(book_labels(self.projects).withColumnRenamed("label", "declared"), "project")

    def foreign_blocks(self) -> DataFrame:
        pages = self.page_rows.select("project", "pos", F.col("lang").alias("main"))
        return self.blocks.where(f"type = 'PARAGRAPH' and letters >= {MIN_BLOCK_LETTERS} and not repeated").join(pages, ["project", "pos"]).where("lang <> main")


def _run(spark: SparkSession, sf_dir: str) -> Languages:
    seeds = seed_words(table(spark, sf_dir, "common_words"), table(spark, sf_dir, "lexicon").withColumnRenamed("term", "word"))
    return Languages(table(spark, sf_dir, "ocr_page"), table(spark, sf_dir, "project"), seeds)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    wrong = "declared is null or declared <> lang"
    none = F.lit(-1)
    books = run.books().where(wrong).select("project", none.alias("pos"), none.alias("block_idx"), "lang")
    pages = run.page_rows.where(wrong).select("project", "pos", none.alias("block_idx"), "lang")
    return books.unionByName(pages).unionByName(run.foreign_blocks().select("project", "pos", "block_idx", "lang")).distinct()


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every book, page and block; ``pos`` and ``block_idx`` are -1 where they do not apply."""
    run = _run(spark, sf_dir)
    none = F.lit(-1)
    books = run.books().select("project", none.alias("pos"), none.alias("block_idx"), "lang", "confidence")
    pages = run.page_rows.select("project", "pos", none.alias("block_idx"), "lang", "confidence")
    return books.unionByName(pages).unionByName(run.blocks.where(f"lang is not null and coalesce(type, '') <> '{WORDS}'").select("project", "pos", "block_idx", "lang", "confidence"))
