"""Problem 7: fill containers of fixed capacity with documents, measured in tokens.

Each slice of the corpus is a shard with its own BM25 index: postings of every term of its documents.
The largest unused document seeds a container; the index ranks all its unused lexical neighbours, and the best that
fits goes in until none does; what room is left takes the largest unused documents that still fit.
A shard never leaves its task, so nothing is shuffled but the rests: containers that a shard leaves poorly
filled are packed once more, together with those of other shards and with an index of their own.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.bpe import TOKENIZERS, VOCABULARY, Encoder, shared_ranks
from leafmill.plans.staging import stage, table

#: Documents and characters of a shard; what is beyond goes into the next shard of the same task.
SHARD_DOCUMENTS, SHARD_CHARS = 4000, 12_000_000
#: Tokens of the rests that are packed together.
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
#: A term is dense if more than one document in so many has it.
DENSE = 32
#: Containers filled less than this are opened again and packed with those of other shards.
WELL_FILLED = 0.97

ITEMS = "container string, capacity int, bin string, place int, doc_id bigint, part int, tokens bigint"
_ARROW = pa.schema([("container", pa.string()), ("capacity", pa.int32()), ("bin", pa.string()), ("place", pa.int32()), ("doc_id", pa.int64()), ("part", pa.int32()), ("tokens", pa.int64())])


class Index:
    """BM25 over the documents of one shard; terms are the words that the tokenizer's pattern cuts.

    Terms of many documents are columns of one dense matrix, so that their part of all scores is a product of matrices; the
    others have postings. A query is the set of a document's terms.
    """

    def __init__(self, bags: list[Counter]) -> None:
        lengths = np.array([sum(b.values()) for b in bags], float)
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if len(bags) else 1.0, 1.0))
        where: dict[str, list[int]] = {}
        often: dict[str, list[int]] = {}
        for d, bag in enumerate(bags):
            for term, n in bag.items():
                if term in where:
                    where[term].append(d)
                    often[term].append(n)
                else:
                    where[term] = [d]
                    often[term] = [n]
        n_docs = len(bags)
        self.bags = bags
        self.idf = {t: math.log(1 + (n_docs - len(p) + 0.5) / (len(p) + 0.5)) for t, p in where.items()}
        self.postings = {}
        dense = [t for t, p in where.items() if len(p) > max(n_docs // DENSE, 8)]
        weights, asked = (np.zeros((len(dense), n_docs), np.float32) for _ in range(2))
        for term, docs in where.items():
            if len(docs) > 1:  # a term of one document leads nowhere
                at, n = np.array(docs), np.array(often[term], float)
                self.postings[term] = (at, self.idf[term] * n * (K1 + 1) / (n + norm[at]))
        for k, term in enumerate(dense):
            at, weight = self.postings.pop(term)
            weights[k, at], asked[k, at] = weight, 1.0
        # by seed: what the dense terms give to every document
        self.dense = asked.T @ weights

    def ranked(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All ``unused`` documents that share a term with ``seed``, by falling score under all of its terms; ties by place."""
        found = [self.postings[t] for t in self.bags[seed] if t in self.postings]
        score = self.dense[seed].astype(float)
        if found:
            score += np.bincount(np.concatenate([at for at, _ in found]), np.concatenate([weight for _, weight in found]), len(self.bags))
        near = np.flatnonzero(unused & (score > 0))
        near = near[near != seed]
        return near[np.argsort(-score[near], kind="stable")]


def pack(sizes: list[int], capacity: int, neighbours) -> list[list[int]]:
    """Containers of items: each holds at most ``capacity``; every item of 1 to ``capacity`` tokens is in exactly one."""
    size_of = np.array(sizes, int)
    unused = (size_of > 0) & (size_of <= capacity)
    left = sorted((s, i) for i, s in enumerate(sizes) if 0 < s <= capacity)
    gone = set()
    bins = []
    while left:
        size, seed = left.pop()
        if seed in gone:
            gone.discard(seed)
            continue
        unused[seed] = False
        content, room = [seed], capacity - size
        fits = unused & (size_of <= room)
        near = np.array(neighbours(seed, fits) if fits.any() else (), int)
        while len(near):
            i = int(near[0])
            content.append(i)
            room -= sizes[i]
            unused[i] = False
            gone.add(i)
            near = near[1:][size_of[near[1:]] <= room]
        while room and left:
            at = bisect_right(left, (room, len(sizes)))
            while at and left[at - 1][1] in gone:
                gone.discard(left.pop(at - 1)[1])
                at -= 1
            if not at:
                break
            s, i = left.pop(at - 1)
            content.append(i)
            room -= s
            unused[i] = False
        bins.append(content)
    return bins


def _rows(capacities: list[tuple[str, int]], name: str, docs: list[tuple[int, int]], near) -> list[tuple]:
    """Rows of one shard: whole containers of documents above a capacity, and packed containers."""
    out = []
    for container, capacity in capacities:
        sizes, owner = [], []
        for d, (doc_id, tokens) in enumerate(docs):
            full, rest = divmod(tokens, capacity) if tokens > capacity else (0, tokens)
            out += [(container, capacity, f"{name}-d{d}-{k}", 0, doc_id, k, capacity) for k in range(full)]
            sizes.append(rest)
            owner.append((doc_id, full, tokens == 0))
        # documents without tokens need no room: they have a container of their own, so that every document has a row
        out += [(container, capacity, f"{name}-empty", 0, doc_id, 0, 0) for doc_id, _, empty in owner if empty]
        for k, content in enumerate(pack(sizes, capacity, near)):
            out += [(container, capacity, f"{name}-{k}", place, owner[i][0], owner[i][1], sizes[i]) for place, i in enumerate(content)]
    return out


def _shards(ranks: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]], Index]]:
    encoder = Encoder(ranks.value)
    part, count = TaskContext.get().partitionId(), itertools.count().__next__
    docs: list[tuple[int, int]] = []
    bags: list[Counter] = []
    chars = 0

    def done():
        # named by the slice, so that a repeated task gives the same names
        return f"s{part}.{count()}", docs, Index(bags)

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for k in range(0, len(texts), 500):
            for doc_id, text, words in zip(ids[k : k + 500], texts[k : k + 500], encoder.cut_and_count(texts[k : k + 500])):
                docs.append((doc_id, words[1]))
                bags.append(words[0])
                chars += len(text or "")
            if len(docs) >= SHARD_DOCUMENTS or chars >= SHARD_CHARS:
                yield done()
                docs, bags, chars = [], [], 0
    if docs:
        yield done()


def _pack(ranks: Broadcast, capacities: list[tuple[str, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, docs, index in _shards(ranks, batches):
        out = _rows(capacities, name, docs, index.ranked)
        if not out:
            continue
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)


def _repack(ranks: Broadcast):
    def repack(group: pa.Table) -> pa.Table:
        """Pack the items of poorly filled containers with an index of their texts; the group is bounded by its salt."""
        items = sorted(zip(*(group.column(c).to_pylist() for c in ("doc_id", "part", "tokens", "text"))), key=lambda x: x[:3])
        container, capacity, salt = (group.column(c)[0].as_py() for c in ("container", "capacity", "salt"))
        index = Index([bag for bag, _ in Encoder(ranks.value).cut_and_count([text for *_, text in items])])
        out = []
        for k, content in enumerate(pack([x[2] for x in items], capacity, index.ranked)):
            out += [(container, capacity, f"r{salt}-{k}", place, *items[i][:3]) for place, i in enumerate(content)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return repack


def fill(documents: DataFrame, containers: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of a document and container kind: its ``bin``, its ``place`` there and its ``tokens``.

    A document longer than a capacity gives full containers of its first tokens and one piece of the rest; every other document is one piece.
    Null and empty texts have no tokens and go to a container that holds only such; repeated rows are packed as often as they stand.
    ``containers`` is a short list: rows without a positive capacity are left out, and more than 1,000 are refused.
    """
    kinds = [(r["container"], r["capacity"]) for r in containers.where("capacity > 0").select("container", "capacity").distinct().orderBy("capacity", "container").limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("containers is meant to be a short list")
    ranks = shared_ranks(documents.sparkSession, tokenizers, vocabulary)
    packed = stage(documents.select("doc_id", "text").mapInArrow(partial(_pack, ranks, kinds), ITEMS))
    bins = packed.where("tokens > 0").groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("filled"), F.count("*").alias("pieces"))
    poor = bins.where(F.col("filled") < WELL_FILLED * F.col("capacity"))
    n = poor.groupBy("container", "capacity").agg(F.sum("pieces").alias("n"), F.sum("filled").alias("tokens"))
    salts = {(r["container"], r["capacity"]): max(1, math.ceil(r["n"] / SHARD_DOCUMENTS), math.ceil(r["tokens"] / SHARD_TOKENS)) for r in n.collect()}
    if not salts:
        return packed
    salt_of = F.coalesce(*[F.when((F.col("container") == c) & (F.col("capacity") == k), F.pmod(F.xxhash64("doc_id"), F.lit(m))) for (c, k), m in salts.items()], F.lit(0))
    key = ["container", "capacity", "bin"]
    again = packed.join(poor.select(*key), key, "left_semi").withColumn("salt", salt_of).select("container", "capacity", "salt", "doc_id", "part", "tokens")
    again = again.join(documents.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id", "left")
    return packed.join(poor.select(*key), key, "left_anti").unionByName(again.groupBy("container", "capacity", "salt").applyInArrow(_repack(ranks), ITEMS))


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container kind: number of bins, pieces and documents, and the share of the room that is filled."""
    items = p7_bins(spark, sf_dir).where("tokens > 0")
    bins = items.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("filled"), F.count("*").alias("pieces"), F.max("part").alias("parts"))
    return bins.groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("pieces").alias("pieces"), (F.sum("filled") / (F.count("*") * F.col("capacity"))).alias("filled"), F.max("filled").alias("fullest"))


SQL = {
    "p7_checks": "select container, capacity, (select count(*) from documents) as documents, cast(0 as bigint) as too_full, cast(0 as bigint) as split, cast(0 as bigint) as apart from containers",
}


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container kind what must hold of the bins: all documents are in, and no bin is too full, no document split that fits, none with its parts missing or double."""
    items = stage(p7_bins(spark, sf_dir))
    kind = ["container", "capacity"]
    bins = items.groupBy(*kind, "bin").agg(F.sum("tokens").alias("filled")).groupBy(*kind).agg(F.count_if(F.col("filled") > F.col("capacity")).alias("too_full"))
    docs = items.groupBy(*kind, "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("part").alias("last"), F.count_distinct("part").alias("parts"))
    held = docs.groupBy(*kind).agg(
        F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("split"),
        F.count_if((F.col("pieces") != F.col("last") + 1) | (F.col("parts") != F.col("pieces"))).alias("apart"),
    )
    return held.join(bins, kind).select(*kind, "documents", "too_full", "split", "apart")
