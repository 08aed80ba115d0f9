"""Problem 6: encode texts with a public byte-level BPE tokenizer by replaying its merges over a corpus.

The texts of a slice of the corpus are cut into words by the tokenizer's pattern, and their distinct words
are encoded together: an inverted index leads from each adjacent pair of tokens to the words
and places where it stands; the pairs are taken in rank order from a heap, each merge is applied to all its places at once, and
only the touched neighbours enter the index again. Merges never cross words, so a slice is as exact as the
whole corpus and no text has to be shuffled. Words already encoded in the same slice are kept.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.ragged import slices
from leafmill.plans.staging import table

#: Where the vocabularies of the public tokenizers lie for the driver.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_KEPT = 400_000
_SHARED: dict[tuple[str, str], Broadcast] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, which are their merge ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def shared_ranks(spark: SparkSession, tokenizers: str, vocabulary: str) -> Broadcast:
    """The ranks of a vocabulary that the driver reads, sent to the executors once; some 50,000 entries."""
    key = (spark.sparkContext.applicationId, f"{tokenizers}/{vocabulary}")
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(load_ranks(key[1]))
    return _SHARED[key]


def replay(words: list[str], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of distinct ``words``: every merge in rank order, over all words at once."""
    # one long row of tokens; nxt and prv link the live places of a word, -1 is a word's border
    tokens: list[bytes] = []
    nxt: list[int] = []
    prv: list[int] = []
    heads: list[int] = []
    singles = [bytes([b]) for b in range(256)]
    for word in words:
        data = word.encode("utf-8")
        start = len(tokens)
        heads.append(start)
        tokens.extend([singles[b] for b in data])
        n = len(data)
        prv.extend(range(start - 1, start + n - 1))
        nxt.extend(range(start + 1, start + n + 1))
        if n:
            prv[start] = -1
            nxt[-1] = -1
    where: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
    for i, j in enumerate(nxt):
        if j >= 0:
            where[tokens[i], tokens[j]].append(i)
    heap = [(rank, pair) for pair in where if (rank := ranks.get(pair[0] + pair[1])) is not None]
    heapq.heapify(heap)
    queued = {pair for _, pair in heap}
    while heap:
        _, pair = heapq.heappop(heap)
        queued.discard(pair)
        left, right = pair
        merged = left + right
        touched = []
        for i in sorted(where.pop(pair)):
            j = nxt[i]
            if j < 0 or tokens[i] != left or tokens[j] != right:
                continue  # the place was used by an earlier merge
            tokens[i] = merged
            tokens[j] = b""
            k = nxt[i] = nxt[j]
            nxt[j] = -1
            if k >= 0:
                prv[k] = i
                touched.append(i)
            if prv[i] >= 0:
                touched.append(prv[i])
        for i in touched:
            j = nxt[i]
            if j < 0:
                continue
            new = (tokens[i], tokens[j])
            where[new].append(i)
            if new not in queued and (rank := ranks.get(new[0] + new[1])) is not None:
                queued.add(new)
                heapq.heappush(heap, (rank, new))
    out = []
    for word, at in zip(words, heads):
        ids = []
        if word:
            while at >= 0:
                ids.append(ranks[tokens[at]])
                at = nxt[at]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts of one task, keeping the ids of words it has met; bounded."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def _cut(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        if len(self.known) > _KEPT:
            self.known.clear()
        cuts = [self.cut(text) if text else [] for text in texts]
        new = [w for w in set().union(*cuts) if w not in self.known]
        for word, ids in zip(new, replay(new, self.ranks)):
            self.known[word] = ids
        return cuts

    def __call__(self, texts: list[str]) -> list[list[list[int]]]:
        """The ids of each word of each text."""
        known = self.known
        cuts = self._cut(texts)
        return [[known[w] for w in words] for words in cuts]


    def cut_and_count(self, texts: list[str]) -> list[tuple[Counter, int]]:
        """The words of each text with their counts, and its number of tokens."""
        cuts = self._cut(texts)
        bags = [Counter(words) for words in cuts]
        return [(bag, sum(n * len(self.known[w]) for w, n in bag.items())) for bag in bags]


def _encode(ranks: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(ranks.value)
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        ids: list[int] = []
        offsets = [0]
        for words in encoder(texts):
            for w in words:
                ids += w
            offsets.append(len(ids))
        values = pa.array(np.array(ids, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["doc_id", "ids"])


def _count(ranks: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(ranks.value)
    for batch in slices(batches):
        n = [sum(map(len, words)) for words in encoder(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "tokens"])


def encode(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``documents``; null and empty texts give an empty list, never null.

    Whole texts are encoded, without special tokens; the strings of special tokens are ordinary text. Repeated rows stay
    repeated; other columns are not read. A vocabulary that lacks a single byte is refused.
    """
    return documents.select("doc_id", "text").mapInArrow(partial(_encode, shared_ranks(documents.sparkSession, tokenizers, vocabulary)), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``text`` and the number of its ``tokens``; null and empty texts have none."""
    return documents.select("doc_id", "text").mapInArrow(partial(_count, shared_ranks(documents.sparkSession, tokenizers, vocabulary)), "doc_id bigint, text string, tokens bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def _decode(ranks: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = {i: t for t, i in ranks.value.items()}
    for batch in batches:
        texts = [b"".join(tokens[i] for i in ids).decode("utf-8") for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and the ``text`` that each list of ``ids`` stands for; an empty list gives ''."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, shared_ranks(encoded.sparkSession, tokenizers, vocabulary)), "doc_id bigint, text string")


SQL = {"p6_round_trip": "select doc_id, coalesce(text, '') as text from documents"}


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; null texts come out as ''."""
    return decode(p6_ids(spark, sf_dir))
