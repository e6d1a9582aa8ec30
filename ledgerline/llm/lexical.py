"""Ranked lexical search: document shards of CSR postings, integer impacts, dense accumulators.

One pass over the texts cuts them into shards, each a row with its documents' ids and lengths and the
postings of the asked terms as a compressed sparse matrix. The shards give the statistics of the
corpus. Then each shard's frequencies become integer impacts, once for all items; an item's score is
the sum of its terms' rows, added term by term to one dense array of the shard's documents. A task
keeps the best k of each item over its shards, and those meet in one ranking.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import parts, written

#: A shard's most documents, and about its most bytes of text.
SHARD_ROWS, SHARD_BYTES = 16_384, 16 << 20
#: About the most terms of the items that are searched in one pass; only so many are broadcast.
PASS_TERMS = 500_000
#: Scaling of weights, of frequencies and of lengths (fixed values).
WEIGHT, SCALE, LENGTH, SPREAD = 1000, 1_000_000_000, 8, 90

SHARD = "docs long, tokens long, ids array<long>, lengths array<int>, terms array<int>, starts array<long>, places array<int>, counts array<int>"
FOUND = "item_id long, doc_id long, score long"

#: A term, and the letters that are made lower case (fixed values).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes that belong to terms stay, A to Z in lower case; all others become blanks. In UTF-8 every byte
# of a character beyond ASCII is over 0x7F, so this cuts as the pattern over characters does.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """All terms of a UTF-8 text, in order."""
    return text.translate(TABLE).split() if text else []


class Shard:
    """Collects documents and turns them into one row of SHARD: postings by term, then document."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.ids, self.lengths, self.term, self.place, self.count, self.bytes = [], [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = terms_of(text)
        if words:
            for term, n in Counter(filter(None.__ne__, map(self.vocabulary.get, words))).items():
                self.term.append(term)
                self.place.append(len(self.ids))
                self.count.append(n)
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.bytes += len(text)

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_ROWS or self.bytes >= SHARD_BYTES

    def row(self) -> pa.RecordBatch:
        term, place, count = (np.array(x, "i4") for x in (self.term, self.place, self.count))
        order = np.lexsort((place, term))
        terms, first = np.unique(term[order], return_index=True)
        starts = np.append(first, len(term)).astype("i8")
        values = [len(self.ids), sum(self.lengths), self.ids, self.lengths, terms, starts, place[order], count[order]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])


def shards(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Rows of SHARD over all of docs (doc_id, text) that hold a term; postings of the vocabulary's terms only."""
    send = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(send.value)
        for batch in batches:
            for part in parts(batch, "text", 1024):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    shard.add(doc_id, text)
                    if shard.full:
                        yield shard.row()
                        shard = Shard(send.value)
        if shard.ids:
            yield shard.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SHARD)


def impacts(counts: np.ndarray, lengths: np.ndarray, weights: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """Integer impact of each posting: weight * (SCALE * tf div (1000 * tf + LENGTH * m))."""
    m = 100 - SPREAD + SPREAD * lengths * docs // tokens
    return weights * (SCALE * counts // (1000 * counts + LENGTH * m))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k highest scores above 0, ties to the smaller id; nothing but ties is sorted in full."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        least = scores[at[np.argpartition(-scores[at], k - 1)[:k]]].min()
        at = at[scores[at] >= least]
    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return ids[at], scores[at]


def search(docs: DataFrame, items: DataFrame, k: int = 10, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) the k documents with the highest score above 0.

    docs: (doc_id, text). Terms are runs of ASCII letters, digits and characters beyond ASCII, A to Z in
    lower case. A null or empty text has none, and such a document doesn't count; an item without
    terms finds nothing. Of equal scores the smaller doc_id ranks first; rows that repeat a doc_id are
    documents of their own, in the order in which they were read. Rows without doc_id count in the statistics but
    are not ranked. Texts of a repeated item_id are one item; a null item_id finds nothing. Other
    columns of both tables are left out.

    Items are searched in passes of about pass_terms terms, counted once an item and dealt out by a hash
    of item_id; only one pass's terms are broadcast. A pass reads the texts once. (An item that alone
    has more different terms is a pass of its own that is as large as the item.)
    """
    term = F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", *LETTERS), F.lit(TERM), F.lit(0))))
    asked = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), term.alias("term"))
    asked = written(asked.distinct(), "asked")
    passes = max(1, math.ceil(asked.count() / pass_terms))
    found = [one_pass(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i), k) for i in range(passes)]
    ordered = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def one_pass(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best k documents of each item in each task's shards; items: (item_id, term), distinct."""
    asked: dict[int, set[bytes]] = {}
    for item, term in items.collect():
        asked.setdefault(item, set()).add(term.encode())
    vocabulary = {term: i for i, term in enumerate(sorted(set().union(*asked.values())))}
    index = written(shards(docs, vocabulary), "shards")
    # df of a term: a shard's postings of it, added up; at most one row a term of this pass comes back.
    spans = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.get("starts", i + 1) - F.get("starts", i)).alias("df")))
    df = index.select(F.explode(spans).alias("s")).groupBy("s.term").agg(F.sum("s.df").alias("df")).collect()
    n, total = index.agg(F.sum("docs"), F.sum("tokens")).first()
    weights = np.zeros(len(vocabulary), "i8")
    for term, holding in df:
        weights[term] = math.floor(WEIGHT * math.log((2 * n + 2) / (2 * holding + 1)))
    queries = [(item, np.array(sorted(vocabulary[t] for t in terms), "i4")) for item, terms in sorted(asked.items())]
    send = docs.sparkSession.sparkContext.broadcast((queries, weights, n, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n, total = send.value
        none = np.zeros(0, "i8")
        top = {item: (none, none) for item, _ in queries}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms, starts, places, counts = (batch.column(c)[row].values for c in ("ids", "lengths", "terms", "starts", "places", "counts"))
                ranked = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                lengths, terms, starts, places, counts = (x.to_numpy().astype("i8") for x in (lengths, terms, starts, places, counts))
                impact = impacts(counts, lengths[places], np.repeat(weights[terms], np.diff(starts)), n, total)
                for item, wanted in queries:
                    scores = np.zeros(len(ids), "i8")
                    at = np.searchsorted(terms, wanted)
                    for t, want in zip(at.tolist(), wanted.tolist(), strict=True):
                        if t < len(terms) and terms[t] == want:  # a document stands once in a term's row
                            scores[places[starts[t] : starts[t + 1]]] += impact[starts[t] : starts[t + 1]]
                    scores[~ranked] = 0
                    more = best(scores, ids, k)
                    held = top[item]
                    top[item] = best(np.concatenate([held[1], more[1]]), np.concatenate([held[0], more[0]]), k)
        for item, (found, scores) in top.items():
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item, "i8")), pa.array(found), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, FOUND)
