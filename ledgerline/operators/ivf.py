"""Approximate vector search: inverted cells, product-quantised residuals, few cells probed.

A sample fits the cells' centres and, for what is left of a vector beside its centre, a small codebook
for each stretch of dimensions. Every row is then indexed: it lies in the cell of its nearest centre, as
one byte a stretch beside the vector itself. A query looks into its nearest cells only, adds up table
entries by the rows' bytes there, and scores the best of each block in full. How many cells are probed
is measured on the sample: as many as hold the wanted share of true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.vectors import matrix
from ledgerline.sources.scratch import written

#: Rows that fit the index at most, and rows of it that are asked to find out how many cells to probe.
SAMPLE_ROWS, ASKED_ROWS = 16_384, 512
#: Cells at most, rows of the sample a cell, dimensions a code stands for, and rounds of refinement.
MOST_CELLS, ROWS_A_CELL, STRETCH, ROUNDS = 4096, 32, 4, 12
#: Share of true neighbours that the probed cells hold, rows a block, queries a block, and rows of a block that are scored in full.
COVER, BLOCK_ROWS, QUERY_ROWS, REFINED = 0.99, 2048, 256, 64
FOUND = "query_id long, id long, score double"


@dataclass
class Index:
    """What the sample has taught: unit centres, a codebook for each stretch, and how many cells to probe."""

    centres: np.ndarray
    books: list[np.ndarray]
    probed: int

    def cells(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each unit vector, nearest first."""
        order = np.argsort(-(x @ self.centres.T), axis=1, kind="stable")
        return order[:, :n]

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """A byte for each stretch of what is left of each vector beside its cell's centre."""
        rest = x - self.centres[cell]
        return np.stack([nearest(part, book) for part, book in zip(stretches(rest), self.books, strict=True)], axis=1).astype("u1")

    def rough(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the cell's rows as their codes tell them."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for part, book, code in zip(stretches(q), self.books, codes.T, strict=True):
            out += (part @ book.T)[:, code]
        return out


def stretches(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, a : a + STRETCH] for a in range(0, x.shape[1], STRETCH)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre with the least distance to each row."""
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * (x @ centres.T), axis=1)


def centred(x: np.ndarray, n: int, unit: bool = False) -> np.ndarray:
    """n centres of the rows: begun at rows spread over the sample, moved to their members' mean; one without members stays."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=n)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        if unit:
            size = np.sqrt((centres * centres).sum(1, keepdims=True))
            centres = np.divide(centres, size, out=centres, where=size > 0)
    return centres


def fit(rows: DataFrame, k: int, section: str = "section", cover: float = COVER, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """An index fitted on at most sample_rows rows, those with the least hash of their id; None without rows.

    The cells to probe are counted on rows of the sample: their k nearest others of the same section, by
    the full product over the sample alone, lie in the first so many cells with a share of cover.
    """
    sample = usable(rows, section).orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    if not sample:
        return None
    x = np.array([r["vector"] for r in sample], "f8")
    size = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    cells = int(min(MOST_CELLS, max(1, len(x) // ROWS_A_CELL)))
    index = Index(centred(x, cells, unit=True), [], cells)
    own = index.cells(x)[:, 0]
    rest = x - index.centres[own]
    index.books = [centred(part, min(256, len(x))) for part in stretches(rest)]
    asked = np.arange(min(ASKED_ROWS, len(x)))
    names = np.unique([str(r[section]) for r in sample], return_inverse=True)[1]
    score = x[asked] @ x.T
    score[names[asked][:, None] != names[None, :]] = -np.inf
    score[asked, asked] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    place = np.argsort(index.cells(x[asked], cells), axis=1)  # of each cell among a row's nearest
    places = np.take_along_axis(place, own[best], axis=1)[np.isfinite(np.take_along_axis(score, best, axis=1))]
    index.probed = int(np.quantile(places, cover, method="higher")) + 1 if len(places) else 1
    return index


def usable(rows: DataFrame, section: str) -> DataFrame:
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.col(section).isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"), section)


def indexed(rows: DataFrame, index: Index, section: str = "section") -> DataFrame:
    """Every row (id, vector, section) with its cell and code."""
    send = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = send.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.StructArray.from_arrays([batch.column("id"), batch.column("vector")], names=["id", "vector"]))[1]
                cell = own.cells(x)[:, 0]
                codes = own.codes(x, cell)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype("i4")), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "cell", "code"])

    kept = usable(rows, section)
    return kept.mapInArrow(run, f"struct<{kept.schema.simpleString()[7:-1]},cell:int,code:binary>")


def probes(queries: DataFrame, index: Index, section: str = "section") -> DataFrame:
    """(id, vector, section, cell): each query once for each cell it looks into."""
    send = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = send.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.StructArray.from_arrays([batch.column("id"), batch.column("vector")], names=["id", "vector"]))[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(own.cells(x, own.probed).astype("i4")), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    kept = usable(queries, section)
    return kept.mapInArrow(run, f"struct<{kept.schema.simpleString()[7:-1]},cells:array<int>>").select("id", "vector", section, F.explode("cells").alias("cell"))


def blocked(rows: DataFrame, keys: list[str], size: int, columns: list[str], name: str) -> DataFrame:
    """(keys, name_block, name): rows of each key in blocks of about `size`, dealt by a hash of id."""
    counted = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    dealt = rows.join(counted, keys).withColumn(f"{name}_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    return dealt.groupBy(*keys, f"{name}_block").agg(F.collect_list(F.struct(*columns)).alias(name))


def approximate_top_k(queries: DataFrame, rows: DataFrame, k: int, section: str = "section", cover: float = COVER, refined: int = REFINED, index: Index | None = None) -> DataFrame:
    """(query_id, rank, id, score): about the k rows of the query's section with the highest cosine, ties to the smaller id.

    queries and rows: (id, vector, section) with vectors of one length. A row with the query's own id is
    left out. Scores are exact cosines; what may be missing are rows in cells that were not probed, or
    behind `refined` others of their block by code. Only blocks of probed cells meet queries, by section,
    cell and block; a cell or section with very many rows is that many keys. Null ids, vectors and
    sections take no part. A zero vector has cosine 0 with all.
    """
    index = index or fit(rows, k, section, cover)
    if index is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    send = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = send.value
        for batch in batches:
            cells = batch.column("cell").to_pylist()
            for i, cell in enumerate(cells):
                q_ids, q = matrix(batch.column("asked")[i].values)
                held = batch.column("held")[i].values
                ids, d = matrix(held)
                codes = np.frombuffer(b"".join(held.field("code").to_pylist()), "u1").reshape(len(ids), -1)
                rough = own.rough(q, cell, codes)
                rough[q_ids[:, None] == ids[None, :]] = -np.inf
                at = np.argpartition(-rough, refined, axis=1)[:, :refined] if refined < len(ids) else np.broadcast_to(np.arange(len(ids)), rough.shape)
                score = np.einsum("qbw,qw->qb", d[at], q)
                score[q_ids[:, None] == ids[at]] = -np.inf
                order = np.lexsort((ids[at], -score), axis=1)[:, :k]
                best, names = np.take_along_axis(score, order, 1), np.take_along_axis(ids[at], order, 1)
                good = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids[:, None], order.shape)[good]), pa.array(names[good]), pa.array(best[good])], names=["query_id", "id", "score"])

    keys = [section, "cell"]
    data = blocked(written(indexed(rows, index, section), "cells"), keys, BLOCK_ROWS, ["id", "vector", "code"], "held")
    asked = blocked(written(probes(queries, index, section), "probes"), keys, QUERY_ROWS, ["id", "vector"], "asked")
    found = asked.join(data, keys).select("cell", "asked", "held").mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
