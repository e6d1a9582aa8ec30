"""Vector search: filtered cosine top-k for a set of query vectors, and a pluggable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 2048
EMBED_CHARS = 4096
FOUND = "query_id long, id long, score double"


def blocks(rows: DataFrame, section: str, prefix: str, block_rows: int) -> DataFrame:
    """(section, prefix_block, prefix_blocks, prefix_rows): rows (id, vector) of a section in its blocks of about block_rows."""
    good = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.col(section).isNotNull())
    n = good.groupBy(section).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(f"{prefix}_blocks"))
    dealt = good.join(n, section).withColumn(f"{prefix}_block", F.pmod(F.xxhash64("id"), F.col(f"{prefix}_blocks")).cast("int"))
    return dealt.groupBy(section, f"{prefix}_block", f"{prefix}_blocks").agg(F.collect_list(F.struct("id", F.col("vector").cast("array<double>").alias("vector"))).alias(f"{prefix}_rows"))


def matrix(cell: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a block; zero vectors stay zero."""
    ids = np.asarray(cell.field("id"), dtype="int64")
    x = np.asarray(cell.field("vector").flatten(), dtype="float64").reshape(len(ids), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return ids, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int, section: str = "section", breadth: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k rows of the query's section with the highest cosine, ties to the smaller id.

    queries and rows: (id, vector, section) with vectors of one length. A row with the query's own id
    is left out. Both sides go in blocks, so a task holds two blocks at a time and gives k rows a
    query; a window over those keeps the best. A section's query blocks, the smaller side, are copied
    to each of its data blocks, and the two meet by section and data block: a section with very many
    rows is that many keys. With `breadth`, a block's candidates are the best so many by eight-bit
    numbers in single precision, and only those are scored in full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q_rows, d_rows = batch.column("q_rows"), batch.column("d_rows")
            for i in range(batch.num_rows):
                q_ids, q = matrix(q_rows[i].values)
                ids, d = matrix(d_rows[i].values)
                if breadth is not None and breadth < len(ids):
                    rough = np.rint(q * 127).astype("f4") @ np.rint(d * 127).astype("f4").T
                    rough[q_ids[:, None] == ids[None, :]] = -np.inf
                    at = np.argpartition(-rough, breadth, axis=1)[:, :breadth]
                    names, score = ids[at], np.einsum("qbw,qw->qb", d[at], q)
                else:
                    names, score = np.broadcast_to(ids, (len(q_ids), len(ids))), q @ d.T
                score[q_ids[:, None] == names] = -np.inf
                order = np.lexsort((names, -score), axis=1)[:, :k]
                best, names = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)
                good = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids[:, None], order.shape)[good]), pa.array(names[good]), pa.array(best[good])], names=["query_id", "id", "score"])

    data = blocks(rows, section, "d", block_rows)
    asked = blocks(queries, section, "q", 256).join(rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).groupBy(section).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n")), section)
    asked = asked.select(section, "q_rows", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("d_block"))
    pairs = asked.join(data, [section, "d_block"])
    found = pairs.select("q_rows", "d_rows").mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def hashed_embedding(texts: pd.Series, width: int = 384) -> pd.Series:
    """Stand-in embedder: signed counts of hashed words, unit length. A model takes its place."""

    def one(text: str) -> list[float]:
        out = np.zeros(width)
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % width] += 1 if h >> 63 else -1
        size = np.sqrt((out * out).sum())
        return (out / size if size else out).tolist()

    return texts.map(one)


def embed(rows: DataFrame, text: str, model: Callable[[pd.Series], pd.Series] = hashed_embedding, column: str = "embedding") -> DataFrame:
    """rows with the model's vector of the text's first 4096 characters (the model's input limit)."""
    run = F.pandas_udf(lambda s: model(s), T.ArrayType(T.FloatType()))
    return rows.withColumn(column, run(F.left(F.coalesce(F.col(text), F.lit("")), F.lit(EMBED_CHARS))))
