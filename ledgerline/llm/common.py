"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.scratch import scratch_dir, written

__all__ = ["held_out", "labelled_sample", "parts", "scratch_dir", "written"]

def parts(batch: pa.RecordBatch, column: str, rows: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `rows` rows and about most_bytes of text; a longer text is alone.

    What Arrow keeps for later goes back after each batch, as a worker shares an executor's memory.
    """
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8"))
    at = 0
    while at < batch.num_rows:
        reach = int(np.searchsorted(end, (end[at - 1] if at else 0) + most_bytes, "right"))
        n = max(1, min(rows, reach - at))
        yield batch.slice(at, n)
        at += n
    pa.default_memory_pool().release_unused()


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32(doc_id as text) mod modulus is remainder; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fold.

    The sample is the `rows` labels with the smallest hash of doc_id, so it doesn't depend on
    partitioning. It is taken from the narrow label table before it meets the texts, so at most
    `rows` ids are broadcast. Null labels and null ids don't count; of repeated label rows of an id the
    greatest label counts, of repeated documents of an id the least text.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_label_id"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_label_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_label_id", modulus, remainder))
        .groupBy("_label_id")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").alias("_label_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "_label_id").groupBy("_label_id").agg(F.min("text").alias("text"), F.min("_label").alias("label"))
    return found.select(F.col("_label_id").alias("doc_id"), "text", "label")
