"""Structured Streaming over progress lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.progress import events
from ledgerline.sources.schemas import PROGRESS


def progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Typed progress events of line files (JSON rows run_id, ts, line) that arrive in a folder."""
    return events(spark.readStream.schema(PROGRESS).json(folder))


def silent_runs(stream: DataFrame, minutes: int = 10) -> DataFrame:
    """Sessions of a run's events by event time; a session ends after so many silent minutes."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp"))
    window = F.session_window("at", f"{minutes} minutes")
    return timed.withWatermark("at", f"{minutes} minutes").groupBy("run_id", window.alias("w")).agg(F.count("*").alias("events")).select("run_id", F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "events")


def windowed_counts(stream: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each step in tumbling windows, with a watermark (an extension)."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy(F.window("at", size).alias("w"), "step").agg(F.count("*").alias("events")).select(F.col("w.start").alias("from_ts"), "step", "events")


def upsert_sink(stream: DataFrame, write, checkpoint: str):
    """Starts a query that hands each micro-batch to write(batch, id), for keyed upserts."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def stop_tagged(spark: SparkSession, tag: str) -> list[str]:
    """Cancels the jobs of a tag, as a client that goes away does."""
    return spark.interruptTag(tag)
