"""Progress events of runs: typed steps, gaps, terminal states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import step_tag

#: Silence after which a run is sent a comment, again and again, and after which it is stale (fixed values).
KEEP_ALIVE_SECONDS, STALE_SECONDS = 15, 600


def events(lines: DataFrame) -> DataFrame:
    """(run_id, ts, step, message) of non-blank progress lines (run_id, ts, line); works on streams too."""
    message = F.regexp_replace("line", r"^\s+|\s+$", "")
    return lines.where(message != "").select("run_id", "ts", step_tag(F.col("line")).alias("step"), message.alias("message"))


def neighbours(rows: DataFrame) -> DataFrame:
    """(run_id, from_ts, to_ts) of each two events of a run that follow each other.

    Neighbours within an hour are found hour by hour, those across hours from each hour's first and
    last event, so a run with very many events is no single window partition.
    """
    timed = rows.where(F.col("ts").isNotNull()).select("run_id", "ts", F.date_trunc("hour", "ts").alias("hour"))
    inside = timed.select("run_id", F.lag("ts").over(Window.partitionBy("run_id", "hour").orderBy("ts")).alias("from_ts"), F.col("ts").alias("to_ts"))
    hours = timed.groupBy("run_id", "hour").agg(F.min("ts").alias("to_ts"), F.max("ts").alias("last"))
    across = hours.select("run_id", F.lag("last").over(Window.partitionBy("run_id").orderBy("hour")).alias("from_ts"), "to_ts")
    return inside.unionByName(across).where(F.col("from_ts").isNotNull())


def gaps(rows: DataFrame, minutes: int = 10) -> DataFrame:
    """(run_id, from_ts, to_ts, gap_seconds) where a run was silent for more than so many minutes."""
    seconds = (F.unix_micros(F.col("to_ts").cast("timestamp")) - F.unix_micros(F.col("from_ts").cast("timestamp"))) / 1e6
    return neighbours(rows).withColumn("gap_seconds", seconds).where(F.col("gap_seconds") > minutes * 60)


def silences(rows: DataFrame, until: str | None = None) -> DataFrame:
    """(run_id, from_ts, keep_alives, stale_at) of each silence long enough for a keep-alive.

    keep_alives counts the comments, one for each KEEP_ALIVE_SECONDS up to staleness that is over before
    the next event; stale_at is null where that came first. With `until`, the silence behind a run's last
    event counts as well, as if an event came then; without it, that silence is left open.
    """
    pairs = neighbours(rows)
    if until is not None:
        last = rows.where(F.col("ts").isNotNull()).groupBy("run_id").agg(F.max("ts").alias("from_ts"))
        pairs = pairs.unionByName(last.withColumn("to_ts", F.lit(until).cast(rows.schema["ts"].dataType)))
    micros = F.unix_micros(F.col("to_ts").cast("timestamp")) - F.unix_micros(F.col("from_ts").cast("timestamp"))
    most = STALE_SECONDS // KEEP_ALIVE_SECONDS
    due = F.least(F.lit(most), F.floor((micros - 1) / (KEEP_ALIVE_SECONDS * 1_000_000))).cast("int")
    told = pairs.select("run_id", "from_ts", due.alias("due")).where(F.col("due") > 0)
    stale_at = F.when(F.col("due") == most, F.col("from_ts") + F.expr(f"INTERVAL {STALE_SECONDS} SECONDS"))
    return told.select("run_id", "from_ts", F.least("due", F.lit(most - 1)).alias("keep_alives"), stale_at.alias("stale_at"))


def silence_signals(rows: DataFrame, until: str | None = None) -> DataFrame:
    """(run_id, at, signal) of silences: a row for each keep-alive and each run found stale."""
    at = lambda k: F.col("from_ts") + F.make_dt_interval(secs=k * KEEP_ALIVE_SECONDS)
    told = F.transform(F.sequence(F.lit(1), F.col("keep_alives")), lambda k: F.struct(at(k).alias("at"), F.lit("keep-alive").alias("signal")))
    stale = F.when(F.col("stale_at").isNotNull(), F.array(F.struct(F.col("stale_at").alias("at"), F.lit("stale").alias("signal")))).otherwise(F.slice(told, 1, 0))
    return silences(rows, until).select("run_id", F.explode(F.concat(told, stale)).alias("s")).select("run_id", "s.*")


def terminal(rows: DataFrame) -> DataFrame:
    """(run_id, ts, step): the last event of each run."""
    return rows.groupBy("run_id").agg(F.max_by(F.struct("ts", "step"), F.struct("ts", "step")).alias("last")).select("run_id", "last.*")
