"""Sinks: appended, replaced and exported tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Writes rows in place of the table at path; rows may be read from that table.

    The new table is written beside the old one, which is renamed to path.old before the new one takes
    its name and is deleted last. So a failed write leaves the old table whole, and a driver that is
    lost between the renames leaves both, old and new, beside the path.
    """
    spark = rows.sparkSession
    fresh = f"{path.rstrip('/')}.new"
    rows.write.mode("overwrite").parquet(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(fresh).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{path.rstrip('/')}.old"
    had = fs.exists(hadoop(path))
    if had:
        fs.delete(hadoop(aside), True)
        if not fs.rename(hadoop(path), hadoop(aside)):
            raise OSError(f"{path} can't be renamed to {aside}")
    if not fs.rename(hadoop(fresh), hadoop(path)):
        raise OSError(f"{fresh} can't take the name {path}")
    if had:
        fs.delete(hadoop(aside), True)


def csv_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def stamped(folder: str, name: str, at: datetime) -> str:
    """Place of a run's results: name and time in one, so that runs don't meet."""
    return f"{folder.rstrip('/')}/{name}_{at:%Y%m%d_%H%M%S}.csv"


def json_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def json_column(rows: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
