"""Keyed tables: only touched buckets are rewritten, updates repeat without effect."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import documents
from ledgerline.sources.keyed_tables import KeyedTable

SCHEMA = "id long, at int, name string"


def files(path):
    return {p.parent.name: sorted(f.name for f in p.parent.glob("*.parquet")) for p in Path(path).glob("bucket_of_*/*.parquet")}


def rows(table):
    return sorted(map(tuple, table.read().collect()))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, SCHEMA, ["id"], 16)
    assert rows(table) == [] and table.upsert(spark.createDataFrame([], SCHEMA), ["at"]) == []
    table.upsert(spark.range(400).select("id", F.lit(1).alias("at"), F.concat(F.lit("n"), "id").alias("name")), ["at"])
    before, want = files(path), {k: (k, 1, f"n{k}") for k in range(400)}
    assert rows(table) == sorted(want.values()) and len(before) == 16 and all(len(x) == 1 for x in before.values())
    new = spark.createDataFrame([(3, 5, "old"), (3, 9, "new"), (3, 9, "mid"), (1000, None, None), (None, 1, "no key"), (3, 9, "new")], SCHEMA)
    touched = table.upsert(new, ["at"])
    want |= {3: (3, 9, "new"), 1000: (1000, None, None)}
    after = files(path)
    assert {r["id"]: tuple(r) for r in table.read().collect()} == want
    assert len(touched) == 2 and {b for b in before if before[b] != after[b]} == {f"bucket_of_16={b}" for b in touched}
    again = table.upsert(new, ["at"])
    assert again == touched and {r["id"]: tuple(r) for r in table.read().collect()} == want


def test_deleted_keys_and_empty_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, SCHEMA, ["id"], 8)
    table.upsert(spark.range(40).select("id", F.lit(0).alias("at"), F.lit("x").alias("name")), ["at"])
    gone = table.read().withColumn("b", table.bucket()).where("b = 3 OR id = 7").select("id")
    left = {r["id"] for r in table.read().collect()} - {r["id"] for r in gone.collect()}
    table.delete(spark.createDataFrame(gone.collect(), "id long"))
    assert {r["id"] for r in table.read().collect()} == left and "bucket_of_8=3" not in files(path)
    assert table.delete(spark.createDataFrame([(999,)], "id long")) and {r["id"] for r in table.read().collect()} == left


def test_another_number_of_buckets_is_refused(spark, tmp_path):
    KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4).upsert(spark.createDataFrame([(1, 1, "a")], SCHEMA), ["at"])
    with pytest.raises(ValueError, match="bucket_of_4"):
        KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 8).read()


def test_registry_merge_in_buckets(spark, tmp_path):
    """The registry's own rule, column by column, over the touched buckets alone."""
    schema = "id string, created_at timestamp, title string, chunks long"
    at = lambda d: dt.datetime(2024, 1, d)
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["id"], 4)
    table.merge(spark.createDataFrame([("a", at(2), "old", 5), ("b", at(1), "keep", 1)], schema), documents.merge_registry)
    table.merge(spark.createDataFrame([("a", at(3), None, 9), ("c", at(4), "new", None)], schema), documents.merge_registry)
    assert rows(table) == [("a", at(2), "old", 9), ("b", at(1), "keep", 1), ("c", at(4), "new", None)]


def test_a_key_of_very_many_rows(spark, tmp_path):
    """Rows of one key are reduced in each task, so one row a task is shuffled."""
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], 4)
    new = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("id"), F.col("id").cast("int").alias("at"), F.lit("x").alias("name"))
    table.upsert(new, ["at"])
    assert table.read().count() == 100_001 and table.read().where("id = -1").first()["at"] == 299_999
