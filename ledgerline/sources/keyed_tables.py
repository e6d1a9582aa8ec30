"""Tables with a key: Parquet in hash buckets, of which an update rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class KeyedTable:
    """A table at path with a row a key, in folders by a hash of the key; one writer at a time.

    The folders' name tells how many buckets there are, so a table opened with another number is not
    mistaken for it. An update reads the buckets that its rows fall in, and puts new ones in their place
    by dynamic partition overwrite: all are written beside the table first and moved when the last task
    is done. A job that is lost before leaves the table as it was; one lost while folders move leaves
    some buckets new and some old, and the same update run again makes it whole.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = T.StructType.fromDDL(schema)
        self.column = f"bucket_of_{buckets}"

    def _folder(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._folder(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(self.column, T.IntegerType())])
        fs = self._files()
        if not fs.exists(self._folder(self.path)):
            return self.spark.createDataFrame([], schema)
        names = [x.getPath().getName() for x in fs.listStatus(self._folder(self.path))]
        if other := [n for n in names if n.startswith("bucket_of_") and not n.startswith(f"{self.column}=")]:
            raise ValueError(f"{self.path} has {other[0].partition('=')[0]}, not {self.column}")
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(self.column)

    def merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts combine(old, new) in place of the buckets that new rows fall in, old being their rows; returns the buckets.

        combine must keep each row's key. Rows of new with a null key are left out.
        """
        new = new.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.keys))).withColumn(self.column, self.bucket())
        touched = sorted(r[0] for r in new.select(self.column).distinct().collect())  # as many as there are buckets at most
        if not touched:
            return []
        old = self._stored().where(F.col(self.column).isin(touched)).drop(self.column)
        rows = combine(old, new.drop(self.column)).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumn(self.column, self.bucket())
        # One task and file a bucket; the overwrite replaces the folders that get rows.
        dealt = rows.repartition(min(len(touched), self.buckets), self.column)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.column).parquet(self.path)
        return touched

    def upsert(self, new: DataFrame, order: list[str]) -> list[int]:
        """New rows replace old ones of their key; of several new ones the latest by `order` counts, ties by all columns."""
        return self.merge(new, lambda old, rows: newest(old, rows, self.keys, order))

    def delete(self, gone: DataFrame) -> list[int]:
        """Leaves out the rows whose key stands in gone; buckets that are left empty lose their folder."""
        touched = self.merge(gone.select(*self.keys), lambda old, keys: old.join(keys.distinct(), self.keys, "left_anti"))
        if touched:
            filled = {r[0] for r in self._stored().where(F.col(self.column).isin(touched)).join(gone.select(*self.keys).distinct(), self.keys, "left_anti").select(self.column).distinct().collect()}
            for bucket in set(touched) - filled:
                self._files().delete(self._folder(f"{self.path}/{self.column}={bucket}"), True)
        return touched


def newest(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the latest new row, else the old one. New rows of a key are reduced before they are shuffled."""
    columns = old.columns
    rank = F.struct(*order, *(c for c in columns if c not in order))
    latest = new.select(*columns).groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("row")).select("row.*", F.lit(1).alias("_new"))
    both = old.withColumn("_new", F.lit(0)).unionByName(latest)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_rank", last).where(F.col("_rank") == 1).drop("_new", "_rank")
