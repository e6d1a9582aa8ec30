"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node of its component.

    Large-star and small-star steps turn about until the edges are stars around their least node;
    the number of rounds grows with the logarithm of the longest path. A round moves edges by joins
    and pre-aggregated minima only, so a node with very many neighbours is no group in one task.
    Each round is written to the shared folder. Self-loops and repeated edges do no harm.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sides = F.count_if(F.col("b") < F.col("a")).alias("lower"), F.count_if(F.col("b") > F.col("a")).alias("higher")
        # Minima are written, so that a join's sides are plain scans and skewed nodes can be split.
        least = written(both.groupBy(F.col("a").alias("n")).agg(F.least(F.first("a"), F.min("b")).alias("m"), *sides), "least")
        if not least.where((F.col("lower") > 1) | (F.col("lower") == 1) & (F.col("higher") > 0)).limit(1).count():
            return least.select(F.col("n").alias("node"), F.col("m").alias("root"))
        # Large star: each larger neighbour, and the node itself, goes to the least neighbour.
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where(F.col("a") != F.col("b")).distinct(), "large")
        # Small star: each smaller neighbour goes to the least of them.
        low = written(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "low")
        small = large.join(low, F.col("a") == F.col("n")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where(F.col("a") != F.col("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
