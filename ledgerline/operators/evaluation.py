"""Evaluation roll-ups: judge means, resolver accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge_means(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means of relevance, accuracy and latency; missing scores count as zero."""
    zero = F.lit(0)
    return scores.groupBy(*(keys or [])).agg(
        F.avg(F.coalesce("relevance_score", zero)).alias("avg_relevance"), F.avg(F.coalesce("accuracy_score", zero)).alias("avg_accuracy"),
        F.avg(F.coalesce("latency_ms", F.lit(0.0))).alias("avg_latency_ms"), F.count("*").alias("n"),
    )


def accuracy(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Correct, total and percentage of rows that aren't skipped; zero percent if there are none."""
    counted = ~F.coalesce("skipped", F.lit(False))
    correct = F.count_if(counted & F.coalesce("correct", F.lit(False)))
    total = F.count_if(counted)
    return rows.groupBy(*(keys or [])).agg(correct.alias("correct"), total.alias("total"), F.coalesce(F.try_divide(correct * 100.0, total), F.lit(0.0)).alias("accuracy_pct"))
