"""Evaluation runs: judged answers of example rows, and resolver accuracy over annotated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import evaluation, model_steps, prompts
from ledgerline.operators.resolve import SYMBOL_SHAPE, resolve, stripped

JUDGED_CHARS = 2000


def judge_run(examples: DataFrame, templates: DataFrame, model: model_steps.Model, judge: model_steps.Model, agent: str | None = None, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, means): each example's answer, scores and reasoning, and their means.

    examples: (id, agent, input_context, expected_output_contains). Template names are agents' names;
    a failed answer is judged as an empty one, a failed judge scores zero. latency_ms is the time of
    the answer, not of the judge.
    """
    kept = examples if agent is None else examples.where(F.col("agent") == agent)
    chosen = prompts.latest(templates) if version is None else templates.where(F.col("version") == version)
    rows = kept.join(chosen.select(F.col("name").alias("agent"), "template", F.col("version").alias("prompt_version")), "agent", "left")
    values = {f.name: F.col(f"input_context.{f.name}").cast("string") for f in examples.schema["input_context"].dataType.fields}
    rows = model_steps.call(rows.withColumn("prompt", prompts.rendered(F.col("template"), values)), "prompt", model, latency="latency_ms")
    asked = F.concat(F.lit("Expected: "), F.array_join("expected_output_contains", ", "), F.lit("\nAnswer: "), F.left(F.coalesce("answer", F.lit("")), F.lit(JUDGED_CHARS)))
    rows = model_steps.call(rows.withColumn("judge_prompt", asked), "judge_prompt", judge, "judgement").withColumn("j", model_steps.judged(F.col("judgement")))
    out = rows.select("id", "agent", "prompt_version", "answer", "j.relevance_score", "j.accuracy_score", "j.reasoning", "latency_ms")
    return out, evaluation.judge_means(out)


def resolver_run(annotations: DataFrame, answers: DataFrame | None = None, only_verified: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, overall, by intent): resolved symbols against expected ones; direct symbols are skipped."""
    kept = annotations.where(F.col("human_verified")) if only_verified else annotations
    rows = resolve(kept, answers)
    skipped = F.coalesce(stripped(F.col("query")).rlike(SYMBOL_SHAPE), F.lit(False))
    rows = rows.select("id", "query", "intent", "expected_symbol", F.col("symbol").alias("resolved_symbol"), F.col("symbol").eqNullSafe(F.col("expected_symbol")).alias("correct"), "confidence", skipped.alias("skipped"), "error")
    return rows, evaluation.accuracy(rows), evaluation.accuracy(rows, ["intent"]).orderBy("intent")
