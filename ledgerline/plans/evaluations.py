"""Evaluation runs as queries, with models that SQL can say, too."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ledgerline.plans import evaluation_run as runs
from ledgerline.plans.oracle import STRIP, aliases_sql
from ledgerline.plans.parts import query
from ledgerline.sources import tables as T

QUERIES = ("Apple stock outlook", "AAPL", "aapl", "what about tesla and nvidia", "some unknown firm", "  ", "coca-cola risk", " BRK-B ")
EXPECTED = ("AAPL", "KO", None, "TSLA")


def echo(prompts: pd.Series) -> pd.Series:
    """Answers a prompt by itself; fails where its length is a multiple of three."""
    return prompts.map(lambda p: p if len(p) % 3 else None)


def by_length(prompts: pd.Series) -> pd.Series:
    """Scores by the prompt's length, in a fence or, for every fourth length, as no JSON; fails for every eleventh."""

    def one(p: str) -> str | None:
        n = len(p)
        return None if n % 11 == 0 else "no scores" if n % 4 == 0 else '```json\n{"relevance_score": %d, "accuracy_score": %d, "reasoning": "n%d"}\n```' % (n % 6, n % 5, n)

    return prompts.map(one)


def judged(spark, d):
    """Parts as examples: the type is the agent, its newest part's template the prompt."""
    parts = T.scan(spark, d, "part")
    context = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(None).cast("string").alias("gone"))
    examples = parts.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("agent"), context.alias("input_context"), F.array("p_name", "p_brand").alias("expected_output_contains"))
    template = F.concat(F.lit("Rate {name}, size {size}, {gone} {odd}, for "), F.col("p_brand"))
    templates = parts.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("version"), template.alias("template"))
    return runs.judge_run(examples, templates, echo, by_length)


JUDGED = """newest AS (SELECT p_type AS agent, max(p_partkey) AS prompt_version, 'for ' || arg_max(p_brand, p_partkey) AS tail FROM part GROUP BY 1),
asked AS (SELECT p_partkey AS id, agent, prompt_version, p_name || ', ' || p_brand AS wanted, 'Rate ' || p_name || ', size ' || p_size || ', {gone} {odd}, ' || tail AS prompt FROM part JOIN newest ON agent = p_type),
answered AS (SELECT *, CASE WHEN length(prompt) % 3 <> 0 THEN prompt END AS answer FROM asked),
measured AS (SELECT *, length('Expected: ' || wanted || chr(10) || 'Answer: ' || left(coalesce(answer, ''), 2000)) AS n FROM answered),
judged AS (SELECT id, agent, prompt_version, answer, CASE WHEN n % 11 = 0 OR n % 4 = 0 THEN 0 ELSE n % 6 END AS relevance_score, CASE WHEN n % 11 = 0 OR n % 4 = 0 THEN 0 ELSE n % 5 END AS accuracy_score, CASE WHEN n % 11 = 0 OR n % 4 = 0 THEN '' ELSE 'n' || n END AS reasoning FROM measured)"""


@query(f"WITH {JUDGED} SELECT * FROM judged")
def judge_run(spark, d):
    """Rows of an evaluation run, but for the time that answers took."""
    return judged(spark, d)[0].drop("latency_ms")


@query(f"WITH {JUDGED} SELECT round(avg(relevance_score), 6) AS avg_relevance, round(avg(accuracy_score), 6) AS avg_accuracy, count(*) AS n FROM judged")
def judge_run_means(spark, d):
    means = judged(spark, d)[1]
    return means.select(F.round("avg_relevance", 6).alias("avg_relevance"), F.round("avg_accuracy", 6).alias("avg_accuracy"), "n")


_LISTED = "[" + ", ".join(f"'{q}'" for q in QUERIES) + "]"
_EXPECTED = "[" + ", ".join("NULL" if e is None else f"'{e}'" for e in EXPECTED) + "]"
_SHAPE = "'^[A-Z]{1,5}(-[A-Z]{1,2})?$'"


@query(rf"""WITH {aliases_sql()}, q AS (SELECT p_partkey AS id, p_type AS intent, {_LISTED}[p_partkey % 8 + 1] AS query, {_EXPECTED}[p_partkey // 8 % 4 + 1] AS expected FROM part WHERE p_size % 5 <> 0),
t AS (SELECT *, {STRIP.format("query")} AS s FROM q), m AS (SELECT *, (SELECT arg_min(code, (name <> lower(s), ord)) FROM aliases WHERE contains(lower(s), name)) AS code FROM t),
r AS (SELECT intent, expected, regexp_matches(s, {_SHAPE}) AS skipped, CASE WHEN s = '' THEN NULL WHEN regexp_matches(upper(s), {_SHAPE}) THEN upper(s) ELSE code END AS symbol FROM m),
c AS (SELECT intent, count(*) FILTER (NOT skipped AND symbol IS NOT DISTINCT FROM expected) AS correct, count(*) FILTER (NOT skipped) AS total FROM r GROUP BY 1)
SELECT intent, correct, total, round(coalesce(100.0::DOUBLE * correct / nullif(total, 0), 0), 6) AS accuracy_pct FROM c""")
def resolver_run(spark, d):
    """Accuracy by intent over annotated queries made from parts; a fifth of them is not verified."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    key = F.col("p_partkey")
    rows = T.scan(spark, d, "part").select(key.alias("id"), pick(QUERIES, key).alias("query"), F.col("p_type").alias("intent"), pick(EXPECTED, F.floor(key / 8)).alias("expected_symbol"), (F.col("p_size") % 5 != 0).alias("human_verified"))
    return runs.resolver_run(rows)[2].withColumn("accuracy_pct", F.round("accuracy_pct", 6))
