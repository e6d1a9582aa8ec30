"""Steps around a language model: render, call, parse, validate, fall back.

The model is a function from a Series of prompts to a Series of answers (null where it fails). Only
the rows that need it reach it: callers filter first and join the answers back.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import sentiment, unfenced
from ledgerline.operators.decision import normalized
from ledgerline.operators.resolve import SYMBOL_SHAPE

Model = Callable[[pd.Series], pd.Series]
FALLBACK_RISKS = ("Unable to identify risks",)
DEFAULT_INTENT, DEFAULT_CONFIDENCE = "stock_analysis", 0.5
INTENTS = ("stock_analysis", "market_outlook", "comparison", "risk_assessment", "document_lookup")
NEXT_MODEL, STOP = (404, 429), (400, 401, 403)


def call(rows: DataFrame, prompt: str, model: Model, column: str = "answer", latency: str | None = None) -> DataFrame:
    """rows with the model's answers, a batch at a time; with `latency`, also the milliseconds of a row's share."""
    asked = with_fallback(rows, prompt, [model], column, latency or "_latency_ms").drop(f"{column}_outcome")
    return asked if latency else asked.drop("_latency_ms")


def with_fallback(rows: DataFrame, prompt: str, models: list[Model], column: str = "answer", latency: str = "latency_ms") -> DataFrame:
    """rows with the answer of the first model that gives one, its outcome and its milliseconds.

    One pass walks the models over a batch: each sees only the prompts that are still open, each of
    them once. A model gives answers (null where it fails) or a frame of answer and status; a status
    of STOP closes a prompt without an answer, any other failure leaves it to the next model. The
    outcome is done, stopped or failed. A null prompt is asked like any other. A row's milliseconds
    are its share of its batches' time.
    """

    @F.pandas_udf("answer string, outcome string, ms double")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            out = pd.DataFrame({"answer": pd.Series([None] * len(batch), dtype=object), "outcome": "failed", "ms": 0.0})
            left = batch.index
            for model in models:
                if not len(left):
                    break
                began = time.perf_counter()
                got = model(batch.loc[left])
                out.loc[left, "ms"] += (time.perf_counter() - began) * 1000 / len(left)
                known = isinstance(got, pd.DataFrame)
                answer = pd.Series((got["answer"] if known else got).to_numpy(dtype=object), index=left)
                stopped = pd.Series(got["status"].isin(STOP).to_numpy() if known else False, index=left) & answer.isna()
                out.loc[left, "answer"] = answer.where(answer.notna(), None)
                out.loc[left[answer.notna()], "outcome"] = "done"
                out.loc[left[stopped], "outcome"] = "stopped"
                left = left[answer.isna() & ~stopped]
            yield out

    # A model's call is no pure function: the plan must neither repeat nor move it.
    found = rows.withColumn("_asked", ask.asNondeterministic()(F.col(prompt)))
    return found.withColumns({column: F.col("_asked.answer"), f"{column}_outcome": F.col("_asked.outcome"), latency: F.col("_asked.ms")}).drop("_asked")


def failover(status: Column) -> Column:
    """What an HTTP status asks for: the next model, or to stop."""
    return F.when(status.isin(*STOP), "stop").when(status == 200, "done").otherwise("next")


def model_for(agent: Column, main: str = "main", small: str = "small") -> Column:
    """Macro and sentiment steps go to the small model."""
    name = F.lower(agent)
    return F.when(name.contains("macro") | name.contains("sentiment"), small).otherwise(main)


def preferred_order(available: Column, preferred: Column) -> Column:
    """Preferred models that are available, in their order, then the rest."""
    return F.concat(F.array_intersect(preferred, available), F.array_except(available, preferred))


def key_risks(answer: Column) -> Column:
    """At most five risks of a JSON answer, or the fallback."""
    found = F.from_json(unfenced(answer), "struct<risks: array<string>>")["risks"]
    listed = F.coalesce(found, F.from_json(unfenced(answer), "array<string>"))
    return F.when(F.size(listed) > 0, F.slice(listed, 1, 5)).otherwise(F.array(*map(F.lit, FALLBACK_RISKS)))


def risk_template_version(has_filing: Column, versions: Column) -> Column:
    return F.when(has_filing & F.array_contains(versions, 2), 2).otherwise(1)


def scenario_rows(answers: DataFrame) -> DataFrame:
    """Normalised scenarios (symbol, name, ret, prob) of JSON answers (symbol, answer)."""
    one = "struct<`return`: double, prob: double>"
    parsed = F.from_json(unfenced(F.col("answer")), f"struct<bull: {one}, base: {one}, bear: {one}>")
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col("p")[n]["return"].alias("ret"), F.col("p")[n]["prob"].alias("prob")) for n in ("bull", "base", "bear")))
    return normalized(answers.select("symbol", parsed.alias("p")).select("symbol", F.explode(rows).alias("s")).select("symbol", "s.*"))


def sentiment_label(answer: Column) -> Column:
    return sentiment(answer)


def resolved_query(answer: Column) -> Column:
    """struct(symbol, confidence) of a JSON answer; null symbol unless it is shaped like one."""
    parsed = F.from_json(unfenced(answer), "struct<ticker: string, confidence: double>")
    symbol = F.upper(F.trim(parsed["ticker"]))
    return F.struct(F.when(symbol.rlike(SYMBOL_SHAPE), symbol).alias("symbol"), F.coalesce(parsed["confidence"], F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))


def intent(answer: Column) -> Column:
    """struct(intent, confidence); unknown intents become the default."""
    parsed = F.from_json(unfenced(answer), "struct<intent: string, confidence: double>")
    known = parsed["intent"].isin(*INTENTS)
    return F.struct(F.when(known, parsed["intent"]).otherwise(DEFAULT_INTENT).alias("intent"), F.when(known, F.coalesce(parsed["confidence"], F.lit(DEFAULT_CONFIDENCE))).otherwise(DEFAULT_CONFIDENCE).alias("confidence"))


def judged(answer: Column) -> Column:
    """struct(relevance_score, accuracy_score, reasoning); zeros where the judge failed."""
    parsed = F.from_json(unfenced(answer), "struct<relevance_score: int, accuracy_score: int, reasoning: string>")
    return F.struct(F.coalesce(parsed["relevance_score"], F.lit(0)).alias("relevance_score"), F.coalesce(parsed["accuracy_score"], F.lit(0)).alias("accuracy_score"), F.coalesce(parsed["reasoning"], F.lit("")).alias("reasoning"))


def generated_queries(answers: DataFrame, first_id: int = 100) -> DataFrame:
    """(id, query, intent, expected_symbol, complexity, source, human_verified) of JSON arrays (category, answer).

    Ids count from first_id by category and place: each category begins where the ones before it end.
    There are a few categories, so their sizes are one broadcast row. A category is one answer.
    """
    item = "struct<query: string, expected_ticker: string, complexity: string>"
    parsed = answers.select("category", F.from_json(unfenced(F.col("answer")), f"array<{item}>").alias("items"))
    sizes = parsed.where(F.col("items").isNotNull()).agg(F.collect_list(F.struct("category", F.size("items").alias("n"))).alias("sizes"))
    rows = parsed.select("category", F.posexplode("items").alias("pos", "q")).crossJoin(F.broadcast(sizes))
    before = F.filter("sizes", lambda x: x["category"] < F.col("category"))
    number = F.aggregate(before, F.lit(first_id), lambda s, x: s + x["n"]) + F.col("pos")
    return rows.select(number.cast("long").alias("id"), F.col("q.query").alias("query"), F.col("category").alias("intent"), F.col("q.expected_ticker").alias("expected_symbol"), F.coalesce("q.complexity", F.lit("simple")).alias("complexity"), F.lit("llm_generated").alias("source"), F.lit(False).alias("human_verified"))
