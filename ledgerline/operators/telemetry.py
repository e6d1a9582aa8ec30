"""Model-call telemetry: tokens, cost, totals of each analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars for a million tokens, in and out (fixed values).
PRICES = {
    "gemini-2.5-flash": (0.15, 0.60), "gemini-2.0-flash": (0.10, 0.40), "gemini-2.5-pro": (1.25, 5.00), "gemini-1.5-flash": (0.075, 0.30),
    "gemini-pro": (0.50, 1.50), "mistralai/Mistral-7B-Instruct-v0.2": (0.10, 0.10),
}
DEFAULT_PRICE = (0.50, 1.50)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def price(model: Column, side: int) -> Column:
    """The model's price; the default for unknown ones. The list is code, so no join."""
    out = F.lit(DEFAULT_PRICE[side])
    for name, prices in PRICES.items():
        out = F.when(model == name, prices[side]).otherwise(out)
    return out


def with_cost(calls: DataFrame) -> DataFrame:
    """calls with total_tokens and cost_usd; missing token counts are zero."""
    zero = F.lit(0).cast("long")
    p, c = F.coalesce("prompt_tokens", zero), F.coalesce("completion_tokens", zero)
    cost = p / 1e6 * price(F.col("model"), 0) + c / 1e6 * price(F.col("model"), 1)
    return calls.withColumns({"prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c, "cost_usd": cost})


def summary(calls: DataFrame) -> DataFrame:
    """Totals of each analysis; calls without one don't count."""
    return with_cost(calls).where(F.col("analysis_id").isNotNull()).groupBy("analysis_id").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"), F.round(F.sum("latency_ms"), 1).alias("total_latency_ms"), F.count("*").alias("num_calls"),
    )


def calls_in_order(calls: DataFrame) -> DataFrame:
    """(analysis_id, calls): each analysis's calls by time, a few for each."""
    call = F.struct("ts", "agent_name", "model", "total_tokens", "cost_usd")
    return with_cost(calls).where(F.col("analysis_id").isNotNull()).groupBy("analysis_id").agg(F.sort_array(F.collect_list(call)).alias("calls"))
