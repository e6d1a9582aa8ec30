"""The full report: market, risk, macro, scenarios and decision of every symbol in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import formats
from ledgerline.operators import decision, macro, model_steps, prices, prompts, recursive, risk


def market(bars: DataFrame) -> DataFrame:
    """(symbol, dt, price, sma_50, sma_200, ma_signal, band_signal) at each symbol's newest bar."""
    last = prices.latest(prices.enriched(bars).select("symbol", "dt", "close", "sma_50", "sma_200", "upper_20", "lower_20"))
    price = F.col("close")
    return last.select(
        "symbol", "dt", price.alias("price"), "sma_50", "sma_200",
        prices.ma_signal(price, F.col("sma_50"), F.col("sma_200")).alias("ma_signal"),
        prices.band_signal(price, F.col("upper_20"), F.col("lower_20")).alias("band_signal"),
    )


def market_data(bars: DataFrame, months: int = 6, year: int = 252) -> DataFrame:
    """A row a symbol: market state, RSI, MACD, place in the year's range and price trend.

    RSI and MACD are a blocked scan over all bars; range and trend look at the last ones alone.
    """
    found = market(bars).join(recursive.indicators(bars), "symbol").join(last_closes(bars, max(year, months * 21)), "symbol")
    found = found.withColumns({"year": tail("closes", year), "part": tail("closes", months * 21)})
    position = prices.range_position(F.col("price"), F.array_max("year"), F.array_min("year"))
    change = prices.percent_change(F.element_at("part", 1), F.element_at("part", -1))
    return found.select(
        "symbol", "dt", "price", "sma_50", "sma_200", "ma_signal", "band_signal", "rsi", F.col("macd.line").alias("macd_line"), F.col("macd.signal").alias("macd_smooth"),
        recursive.macd_signal(F.col("macd")).alias("macd_signal"), F.array_max("year").alias("high_52w"), F.array_min("year").alias("low_52w"), position.alias("position"), prices.range_label(position).alias("range_label"),
        change.alias("change_pct"), F.when(F.size("part") < 2, "Insufficient data").otherwise(prices.trend_label(change, months)).alias("trend"),
    )


def last_closes(bars: DataFrame, n: int) -> DataFrame:
    """(symbol, closes): the last n closes that aren't missing, in the order of dates; only those are shuffled whole."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))
    kept = bars.where(F.col("close").isNotNull() & ~F.isnan("close")).select("symbol", "dt", "close", newest.alias("rn")).where(F.col("rn") <= n)
    return kept.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("dt", "close"))), lambda x: x["close"]).alias("closes"))


def tail(array: str, n: int):
    """The last n elements."""
    return F.slice(array, F.greatest(F.size(array) - n, F.lit(0)) + 1, n)


def memo_values(scenarios: list[str]) -> dict:
    """Placeholders of the memo template over report rows with (name_return, name_prob) of each scenario; missing ones are N/A."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    values = {"ticker": F.col("symbol"), "recommendation": F.col("recommendation"), "confidence": formats.ratio_percent(F.col("confidence"), 0)}
    values |= {"price_trend": told("trend"), **{c: told(c) for c in ("interest_rate_trend", "market_trend", "volatility", "beta")}}
    for name in scenarios:
        values |= {f"{name}_return": formats.signed_percent(F.col(f"{name}_return")), f"{name}_prob": formats.ratio_percent(F.coalesce(f"{name}_prob", F.lit(0.0)), 0)}
    return values


def memo(rows: DataFrame, scenarios: DataFrame, templates: DataFrame, models: list, name: str = "memo_writer") -> DataFrame:
    """rows of report() with memo: the rendered template's answer by the first model that gives one.

    scenarios: (symbol, name, ret, prob), normalised. Where every model fails memo is null and
    memo_outcome says so.
    """
    names = ["bull", "base", "bear"]
    wide = scenarios.groupBy("symbol").agg(*(F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{n}_{long}") for n in names for c, long in (("ret", "return"), ("prob", "prob"))))
    asked = prompts.render(rows.join(wide, "symbol", "left"), templates, name, memo_values(names))
    return model_steps.with_fallback(asked, "prompt", models, "memo")


def macro_row(series: DataFrame, sectors: DataFrame) -> DataFrame:
    """One row: interest_rate_trend, inflation_trend, market_trend; each side is one row by aggregation."""
    rate = macro.rate_trend(series).agg(F.max("trend").alias("interest_rate_trend"))
    inflation = macro.inflation_trend(series).agg(F.max("trend").alias("inflation_trend"))
    trend = macro.market_trend(macro.sector_performance(sectors)).select("market_trend")
    return rate.crossJoin(inflation).crossJoin(trend)


def symbol_metrics(bars: DataFrame, benchmark: DataFrame, months: int = 6) -> DataFrame:
    """Market state, risk and trend of each symbol from one scan: one exchange by symbol, then one aggregation."""
    rows = risk.with_paired_returns(prices.enriched(risk.with_benchmark(bars, benchmark)))
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))
    recent = F.when(newest <= months * 21, F.col("dt"))
    rows = rows.withColumn("recent", recent)
    ends = {"first": F.min_by("close", "recent"), "final": F.max_by("close", "recent"), "n": F.count("recent")}
    last = F.max_by(F.struct("dt", "close", "sma_50", "sma_200", "upper_20", "lower_20"), "dt").alias("last")
    found = rows.groupBy("symbol").agg(last, *risk.aggregates(), *(c.alias(n) for n, c in ends.items())).select("*", "last.*").drop("last")
    price, change = F.col("close"), prices.percent_change(F.col("first"), F.col("final"))
    return found.select(
        "symbol", "dt", price.alias("price"), "sma_50", "sma_200",
        prices.ma_signal(price, F.col("sma_50"), F.col("sma_200")).alias("ma_signal"), prices.band_signal(price, F.col("upper_20"), F.col("lower_20")).alias("band_signal"),
        "volatility", "beta", "max_drawdown_pct", risk.severity(F.col("max_drawdown_pct")).alias("severity"), change.alias("change_pct"),
        F.when(F.col("n") < 2, "Insufficient data").otherwise(prices.trend_label(change, months)).alias("trend"),
    )


def report(bars: DataFrame, benchmark: DataFrame, series: DataFrame, sectors: DataFrame, scenarios: DataFrame) -> DataFrame:
    """A row a symbol with every stage's result and the decision."""
    expected = decision.expected_return(decision.normalized(scenarios))
    rows = symbol_metrics(bars, benchmark).join(expected, "symbol", "left").crossJoin(F.broadcast(macro_row(series, sectors)))
    complete = decision.completeness(F.col("price").isNotNull(), F.col("market_trend") != "Unknown", F.col("volatility").isNotNull(), F.col("expected_return").isNotNull())
    return rows.withColumns({"confidence": decision.confidence(complete, F.col("volatility")), "recommendation": decision.recommendation(F.col("expected_return"), F.col("volatility"))})


def analyze(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """Valid requests (symbol, horizon, risk_profile) with their report; others carry their error."""
    from ledgerline.operators.resolve import validated

    checked = validated(requests).withColumn("symbol", F.upper(F.trim("symbol")))
    return checked.join(reports, (checked["symbol"] == reports["symbol"]) & checked["error"].isNull(), "left").drop(reports["symbol"])
