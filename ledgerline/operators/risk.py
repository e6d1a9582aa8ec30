"""Risk analytics: volatility, beta, drawdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.prices import by_date, enriched

TRADING_DAYS = 252


def volatility(bars: DataFrame) -> DataFrame:
    """(symbol, volatility): sample deviation of daily returns, annualised."""
    return enriched(bars).groupBy("symbol").agg((F.stddev_samp("ret") * F.sqrt(F.lit(TRADING_DAYS))).alias("volatility"))


def paired_returns(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(symbol, dt, sr, br): returns of symbol and benchmark over the dates that both have.

    The benchmark has a row a day, so it is small beside the bars; the optimizer broadcasts it where
    its statistics allow.
    """
    both = bars.join(benchmark.select("dt", F.col("close").alias("b_close")), "dt")
    change = lambda c: F.try_divide(F.col(c), F.lag(c).over(by_date())) - 1
    return both.select("symbol", "dt", change("close").alias("sr"), change("b_close").alias("br")).dropna(subset=["sr", "br"])


def beta(bars: DataFrame, benchmark: DataFrame, textbook: bool = False) -> DataFrame:
    """(symbol, beta): sample covariance over population variance; textbook divides like by like."""
    variance = F.var_samp("br") if textbook else F.var_pop("br")
    return paired_returns(bars, benchmark).groupBy("symbol").agg(F.try_divide(F.covar_samp("sr", "br"), variance).alias("beta"))


def max_drawdown(bars: DataFrame) -> DataFrame:
    """(symbol, max_drawdown_pct) as a positive percentage of the running maximum."""
    return enriched(bars).groupBy("symbol").agg((F.abs(F.min("drawdown")) * 100).alias("max_drawdown_pct"))


def severity(percent: Column) -> Column:
    return F.when(percent.isNull(), "Unknown").when(percent < 10, "Low").when(percent < 20, "Medium").when(percent < 30, "High").otherwise("Very High")


def with_benchmark(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """bars with b_close, the benchmark's close of the day or null."""
    return bars.join(benchmark.select("dt", F.col("close").alias("b_close")), "dt", "left")


def with_paired_returns(both: DataFrame) -> DataFrame:
    """Adds sr and br, the returns over the days that the benchmark has too."""
    shared = F.when(F.col("b_close").isNotNull(), F.col("close"))
    before = by_date().rowsBetween(Window.unboundedPreceding, -1)
    change = lambda c: F.try_divide(c, F.last(c, ignorenulls=True).over(before)) - 1
    return both.withColumns({"sr": change(shared), "br": change(F.col("b_close"))})


def aggregates() -> list[Column]:
    """Volatility, beta and drawdown of rows with ret, sr, br and drawdown."""
    paired = F.col("sr").isNotNull() & F.col("br").isNotNull()
    sr, br = F.when(paired, F.col("sr")), F.when(paired, F.col("br"))
    return [
        (F.stddev_samp("ret") * F.sqrt(F.lit(TRADING_DAYS))).alias("volatility"), F.try_divide(F.covar_samp(sr, br), F.var_pop(br)).alias("beta"),
        (F.abs(F.min("drawdown")) * 100).alias("max_drawdown_pct"),
    ]


def risk_metrics(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(symbol, volatility, beta, max_drawdown_pct, severity): one pass of windows over one exchange.

    Volatility and drawdown come from all bars, beta from the dates that the benchmark has.
    """
    rows = with_paired_returns(enriched(with_benchmark(bars, benchmark)))
    return rows.groupBy("symbol").agg(*aggregates()).withColumn("severity", severity(F.col("max_drawdown_pct")))
