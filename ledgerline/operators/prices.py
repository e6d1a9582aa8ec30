"""Price analytics: returns, moving averages, bands, trends. All symbols in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_date():
    """Rows of a symbol in the order of dates."""
    return Window.partitionBy("symbol").orderBy("dt")


def moving(c: Column, rows: int, f=F.avg) -> Column:
    """f over the last `rows` rows, null until there are that many."""
    frame = by_date().rowsBetween(1 - rows, 0)
    return F.when(F.count(F.lit(1)).over(frame) >= rows, f(c).over(frame))


def enriched(bars: DataFrame) -> DataFrame:
    """bars with return, moving averages, bands and running maximum: one exchange and one sort."""
    close = F.when(~F.isnan("close"), F.col("close"))
    out = bars.withColumn("close", close).withColumns({
        "ret": F.try_divide("close", F.lag("close").over(by_date())) - 1,
        "sma_50": moving(F.col("close"), 50), "sma_200": moving(F.col("close"), 200),
        "mid_20": moving(F.col("close"), 20), "sd_20": moving(F.col("close"), 20, F.stddev_pop),
        "run_max": F.max("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0)),
    })
    return out.withColumns({"upper_20": F.col("mid_20") + 2 * F.col("sd_20"), "lower_20": F.col("mid_20") - 2 * F.col("sd_20"), "drawdown": F.try_divide(F.col("close") - F.col("run_max"), F.col("run_max"))})


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each symbol; only the columns asked for travel with it."""
    values = [c for c in rows.columns if c != "symbol"]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*values), "dt").alias("last")).select("symbol", "last.*")


def ma_signal(price: Column, short: Column, long: Column) -> Column:
    """Bullish or Bearish if price and averages are in line, else Neutral; zero counts as missing."""
    known = (short != 0) & (long != 0)
    return F.when(known & (price > short) & (short > long), "Bullish").when(known & (price < short) & (short < long), "Bearish").otherwise("Neutral")


def band_signal(price: Column, upper: Column, lower: Column) -> Column:
    return F.when(price > upper, "Overbought").when(price < lower, "Oversold")


def percent_change(start: Column, end: Column) -> Column:
    return F.try_divide(end - start, start) * 100


def trend_label(change: Column, months: int) -> Column:
    name = F.when(change > 5, "Upward").when(change < -5, "Downward").otherwise("Sideways")
    return F.concat(name, F.lit(f" ({months}M)"))


def price_trend(bars: DataFrame, months: int = 6) -> DataFrame:
    """(symbol, change_pct, trend) over the last months * 21 rows; fewer than two are insufficient."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))
    kept = bars.select("symbol", "dt", "close", newest.alias("rn")).where(F.col("rn") <= months * 21)
    ends = kept.groupBy("symbol").agg(F.min_by("close", "dt").alias("first"), F.max_by("close", "dt").alias("last"), F.count("*").alias("n"))
    change = percent_change(F.col("first"), F.col("last"))
    return ends.select("symbol", change.alias("change_pct"), F.when(F.col("n") < 2, "Insufficient data").otherwise(trend_label(change, months)).alias("trend"))


def range_position(price: Column, high: Column, low: Column) -> Column:
    """Place of the price between low and high; null if any is missing or zero, or the range is."""
    known = (price != 0) & (high != 0) & (low != 0) & (high != low)
    return F.when(known, F.try_divide(price - low, high - low))


def range_label(position: Column) -> Column:
    return F.when(position > 0.7, "Near high").when(position < 0.3, "Near low").when(position.isNotNull(), "Mid range")
