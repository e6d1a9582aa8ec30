"""Indicators that are recursions over a symbol's closes, as a blocked scan.

A symbol's history is cut into blocks by time. Each block's recursion, begun at zero, is an affine map
of the state before it: powers of the decay times that state, plus what the block itself adds. The
blocks are folded where they lie; only their maps, some numbers each, meet in the order of time to be
composed. So no history is one array, and a symbol with very many bars is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a block where bars are daily; other bars need a block of their own choice.
BLOCK_DAYS = 512
FAST, SLOW, SMOOTH, CHANGES = 12, 26, 9, 14


def block_of(dt: Column) -> Column:
    return F.floor(F.unix_date(dt.cast("date")) / BLOCK_DAYS)


def decay(span: int) -> float:
    """What an exponential average of a span keeps of itself at each step."""
    return 1 - 2.0 / (span + 1)


def _averages(closes: Column) -> Column:
    """The averages and their smoothed difference after a block that begins at zero."""

    def step(s: Column, x: Column) -> Column:
        f, g = s["fast"] * decay(FAST) + x * (1 - decay(FAST)), s["slow"] * decay(SLOW) + x * (1 - decay(SLOW))
        return F.struct(f.alias("fast"), g.alias("slow"), (s["signal"] * decay(SMOOTH) + (f - g) * (1 - decay(SMOOTH))).alias("signal"))

    return F.aggregate(closes, F.struct(*(F.lit(0.0).alias(c) for c in ("fast", "slow", "signal"))), step)


def _moves(closes: Column) -> Column:
    """Smoothed rises and falls after a block's own changes, begun at zero."""
    r = 1 - 1.0 / CHANGES

    def step(s: Column, x: Column) -> Column:
        move = x - s["last"]
        up, down = F.greatest(move, F.lit(0.0)), F.greatest(-move, F.lit(0.0))
        return F.struct(x.alias("last"), (s["up"] * r + up / CHANGES).alias("up"), (s["down"] * r + down / CHANGES).alias("down"))

    first = F.struct(F.element_at(closes, 1).alias("last"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    return F.aggregate(F.slice(closes, F.lit(2), F.size(closes)), first, step)


def blocks(bars: DataFrame, block: Column | None = None) -> DataFrame:
    """(symbol, block, n, first, averages, moves, head) of each block of closes; missing closes are left out.

    block: a number that grows with dt, BLOCK_DAYS days if not given. head is its first closes, as many
    as the first average of changes needs.
    """
    kept = bars.where(F.col("close").isNotNull() & ~F.isnan("close")).select("symbol", "dt", F.col("close").cast("double").alias("close"), (block_of(F.col("dt")) if block is None else block).alias("block"))
    closes = F.transform(F.sort_array(F.collect_list(F.struct("dt", "close"))), lambda x: x["close"])
    grouped = kept.groupBy("symbol", "block").agg(closes.alias("closes"))
    c = F.col("closes")
    return grouped.select("symbol", "block", F.size(c).alias("n"), F.element_at(c, 1).alias("first"), _averages(c).alias("averages"), _moves(c).alias("moves"), F.slice(c, 1, CHANGES + 1).alias("head"))


def indicators(bars: DataFrame, block: Column | None = None) -> DataFrame:
    """(symbol, macd, rsi) at the last close: macd is (line, signal), rsi Wilder's index, null with fewer than 14 changes.

    Averages start at the first close; the first averages of rises and falls are means of 14 changes.
    """
    ordered = blocks(bars, block).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("block", "n", "first", "averages", "moves", "head"))).alias("all"))
    rf, rs, rg, r = decay(FAST), decay(SLOW), decay(SMOOTH), 1 - 1.0 / CHANGES

    def leaned(rate: float, n: Column) -> Column:
        """How much of an average before a block has gone into the smoothed difference after it."""
        return (1 - rg) * rate / (rate - rg) * (F.pow(F.lit(rate), n) - F.pow(F.lit(rg), n))

    def step(s: Column, b: Column) -> Column:
        n, a, m = b["n"], b["averages"], b["moves"]
        move = F.coalesce(b["first"] - s["last"], F.lit(0.0))
        joined = lambda name, sign: F.pow(F.lit(r), n - 1) * (s[name] * r + F.greatest(move * sign, F.lit(0.0)) / CHANGES) + m[name]
        return F.struct(
            (F.pow(F.lit(rf), n) * s["fast"] + a["fast"]).alias("fast"), (F.pow(F.lit(rs), n) * s["slow"] + a["slow"]).alias("slow"),
            (F.pow(F.lit(rg), n) * s["signal"] + leaned(rf, n) * s["fast"] - leaned(rs, n) * s["slow"] + a["signal"]).alias("signal"),
            m["last"].alias("last"), joined("up", 1).alias("up"), joined("down", -1).alias("down"), (s["n"] + n).alias("n"),
            F.when(F.size(s["head"]) > CHANGES, s["head"]).otherwise(F.slice(F.concat(s["head"], b["head"]), 1, CHANGES + 1)).alias("head"),
        )

    first = F.get("all", F.lit(0))["first"]
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    start = F.struct(first.alias("fast"), first.alias("slow"), zero.alias("signal"), none.alias("last"), zero.alias("up"), zero.alias("down"), F.lit(0).alias("n"), F.array().cast("array<double>").alias("head"))
    end = ordered.select("symbol", F.aggregate("all", start, step).alias("s")).select("symbol", "s.*")

    # The scan has smoothed the first changes one by one; their mean, as it would have faded, takes their place.
    changes = F.zip_with(F.slice("head", 2, CHANGES), F.slice("head", 1, CHANGES), lambda b, a: b - a)

    def corrected(name: str, sign: int) -> Column:
        faded = lambda k: F.pow(F.lit(r), F.col("n") - 1 - k)
        share = F.transform(changes, lambda x, i: F.greatest(x * sign, zero) * (faded(F.lit(CHANGES)) - faded(i + 1)) / CHANGES)
        return F.col(name) + F.aggregate(share, zero, lambda s, x: s + x)

    both = end.withColumns({"u": corrected("up", 1), "w": corrected("down", -1)})
    index = F.when(F.col("u") + F.col("w") == 0, 50.0).otherwise(100 * F.try_divide("u", F.col("u") + F.col("w")))
    return both.select("symbol", F.struct((F.col("fast") - F.col("slow")).alias("line"), F.col("signal").alias("signal")).alias("macd"), F.when(F.col("n") > CHANGES, index).alias("rsi"))


def macd_signal(value: Column) -> Column:
    return F.when(value["line"] > value["signal"], "Bullish").when(value["line"].isNotNull(), "Bearish")
