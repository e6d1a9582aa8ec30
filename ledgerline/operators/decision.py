"""Decision logic: scenario probabilities, expected return, confidence, recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Return and probability of each scenario where none are usable (fixed values).
DEFAULTS = {"bull": (0.20, 0.30), "base": (0.05, 0.50), "bear": (-0.15, 0.20)}
ASSUMED_VOLATILITY = 0.3


def normalized(scenarios: DataFrame) -> DataFrame:
    """(symbol, name, ret, prob) with probabilities that sum to one.

    A symbol whose probabilities don't sum to more than zero, or of which one is null, gets the
    defaults. Other names than the three are left out.
    """
    three = scenarios.where(F.col("name").isin(*DEFAULTS))
    totals = three.groupBy("symbol").agg(F.sum(F.coalesce("prob", F.lit(0.0))).alias("total"), F.max(F.col("prob").isNull()).alias("broken"))
    # A symbol has three rows at most, so both sides of the join are alike in size and key.
    usable = totals.where((F.col("total") > 0) & ~F.col("broken"))
    kept = three.join(usable, "symbol").select("symbol", "name", "ret", (F.col("prob") / F.col("total")).alias("prob"))
    defaults = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("ret"), F.lit(p).alias("prob")) for n, (r, p) in DEFAULTS.items()))
    rest = totals.where(~((F.col("total") > 0) & ~F.col("broken"))).select("symbol", F.explode(defaults).alias("d")).select("symbol", "d.*")
    return kept.unionByName(rest)


def expected_return(scenarios: DataFrame) -> DataFrame:
    """(symbol, expected_return): sum of return times probability, missing as zero."""
    zero = F.lit(0.0)
    return scenarios.groupBy("symbol").agg(F.sum(F.coalesce("ret", zero) * F.coalesce("prob", zero)).alias("expected_return"))


def completeness(market: Column, macro: Column, risk: Column, scenarios: Column) -> Column:
    lack = lambda c, cost: F.when(F.coalesce(c, F.lit(False)), 0.0).otherwise(cost)
    return F.greatest(F.lit(0.0), F.lit(1.0) - lack(market, 0.3) - lack(macro, 0.2) - lack(risk, 0.2) - lack(scenarios, 0.3))


def confidence(complete: Column, volatility: Column) -> Column:
    calm = F.greatest(F.lit(0.0), 1 - F.coalesce(volatility, F.lit(ASSUMED_VOLATILITY)))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.3 * complete + 0.4 * 0.7 + 0.3 * calm)), 2)


def recommendation(expected: Column, volatility: Column) -> Column:
    vol = F.coalesce(volatility, F.lit(ASSUMED_VOLATILITY))
    return F.when(expected.isNull(), "Hold").when((expected > 0.10) & (vol < 0.4), "Buy").when((expected < -0.05) | (vol > 0.5), "Sell").otherwise("Hold")
