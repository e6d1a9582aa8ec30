"""Number formats and labels of reports."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, decimals: int, sign: str = "") -> Column:
    """A double's digits with decimals rounded by its exact value, ties to even, as printf does it below 1e13; null is null.

    format_string rounds the shortest decimal form instead: 2.985, a little less as a double, becomes 2.99.
    Without decimals both forms are the same and halves leave zero, as in SQL's round.
    """
    digits = F.format_string(f"%{sign}.{decimals}f", value)
    if decimals:
        plain = "0." + "0" * decimals
        digits = F.when(F.abs(value) < math.inf, F.call_function("format_number", value, F.lit(f"{sign}{plain};-{plain}"))).otherwise(digits)
    return F.when(value.isNotNull(), digits)


def magnitude(value: Column) -> Column:
    """T, B or M with two decimals, else currency; null is N/A."""
    unit = lambda size, letter: F.concat(F.lit("$"), fixed(value / size, 2), F.lit(letter))
    return F.when(value.isNull(), "N/A").when(value >= 1e12, unit(1e12, "T")).when(value >= 1e9, unit(1e9, "B")).when(value >= 1e6, unit(1e6, "M")).otherwise(currency(value))


def currency(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value, 2)), F.lit("N/A"))


def ratio_percent(value: Column, decimals: int = 2) -> Column:
    return F.coalesce(F.concat(fixed(value * 100, decimals), F.lit("%")), F.lit("N/A"))


def signed_percent(value: Column, decimals: int = 0) -> Column:
    return F.concat(fixed(F.coalesce(value, F.lit(0.0)) * 100, decimals, "+"), F.lit("%"))


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    short = lambda rest: F.concat(fixed(rest, 1), F.lit("s"))
    return F.when(seconds >= 60, F.concat(minutes.cast("string"), F.lit("m "), short(seconds - minutes * 60))).otherwise(short(seconds))


def variant(label: Column, kinds: dict[str, str], default: str) -> Column:
    """Category map with a default."""
    out = F.lit(default)
    for name, kind in kinds.items():
        out = F.when(label == name, kind).otherwise(out)
    return out


#: Fixed category maps.
RECOMMENDATION_KINDS = {"Buy": "success", "Sell": "danger", "Hold": "warning"}
SCENARIO_KINDS = {"bull": "success", "base": "info", "bear": "danger"}


def step_kind(step: Column) -> Column:
    """Severity of a progress step, by what its name holds."""
    lower = F.lower(step)
    stage = lower.rlike("market|macro|risk|scenario|memo")
    return F.when(lower.contains("error"), "danger").when(lower.rlike("ok|complete"), "success").when(stage, "info").otherwise("secondary")
