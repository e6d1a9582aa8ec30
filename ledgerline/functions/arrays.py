"""Array expressions that evaluate each part once, however large the arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold of running sums copies at most.
FOLD = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: inside a lambda, and where use names it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, n: s + n)


def _short_sums(numbers: Column, start: Column) -> Column:
    """Running sums from start on; the fold copies its result at each step, so it is for short arrays."""
    first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("all"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"] + n)).alias("all"))
    return F.aggregate(numbers, first, step, lambda s: s["all"])


def running_sums(numbers: Column) -> Column:
    """Running sums of an array of whole numbers: of stretches of FOLD first, then within each."""

    def stretches(x: Column) -> Column:
        n = F.ceil(F.size(x) / FOLD).cast("int")
        own = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(x, i * FOLD + 1, FOLD).cast("array<bigint>"))
        return F.when(n > 0, own).otherwise(F.array().cast("array<array<bigint>>"))

    def summed(s: Column) -> Column:
        ends = _short_sums(F.transform(s, total), F.lit(0).cast("long"))
        return F.flatten(F.zip_with(s, ends, lambda x, end: _short_sums(x, end - total(x))))

    return bound(numbers, lambda x: bound(stretches(x), summed))


def places(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end) in characters, end exclusive; the text is read only if it has one.

    The pieces between the matches and the matches themselves take turns, so their lengths add up to
    the places. A pattern must not match the empty text.
    """
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = lambda m: F.zip_with(F.slice(between, F.lit(1), F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
    spans = bound(matches, lambda m: F.zip_with(running_sums(sizes(m)), m, lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end"))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))
