"""Array expressions for traces: medians, integrals, runs above a threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_nan(y: str | Column) -> Column:
    """The array with NaN as null, so that comparisons are false and aggregates skip it."""
    return F.transform(y, lambda v: F.nanvl(v, F.lit(None).cast("double")))


def present(y: str | Column) -> Column:
    """The values that are neither null nor NaN."""
    return F.filter(y, lambda v: v.isNotNull() & ~F.isnan(v))


def part(y: str | Column, start: int, stop: int) -> Column:
    """Places ``start`` up to ``stop`` exclusive, counted from 0; empty if ``start`` is negative."""
    return F.slice(y, F.lit(start + 1), F.lit(max(0, stop - start))) if start >= 0 else F.slice(y, F.lit(1), F.lit(0))


def median(y: Column) -> Column:
    """Median of an array; null if it is empty or holds a null or NaN."""
    ordered, n = F.array_sort(y), F.size(y)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return F.when((n > 0) & ~F.exists(y, lambda v: v.isNull() | F.isnan(v)), middle)


def simpson(y: str | Column) -> Column:
    """Integral over unit steps by Simpson's rule.

    An even number of values gets the correction of the last step by the parabola through the last three; two values
    are a trapezium, one is nothing.
    """
    y = F.col(y) if isinstance(y, str) else y
    n = F.size(y)
    odd = n - F.when(n % 2 == 0, 1).otherwise(0)
    weight = lambda i: (
        F.when(i >= odd, 0.0).when((i == 0) | (i == odd - 1), 1 / 3).when(i % 2 == 1, 4 / 3).otherwise(2 / 3)
    )
    last = lambda i: F.when(n % 2 == 1, 0.0).when(i == n - 1, 5 / 12).when(i == n - 2, 2 / 3).when(i == n - 3, -1 / 12).otherwise(0.0)
    whole = F.aggregate(F.transform(y, lambda v, i: v * (weight(i) + last(i))), F.lit(0.0), lambda s, v: s + v)
    return F.when(n == 1, 0.0).when(n == 2, (F.get(y, F.lit(0)) + F.get(y, F.lit(1))) / 2).otherwise(whole)


def segments(y: str | Column, lower: Column) -> Column:
    """Maximal stretches of values above ``lower`` and of others, as an array of ``start, size, above``.

    Null and NaN are not above. Whole arrays are only arguments here, never inside a lambda, where they would be made
    again for every element.
    """
    y = F.col(y) if isinstance(y, str) else y
    high = F.transform(y, lambda v: F.coalesce((v > lower) & ~F.isnan(v), F.lit(False)))
    before = F.concat(F.array(F.lit(None).cast("boolean")), high)
    edges = F.zip_with(high, before, lambda h, b: F.struct(h.alias("above"), (~h.eqNullSafe(b)).alias("edge")))
    placed = F.transform(edges, lambda e, i: F.struct(i.alias("start"), e["above"].alias("above"), (e["edge"] & e["above"].isNotNull()).alias("edge")))
    fronts = F.filter(placed, lambda p: p["edge"])
    ends = F.concat(F.transform(F.slice(fronts, 2, F.greatest(F.size(fronts) - 1, F.lit(0))), lambda p: p["start"]), F.array(F.size(y)))
    found = F.zip_with(fronts, ends, lambda p, e: F.struct(p["start"].alias("start"), (e - p["start"]).alias("size"), p["above"].alias("above")))
    return F.when(F.size(y) > 0, found).otherwise(F.array().cast("array<struct<start:int,size:int,above:boolean>>"))


def first_peak(y: Column) -> Column:
    """Place of the first maximum."""
    return F.array_position(y, F.array_max(y)).cast("int") - 1
