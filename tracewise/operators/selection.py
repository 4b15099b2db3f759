"""Exact quantiles of groups of any size, by histograms that narrow down on them.

A round counts the values of all groups in a fixed number of bins between two bounds of each group's quantile, by partial
sums, and takes the bin that holds it: its least and greatest value are the next bounds. Rounds alternate between bins of
equal width and of equal ratio, so that neither a long tail nor one narrow peak makes many of them; they are over when the
bounds are one value. What is held is a row for each bin of a group; values are only counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewise.plans.lineage import checkpointed

#: Bins of a round.
BINS = 1024
#: Groups of up to so many values are left to ``percentile``, which holds a group's distinct values in one buffer.
BUFFERED = 1_000_000
_LARGEST = 1.7976931348623157e308


def _octaves(v: Column) -> Column:
    """A scale of signed ratios that rises with ``v``: its logarithm, from the least double on, with the sign."""
    size = F.log2(F.abs(v)) + 1075
    return F.when(v == 0, 0.0).when(v > 0, size).otherwise(-size)


def _share(v: Column, low: Column, high: Column) -> Column:
    """Where ``v`` lies between the bounds, from 0 to 1; 0 if they are equal."""
    gap = high - low
    near, far = F.try_divide(v - low, gap), F.try_divide(v / 2 - low / 2, high / 2 - low / 2)
    return F.coalesce(F.when(F.abs(gap) <= _LARGEST, near).otherwise(far), F.lit(0.0))


def _bin(by_ratio: bool) -> Column:
    """The bin of ``v``: endless values and NaN, which is above all, have their own."""
    v = F.col("__v")
    low, high = F.greatest(F.col("__low"), F.lit(-_LARGEST)), F.least(F.col("__high"), F.lit(_LARGEST))
    share = _share(_octaves(v), _octaves(low), _octaves(high)) if by_ratio else _share(v, low, high)
    inner = F.least(F.floor(share * BINS), F.lit(BINS - 1))
    return F.when(F.isnan("__v"), BINS + 1).when(v > _LARGEST, BINS).when(v < -_LARGEST, -1).otherwise(inner)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[f"__of_{k}"]) for k in keys], F.lit(True))


def narrowed(rows: DataFrame, keys: list[str], value: str, q: float = 0.5, out: str = "quantile") -> DataFrame:
    """The quantile of each group by narrowing, whatever the groups' sizes."""
    held = checkpointed(rows.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null"))
    place = (F.col("__n") - 1) * F.lit(float(q))
    sizes = held.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    both = F.array_distinct(F.array(F.floor(place), F.ceil(place)))
    open_ = checkpointed(sizes.select(*keys, place.alias("__place"), F.explode(both).alias("__k"), F.lit(0).cast("long").alias("__below"), "__low", "__high"))
    by_ratio = False
    while not (live := open_.where("__low <> __high")).isEmpty():
        of = live.withColumnsRenamed({k: f"__of_{k}" for k in keys})
        inside = held.join(of, _same(held, of, keys) & (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))
        target = [*keys, "__place", "__k", "__below"]
        counts = inside.groupBy(*target, _bin(by_ratio).alias("__bin")).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        up = W.partitionBy(*keys, "__k").orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)
        found = counts.withColumn("__through", F.col("__below") + F.sum("__n").over(up)).where("__through > __k and __through - __n <= __k")
        found = found.select(*keys, "__place", "__k", (F.col("__through") - F.col("__n")).alias("__below"), "__low", "__high")
        open_, by_ratio = checkpointed(open_.where("__low = __high").union(found)), not by_ratio
    first, last = F.min_by("__low", "__k"), F.max_by("__low", "__k")
    # As ``percentile`` has it: the two values at either side of the place, by their distance.
    mixed = (F.max("__k") - F.first("__place")) * first + (F.first("__place") - F.min("__k")) * last
    return open_.groupBy(*keys).agg(F.when(first == last, first).otherwise(mixed).alias(out))


def quantiles(rows: DataFrame, keys: list[str], value: str, q: float = 0.5, out: str = "quantile", buffered: int = BUFFERED) -> DataFrame:
    """``keys`` and the exact quantile of ``value`` in each group, as ``percentile`` gives it; null values are left out.

    Groups are counted first: only where one has more than ``buffered`` values are they narrowed down on. ``rows`` are read
    several times, and should be stored.
    """
    most = rows.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > buffered:
        return narrowed(rows, keys, value, q, out)
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.lit(float(q))).alias(out))
