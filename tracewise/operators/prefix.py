"""Running sums and numbers over ordered groups of any size: ranges are summed first, and their offsets joined back.

Rows are dealt to ranges of the order, so that a group of any size lies in many tasks. Each range sums its own rows; what
lies before a range comes from the sums of the group's other ranges, one row each. No task sees a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewise.plans.lineage import checkpointed

#: Names of the columns that ranges and offsets have meanwhile.
RANGE, OF = "__range", "__of_"


def ranges(rows: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """``rows`` plus ``__range``: ranges of keys and order, ascending within each key, of about equal size.

    Written once, so that all that is made of it sees the same ranges. Rows that agree in keys and order share a range.
    """
    by = [*keys, *order]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return checkpointed(dealt.withColumn(RANGE, F.spark_partition_id()))


def with_offsets(dealt: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """``dealt`` plus, for each name, the sum over all earlier ranges of the row's group; null keys are a group.

    The sums are one row for each range of a group; a running sum goes over these alone.
    """
    totals = dealt.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(f"{OF}{n}") for n, c in sums.items()])
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    held = totals.select(
        *[F.col(k).alias(f"{OF}{i}_key") for i, k in enumerate(keys)], F.col(RANGE).alias(f"{OF}range"), *[F.coalesce(F.sum(f"{OF}{n}").over(before), F.lit(0)).alias(n) for n in sums]
    )
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{OF}{i}_key")) for i, k in enumerate(keys)], F.col(RANGE) == F.col(f"{OF}range"))
    return dealt.join(held, on).drop(f"{OF}range", *[f"{OF}{i}_key" for i in range(len(keys))])


def running_sums(rows: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None, **sums: Column) -> DataFrame:
    """``rows`` plus, for each name, the sum of its column over the earlier rows of the group, in ``order``; 0 for the first.

    Rows that agree in keys and order stay in one range and come in any order: sum them beforehand, or order them further.
    """
    dealt = ranges(rows, keys, order, parts)
    before = W.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumns({f"{OF}own_{n}": F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    held = with_offsets(own, keys, **sums)
    return held.withColumns({n: F.col(n) + F.col(f"{OF}own_{n}") for n in sums}).drop(RANGE, *[f"{OF}own_{n}" for n in sums])


def numbered(rows: DataFrame, order: list[str | Column], out: str = "place", parts: int | None = None) -> DataFrame:
    """``rows`` plus each row's number in ``order`` over all rows, from 1. One shuffle; each task sorts its own range.

    Rows that agree in ``order`` share a range: where many can, order them further.
    """
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    # The number of a row within its range stands in the low 33 bits, that of the range above them.
    held = checkpointed(dealt.sortWithinPartitions(*order).withColumn(RANGE, F.monotonically_increasing_id()))
    held = held.withColumn(out, F.col(RANGE).bitwiseAND(F.lit((1 << 33) - 1)) + 1).withColumn(RANGE, F.shiftright(RANGE, 33))
    return with_offsets(held, [], **{f"{OF}n": F.lit(1)}).withColumn(out, F.col(out) + F.col(f"{OF}n")).drop(RANGE, f"{OF}n")
