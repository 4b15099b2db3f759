"""Modulation index of each unit, the modulated set, and its share of all units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewise.functions.formats import percent
from tracewise.functions.keys import null_safe_join
from tracewise.operators.selection import quantiles
from tracewise.plans.lineage import checkpointed

UNIT = ["protocol", "k0", "k1"]
CUTOFFS = ("mean", "median", "half_std")


def modulation_index(windowed: DataFrame, denominators: DataFrame) -> DataFrame:
    """``protocol, k0, k1, mi`` of units with target events.

    ``windowed`` has the events of both sides inside the window; ``denominators`` has each unit's numbers of trials,
    ``n_target, n_reference``. The index is (t - r) / (t + r) of the rates; without reference events it is the target
    rate, 1 at most. A unit without denominators, and a division by no trials, is an error.
    """
    target = F.count_if(F.col("side") == "target")
    counts = windowed.groupBy(*UNIT).agg(target.alias("t"), F.count_if(F.col("side") == "reference").alias("r")).where("t > 0")
    held = null_safe_join(counts, denominators, UNIT, "left")
    known = F.when(F.col("n_target").isNull(), F.raise_error(F.lit("a unit has no trial counts"))).otherwise(F.col("n_target"))
    t = F.col("t").cast("double") / known
    r = F.col("r").cast("double") / F.col("n_reference")
    return held.select(*UNIT, F.when(F.col("r") == 0, F.least(t, F.lit(1.0))).otherwise((t - r) / (t + r)).alias("mi"))


def cutoffs(indices: DataFrame, kind: str) -> DataFrame:
    """``protocol, cutoff``: the mean, the median, or half the population's standard deviation of the indices.

    The median is exact for protocols of any size; it reads ``indices`` more than once.
    """
    if kind not in CUTOFFS:
        raise ValueError(f"cutoff must be one of {CUTOFFS}, got {kind!r}")
    if kind == "median":
        return quantiles(indices, ["protocol"], "mi", 0.5, "cutoff")
    return indices.groupBy("protocol").agg({"mean": F.avg("mi"), "half_std": F.stddev_pop("mi") * 0.5}[kind].alias("cutoff"))


def modulated_units(indices: DataFrame, kind: str) -> DataFrame:
    """Units whose index is above their protocol's cutoff. The indices are made once, and stored for the cutoff and the units."""
    indices = checkpointed(indices)
    return indices.join(cutoffs(indices, kind), "protocol").where("mi > cutoff").drop("cutoff")


def modulation_proportions(modulated: DataFrame, universe: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """``protocol, n_modulated, n_total, percent``; the universe is a list in which repeated units count.

    ``measured`` lists the protocols that indices were made for: those without a modulated unit have a row too.
    """
    total = universe.groupBy("protocol").agg(F.count("*").alias("n_total"))
    chosen = modulated.groupBy("protocol").agg(F.count("*").alias("n_modulated"))
    wanted = chosen if measured is None else measured.select("protocol").distinct().join(chosen, "protocol", "left")
    held = total.join(wanted, "protocol").select("protocol", F.coalesce("n_modulated", F.lit(0)).alias("n_modulated"), "n_total")
    return held.withColumn("percent", percent(F.col("n_modulated"), F.col("n_total")))


def ranked(indices: DataFrame) -> DataFrame:
    """Indices with their rank in the protocol, from the top."""
    return indices.withColumn("place", F.row_number().over(W.partitionBy("protocol").orderBy(F.desc("mi"), "k0", "k1")))
