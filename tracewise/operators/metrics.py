"""Event metrics per protocol, outcome and unit, and the values that comparisons are made on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.keys import null_safe_join

# Metric columns, and the outcomes that each family of protocols keeps, in order.
MEANS = ("peak", "ev_onset", "peak_time", "ev_offset", "ev_duration", "integral")
AXON_PROTOCOLS = ("task_axons", "NO_DREADDs")
AXON_OUTCOMES = ("CR", "miss", "cHIT", "nHIT", "HIT", "CATCH")
DENDRITE_OUTCOMES = ("CR", "miss", "cHIT", "nHIT", "HIT", "nCATCH", "cCATCH")
TYPES = {
    "reward": ("cHIT", "nHIT", "HIT", "Rew", "cRew", "nRew", "CATCH"),
    "stimulus": ("cHIT", "nHIT", "HIT", "Stim", "cStim", "nStim", "CATCH"),
}
POOL = {"reward": "Rew", "stimulus": "Stim"}
KEY = ["protocol", "outcome", "k0", "k1"]


def _passive() -> Column:
    return F.col("protocol").contains("passive")


def whitelisted(events: DataFrame, alignment: str) -> DataFrame:
    """Events with the outcome that counts for their protocol; others are left out."""
    axon = F.col("protocol").isin(*AXON_PROTOCOLS)
    merged = F.when(F.col("outcome").isin("cCATCH", "nCATCH"), F.lit("CATCH")).otherwise(F.col("outcome"))
    outcome = F.when(axon, merged).when(_passive(), F.col("history")).otherwise(F.col("outcome"))
    dendrite = DENDRITE_OUTCOMES + (("FA",) if alignment == "stimulus" else ())
    kept = F.when(axon, F.col("outcome").isin(*AXON_OUTCOMES)).when(_passive(), F.lit(True)).otherwise(F.col("outcome").isin(*dendrite))
    return events.withColumn("outcome", outcome).where(kept)


def pooled_outcomes(events: DataFrame, alignment: str) -> DataFrame:
    """Each event under its outcome, and again under the pooled outcomes that the name holds.

    An event that already has a pooled name stands there twice, on purpose.
    """
    pools = [F.when(F.col("outcome").contains(m), F.lit(m)) for m in ("HIT", POOL[alignment])]
    return events.withColumn("outcome", F.explode(F.array_compact(F.array(F.col("outcome"), *pools))))


def rate_denominators(trial_counts: DataFrame, alignment: str) -> DataFrame:
    """``protocol, session, outcome, n_trials``: each type's own count, and of a pooled name without one, the sum of all that hold it."""
    own = trial_counts.select("protocol", "session", F.col("ttype").alias("outcome"), F.col("n").alias("n_trials"))
    names = ("HIT", "Rew", "Stim", "CATCH")
    rows = trial_counts.select("protocol", "session", "n", F.explode(F.array_compact(F.array(*[F.when(F.col("ttype").contains(m), F.lit(m)) for m in names]))).alias("outcome"))
    pooled = rows.groupBy("protocol", "session", "outcome").agg(F.sum("n").alias("pooled"))
    held = pooled.join(own, ["protocol", "session", "outcome"], "full_outer")
    return held.select("protocol", "session", "outcome", F.coalesce("n_trials", "pooled").alias("n_trials"))


def metrics_by_unit(events: DataFrame, denominators: DataFrame, alignment: str, session: str = "k0") -> DataFrame:
    """Means and rate of each ``protocol, outcome, k0, k1`` of windowed, prepared events of both sides.

    ``session`` is the column with the session whose trials divide the count; it follows from the unit. Of an outcome that
    both sides have in a protocol, the reference side counts. Units without a denominator are an error.
    """
    grouped = events.groupBy("side", *dict.fromkeys([*KEY, session])).agg(*[F.avg(m).alias(m) for m in MEANS], F.count("*").alias("n_events"))
    grouped = grouped.where(F.col("outcome").isin(*TYPES[alignment]))
    both = grouped.groupBy("protocol", "outcome").agg(F.max(F.col("side") == "reference").alias("from_reference"))
    kept = grouped.join(both, ["protocol", "outcome"]).where(F.when(F.col("from_reference"), F.col("side") == "reference").otherwise(True))
    held = kept.withColumn("session", F.col(session)).join(denominators, ["protocol", "session", "outcome"], "left")
    known = F.when(F.col("n_trials").isNull(), F.raise_error(F.lit("an outcome has no trial count"))).otherwise(F.col("n_trials"))
    return held.select(*KEY, *MEANS, (F.col("n_events") / known).alias("rate"))


def fill_inactive(metrics: DataFrame, universe: DataFrame, denominators: DataFrame, session: str = "k0") -> DataFrame:
    """``metrics`` plus rate 0 for units without events, for each outcome of their protocol; null where no such trial ran."""
    outcomes = metrics.select("protocol", "outcome").distinct()
    units = universe.select("protocol", "k0", "k1", F.col(session).alias("session")).distinct()
    missing = null_safe_join(units.join(outcomes, "protocol"), metrics.select(*KEY), KEY, "left_anti")
    held = missing.join(denominators, ["protocol", "session", "outcome"], "left")
    return metrics.unionByName(held.select(*KEY, F.when(F.col("n_trials") > 0, 0.0).alias("rate")), allowMissingColumns=True)


def modulated_only(metrics: DataFrame, modulated: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Rows of modulated units; protocols without a modulated set stay whole.

    ``measured`` lists the protocols that have a set, even an empty one; by default those of ``modulated``.
    """
    unit = ["protocol", "k0", "k1"]
    listed = (modulated if measured is None else measured).select("protocol").distinct().withColumn("listed", F.lit(True))
    marked = metrics.join(listed, "protocol", "left")
    chosen = null_safe_join(marked, modulated.select(*unit).distinct().withColumn("chosen", F.lit(True)), unit, "left")
    return chosen.where(F.col("listed").isNull() | F.col("chosen")).drop("listed", "chosen")


def comparison_values(metrics: DataFrame, metric: str) -> DataFrame:
    """``protocol, outcome, k0, k1, value`` of one metric."""
    return metrics.groupBy(*KEY).agg(F.avg(metric).alias("value"))


def normalized(values: DataFrame, side: tuple[str, str], reference: tuple[str, str], offset: float = 0.0) -> DataFrame:
    """Values of one (protocol, outcome), less the offset, over the mean of the reference's less the offset."""
    of = lambda pair: (F.col("protocol") == pair[0]) & (F.col("outcome") == pair[1])
    mean = values.where(of(reference)).agg(F.avg(F.col("value") - offset).alias("scale"))
    return values.where(of(side)).crossJoin(F.broadcast(mean)).withColumn("value", (F.col("value") - offset) / F.col("scale")).drop("scale")
