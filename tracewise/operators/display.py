"""The data behind figures: onset histograms, mean traces, trial order, strips of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value; bins are half open but for the last. Null outside."""
    step = (high - low) / bins
    edge = lambda i: F.lit(low) + i * F.lit(step)
    at = F.floor((x - low) / step)
    # A value that division puts beside the edge it stands on goes by the edge.
    at = F.when(x < edge(at), at - 1).when(x >= edge(at + 1), at + 1).otherwise(at)
    return F.when((x >= low) & (x <= high), F.least(at, F.lit(bins - 1)).cast("int"))


def onset_histogram(events: DataFrame, totals: DataFrame, low: float = 5.0, high: float = 6.5, bins: int = 15, unit_counts: DataFrame | None = None) -> DataFrame:
    """``protocol, side, bin, n_events, weight``: events by onset, each over its side's trials and, if given, the protocol's units.

    ``totals`` has ``protocol, n_target, n_reference``; ``unit_counts`` has ``protocol, n_units``. Bins are counted before
    the weights come in, so only one row per bin meets them.
    """
    counted = events.withColumn("bin", bin_of(F.col("ev_onset"), low, high, bins)).where("bin is not null").groupBy("protocol", "side", "bin").agg(F.count("*").alias("n_events"))
    held = counted.join(totals, "protocol")
    trials = F.when(F.col("side") == "target", F.col("n_target")).otherwise(F.col("n_reference"))
    share = 1 / trials
    if unit_counts is not None:
        held, share = held.join(unit_counts, "protocol"), share / F.col("n_units")
    return held.select("protocol", "side", "bin", "n_events", (F.col("n_events") * share).alias("weight"))


def mean_trace(traces: DataFrame, unit: list[str] | None = None) -> DataFrame:
    """``frame, mean, n`` of each unit over its trials."""
    unit = unit or ["session", "roi"]
    frames = traces.select(*unit, F.posexplode("y").alias("frame", "v")).where("not isnan(v)")
    return frames.groupBy(*unit, "frame").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def waterfall_order(traces: DataFrame, events: DataFrame, unit: list[str] | None = None) -> DataFrame:
    """Trials of each unit in the order of a waterfall: those with an event first, each in ``row_ord``; narrow rows only."""
    unit = unit or ["session", "roi"]
    hit = events.select(*unit, "trial").distinct().withColumn("is_event", F.lit(True))
    held = traces.select(*unit, "trial", "row_ord").join(hit, [*unit, "trial"], "left").withColumn("is_event", F.coalesce("is_event", F.lit(False)))
    order = W.partitionBy(*unit).orderBy(F.when(F.col("is_event"), 0).otherwise(1), "row_ord")
    return held.withColumn("place", F.row_number().over(order) - 1)


def strip_values(values: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``protocol, outcome, n, mean, sem`` and the sorted ``values`` of each bar; one value has no spread and an SEM of 0.

    A bar has a value for each of its units.
    """
    wanted = F.lit(False)
    for protocol, outcome in pairs:
        wanted = wanted | ((F.col("protocol") == protocol) & (F.col("outcome") == outcome))
    sem = F.when(F.count("value") > 1, F.stddev_samp("value") / F.sqrt(F.count("value"))).otherwise(0.0)
    rows = values.where(wanted & F.col("value").isNotNull()).groupBy("protocol", "outcome")
    return rows.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), sem.alias("sem"), F.sort_array(F.collect_list("value")).alias("values"))
