"""A whole analysis: from converted tables and event files to modulation, comparisons, histograms and latencies."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions.formats import describe_comparison
from tracewise.operators import display, grouping, latency, metrics, modulation, stats
from tracewise.operators.recipes import RECIPES, regenerate
from tracewise.operators.windows import events_in_epoch
from tracewise.plans.lineage import checkpointed
from tracewise.plans.specs import CohortConfig, ComparisonSpec, EpochSpec
from tracewise.sources.event_files import FREQUENCY_GLOBS, SUFFIXES, read_event_folder, read_frequencies

PREFIX = "non-consecutive-normalized "


@dataclass(frozen=True)
class Inputs:
    """What an analysis reads: events of both sides by ``stem`` and ``side``, frequency files, converted tables."""

    files: DataFrame
    frequencies: DataFrame
    tables: Mapping[str, DataFrame]


@dataclass(frozen=True)
class Outputs:
    """What an analysis makes. ``results`` is None without comparisons."""

    events: DataFrame
    counts: DataFrame
    totals: DataFrame
    universe: DataFrame
    measured: DataFrame
    modulated: DataFrame
    proportions: DataFrame
    results: DataFrame | None
    histogram: DataFrame


def read_inputs(spark: SparkSession, config: CohortConfig, source: str, tables: Mapping[str, DataFrame]) -> Inputs:
    """The files of the config's alignment, read once: an analysis refers to them many times, and each reference to the
    files' source would list and read them anew."""
    sides = [read_event_folder(spark, source, suffix).withColumn("side", F.lit(side)) for side, suffix in zip(("target", "reference"), SUFFIXES[config.alignment], strict=True)]
    return Inputs(checkpointed(reduce(DataFrame.unionByName, sides)), checkpointed(read_frequencies(spark, source, FREQUENCY_GLOBS[config.alignment])), tables)


def pooled(config: CohortConfig, inputs: Inputs) -> DataFrame:
    """Events by protocol, with groups found again in the place of files where the config says so."""
    files = inputs.files
    if config.event_source == "regenerated":
        if unknown := sorted(set(config.regenerated_groups) - set(RECIPES)):
            raise ValueError(f"no recipe for {unknown}; there are {sorted(RECIPES)}")
        found = regenerate(inputs.tables, config.event_tables, config.alignment, list(config.regenerated_groups))
        listed = found.join(files.select(F.col("stem").alias("group")).distinct(), "group", "left_semi")
        files = grouping.replace_groups(files, listed)
    parts = [grouping.pooled_events(files.where(F.col("side") == side), config.histogram.active_only, legacy=config.legacy_faithful) for side in ("target", "reference")]
    return reduce(DataFrame.unionByName, parts)


def _windowed(events: DataFrame, epoch: EpochSpec) -> DataFrame:
    return events_in_epoch(events, epoch.default_window, epoch.per_protocol)


def _label(spec: ComparisonSpec) -> str:
    """A comparison's name among all: the same pair can stand in several metrics, and normalised."""
    return f"{PREFIX if spec.normalize else ''}{spec.name} {spec.epoch} {spec.metric}"


def _day_session(counts: DataFrame) -> DataFrame:
    """Trial counts whose session says its day, as units of dendrite protocols are counted by day."""
    return counts.withColumn("session", F.concat_ws("/", "session", "td"))


def unit_session(events: DataFrame, counts: DataFrame, session: Column) -> DataFrame:
    """``events`` plus ``of``: the session whose trials count for the unit, with its day."""
    return grouping.with_day(events, counts).withColumn("of", F.concat_ws("/", session, "td")).drop("td")


def filled_keys(universe: DataFrame) -> DataFrame:
    """Units as inactive ones are looked up: those of task axons are listed without the ending that their events have."""
    return universe.withColumn("k0", F.when(F.col("protocol") == "task_axons", F.concat("k0", F.lit(".0"))).otherwise(F.col("k0")))


def metric_values(config: CohortConfig, prepared: DataFrame, denominators: DataFrame, universe: DataFrame, modulated: DataFrame, measured: DataFrame) -> DataFrame:
    """``epoch, roi_set, metric, protocol, outcome, k0, k1, value`` for whatever the comparisons ask for.

    Metrics are made once for each (epoch, unit set), whatever number of comparisons asks for them.
    """
    parts = []
    for epoch, units in dict.fromkeys((c.epoch, c.roi_set) for c in config.comparisons):
        held = metrics.metrics_by_unit(_windowed(prepared, config.epoch(epoch)), denominators, config.alignment, "of")
        if units == "all":
            held = metrics.fill_inactive(held, universe, denominators, "of")
        held = metrics.modulated_only(held, modulated, measured) if units == "modulated" else held
        parts.append(held.withColumns({"epoch": F.lit(epoch), "roi_set": F.lit(units)}))
    wanted = sorted({c.metric for c in config.comparisons})
    wide = reduce(DataFrame.unionByName, parts)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in wanted])).alias("x")
    return wide.select("epoch", "roi_set", "protocol", "outcome", "k0", "k1", pairs).select("epoch", "roi_set", "x.metric", "protocol", "outcome", "k0", "k1", "x.value")


SIDES = "name string, test string, group string, epoch string, roi_set string, metric string, protocol string, outcome string, ref_protocol string, ref_outcome string, offset double, p_threshold double"


def comparison_sides(config: CohortConfig) -> list[tuple]:
    """A row for each side of each comparison, in the order of ``SIDES``."""
    out = []
    for c in config.comparisons:
        for side, pair in (("a", c.a), ("b", c.b)):
            reference = getattr(c.normalize, f"{side}_reference") if c.normalize else (None, None)
            out.append((_label(c), c.test, side, c.epoch, c.roi_set, c.metric, *pair, *reference, c.normalize.offset if c.normalize else 0.0, float(c.p_threshold)))
    return out


def comparison_samples(values: DataFrame, sides: DataFrame) -> DataFrame:
    """``name, test, group, k0, k1, value`` of all sides by joins with their small table; normalised where they ask for it."""
    at = ["epoch", "roi_set", "metric"]
    rows = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    references = sides.where("ref_protocol is not null").select("name", "group", *at, F.col("ref_protocol").alias("protocol"), F.col("ref_outcome").alias("outcome"), "offset")
    scales = rows.join(references, [*at, "protocol", "outcome"]).groupBy("name", "group").agg(F.avg(F.col("value") - F.col("offset")).alias("scale"))
    held = rows.join(sides, [*at, "protocol", "outcome"]).join(scales, ["name", "group"], "left")
    value = F.when(F.col("ref_protocol").isNull(), F.col("value")).otherwise((F.col("value") - F.col("offset")) / F.col("scale"))
    return held.select("name", "test", "group", "k0", "k1", value.alias("value"))


def comparison_results(config: CohortConfig, values: DataFrame) -> DataFrame:
    """One row per comparison; without statistics if a side has no units."""
    sides = values.sparkSession.createDataFrame(comparison_sides(config), SIDES)
    rows = checkpointed(comparison_samples(values, sides))
    specs = sides.where("group = 'a'").select("name", "test", "metric", "epoch", "p_threshold")
    out = stats.run_comparisons(rows, specs, tuple(dict.fromkeys(c.test for c in config.comparisons)))
    held = specs.drop("p_threshold").join(out, ["name", "test"], "left")
    held = held.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_a", "n_b")})
    return held.withColumn("sentence", describe_comparison())


def run_onset_analysis(config: CohortConfig, inputs: Inputs) -> Outputs:
    """All results of a config. Parts that several of them share are written once."""
    events = checkpointed(pooled(config, inputs))
    counts = checkpointed(grouping.trial_counts(inputs.tables))
    totals = grouping.trial_totals(counts, config.alignment, config.legacy_faithful)
    universe = grouping.unit_universe(inputs.frequencies, inputs.tables, config.legacy_faithful)
    universe = checkpointed(universe)
    epoch = config.epoch(config.modulation.epoch)
    sized = events.join(universe.select("protocol").distinct(), "protocol", "left_semi")
    both = sized.groupBy("protocol").agg(F.count_distinct("side").alias("sides")).where("sides = 2")
    sized = sized.join(both, "protocol", "left_semi")
    units = grouping.modulation_denominators(sized, counts, config.alignment)
    indices = checkpointed(modulation.modulation_index(_windowed(sized, epoch), units))
    modulated = checkpointed(modulation.modulated_units(indices, config.modulation.threshold))
    measured = indices.select("protocol").distinct()
    prepared = metrics.pooled_outcomes(metrics.whitelisted(events, config.alignment), config.alignment)
    prepared = unit_session(prepared, counts, grouping.rate_session())
    denominators = metrics.rate_denominators(_day_session(counts), config.alignment)
    listed = unit_session(filled_keys(universe), counts, grouping.rate_session())
    shares = events.where("side = 'target'").groupBy("protocol").agg(F.count_distinct(F.struct("k0", "k1")).alias("n_units"))
    results = None
    if config.comparisons:
        results = comparison_results(config, metric_values(config, prepared, denominators, listed, modulated, measured))
    h = config.histogram
    return Outputs(
        events, counts, totals, universe, measured, modulated,
        modulation.modulation_proportions(modulated, universe, measured),
        results,
        display.onset_histogram(events, totals, h.xmin, h.xmax, h.nbins, shares if h.roi_div else None),
    )


def run_manifest(configs: tuple[CohortConfig, ...], inputs: Mapping[str, Inputs]) -> DataFrame:
    """Results of all states, each with its ``state``; ``inputs`` by alignment."""
    parts = [run_onset_analysis(c, inputs[c.alignment]).results.withColumn("state", F.lit(c.run_id)) for c in configs if c.comparisons]
    return reduce(DataFrame.unionByName, parts)


def run_latency_correlation(config: CohortConfig, inputs: Inputs, group: str = "passive_axons", window: tuple[float, float] = (5.0, 5.5), z_clip: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(points, the regression's row) of a group's modulated units in a config's analysis."""
    made = run_onset_analysis(config, inputs)
    chosen = made.modulated.where(F.col("protocol") == group)
    if made.measured.where(F.col("protocol") == group).isEmpty():
        raise KeyError(f"state {config.run_id!r} has no modulated set of {group!r}")
    events = made.events.where((F.col("protocol") == group) & (F.col("side") == "target"))
    licks = latency.reward_lick_latency(inputs.tables, group)
    return latency.latency_correlation(latency.per_trial_latencies(events, chosen, licks, window), z_clip)
