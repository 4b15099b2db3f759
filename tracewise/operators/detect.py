"""Events in traces: stretches above a threshold, within trials or across the trials of a stack.

Stretches are found inside each trial's array, so frames are never exploded. Stacks are reduced by ranges of their trials:
a stretch is summed up in a row of fixed size, and sums of neighbouring stretches are merged, within ranges and over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewise.functions.arrays import first_peak, part, segments, simpson
from tracewise.functions.formats import frame_index, seconds
from tracewise.operators.prefix import RANGE, ranges, with_offsets
from tracewise.operators.windows import inside

# Outcomes whose trials count as validated, and the branches that are stacked apart.
VALIDATED = ("cHIT", "nHIT", "FA")
VALIDATED_MARK = "CATCH"
UNIT = ["session", "roi"]
METRICS = ("peak", "ev_onset", "peak_time", "ev_offset", "ev_duration", "integral")


def is_validated(outcome: str = "outcome") -> Column:
    """Whether a trial's outcome is among the validated ones."""
    return F.col(outcome).isin(*VALIDATED) | F.col(outcome).contains(VALIDATED_MARK)


def branch(outcome: str = "outcome") -> Column:
    """The stack of a trial by outcome; null for others."""
    c = F.col(outcome)
    return F.when(c.isin("cHIT", "nHIT"), c).when(c.contains(VALIDATED_MARK), F.lit(VALIDATED_MARK)).when(c == "FA", c)


def thresholds(traces: DataFrame, fps: float, window: tuple[float, float], sd: float, unit: list[str] | None = None) -> DataFrame:
    """``threshold`` of each unit: a multiple of the population's standard deviation of all baseline frames.

    A unit with a missing baseline value has none, and so no events.
    """
    unit = unit or UNIT
    frames = traces.select(*unit, F.explode(part("y", frame_index(window[0], fps), frame_index(window[1], fps))).alias("v"))
    bad = F.max(F.col("v").isNull() | F.isnan("v"))
    return frames.groupBy(*unit).agg(F.when(~bad, F.stddev_pop(F.nanvl("v", F.lit(None).cast("double"))) * sd).alias("threshold"))


def detect_segments(traces: DataFrame, upper: Column, lower: Column, min_width: int = 6) -> DataFrame:
    """One row per stretch of a trial with ``min_width`` values above ``upper``: ``start, values``.

    Stretches end where the trace crosses ``lower``; with ``upper`` below ``lower`` those under it can count too.
    """
    found = F.transform(segments("y", lower), lambda s: F.struct(s["start"].alias("start"), F.slice("y", s["start"] + 1, s["size"]).alias("values")))
    wide = F.filter(found, lambda s: F.size(F.filter(s["values"], lambda v: (v > upper) & ~F.isnan(v))) >= min_width)
    return traces.select(*[c for c in traces.columns if c != "y"], F.inline(wide))


def _metrics(place: Column, values: Column, base: int, fps: float) -> list[Column]:
    return [
        F.array_max(values).alias("peak"),
        seconds(place, base, fps).alias("ev_onset"),
        seconds(place + first_peak(values), base, fps).alias("peak_time"),
        seconds(place + F.size(values) - 1, base, fps).alias("ev_offset"),
        (F.size(values) / F.lit(float(fps))).alias("ev_duration"),
        simpson(values).alias("integral"),
    ]


def event_table(traces: DataFrame, fps: float, sd: float = 2.0, min_samples: int = 6, window: tuple[float, float] = (1.0, 2.0), unit: list[str] | None = None) -> DataFrame:
    """Events of each trial with their metrics; one threshold per unit; events from the first frame on are left out."""
    unit = unit or UNIT
    held = traces.join(thresholds(traces, fps, window, sd, unit), unit)
    found = detect_segments(held, F.col("threshold"), F.col("threshold"), min_samples)
    keep = [c for c in traces.columns if c != "y"]
    return found.select(*keep, *_metrics(F.col("start"), F.col("values"), 0, fps)).where("ev_onset > 0")


def runs_of(y: str, threshold: Column) -> Column:
    """A trial's stretches above the threshold, each as what merging needs: an array of structs of fixed size.

    ``start, n``; the peak and the first place of it; sums of the values at even and at odd places, for Simpson's rule;
    the first value and the last three.
    """
    high = F.filter(segments(y, threshold), lambda s: s["above"])
    held = F.transform(high, lambda s: F.struct(s["start"].alias("start"), F.slice(y, s["start"] + 1, s["size"]).alias("values")))

    def summed(values: Column, start: Column, rest: int) -> Column:
        own = F.filter(values, lambda v, i: (i + start) % 2 == rest)
        return F.aggregate(own, F.lit(0.0), lambda s, v: s + v)

    def reduced(x: Column) -> Column:
        start, values = x["start"], x["values"]
        return F.struct(
            start.cast("long").alias("start"), F.size(values).cast("long").alias("n"), F.array_max(values).alias("peak"), (start + first_peak(values)).cast("long").alias("peak_at"),
            summed(values, start, 0).alias("even"), summed(values, start, 1).alias("odd"), F.get(values, F.lit(0)).alias("first"),
            F.slice(values, -F.least(F.size(values), F.lit(3)), 3).alias("tail"),
        )

    return F.transform(held, reduced)


#: What a stretch keeps of the trial that it begins in.
_HOME = ("trial", "outcome", "row_ord", "origin")


def _merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of a group that follow one another without a gap, as one each; those that don't, as they are.

    ``runs`` has places along the group's stack. Merging is associative: stretches can be merged within parts of a stack
    first, and what comes out be merged again.
    """
    along = W.partitionBy(*keys).orderBy("place")
    last, until = F.array().cast("array<double>"), F.col("place") + F.col("n")
    held = runs.withColumn("__meets", F.coalesce(F.lag(until).over(along) == F.col("place"), F.lit(False)))
    # Each stretch has a value at least, so the last three of a merged one lie in its last three parts.
    one = F.when(F.col("__meets"), F.lag("tail", 1).over(along)).otherwise(last)
    two = F.when(F.col("__meets") & F.lag("__meets", 1).over(along), F.lag("tail", 2).over(along)).otherwise(last)
    ends = F.concat(F.coalesce(two, last), F.coalesce(one, last), "tail")
    held = held.withColumns({"__ends": F.slice(ends, -F.least(F.size(ends), F.lit(3)), 3), "__island": F.sum(F.when(F.col("__meets"), 0).otherwise(1)).over(along.rowsBetween(W.unboundedPreceding, 0))})
    top = F.max(F.struct(F.col("peak"), (-F.col("peak_at")).alias("at")))
    out = held.groupBy(*keys, "__island").agg(
        *[F.min_by(c, "place").alias(c) for c in (*_HOME, "first")], F.min("place").alias("place"), F.sum("n").alias("n"), top.alias("__top"),
        F.sum("even").alias("even"), F.sum("odd").alias("odd"), F.max_by("__ends", "place").alias("tail"),
    )
    return out.withColumns({"peak": F.col("__top.peak"), "peak_at": -F.col("__top.at")}).drop("__island", "__top")


def _simpson_of_sums() -> Column:
    """Simpson's rule, with the last step's correction for an even number of values, from a stretch's sums and ends."""
    n, first, tail = F.col("n"), F.col("first"), F.col("tail")
    here = F.col("place") % 2 == 0
    even, odd = F.when(here, F.col("even")).otherwise(F.col("odd")), F.when(here, F.col("odd")).otherwise(F.col("even"))
    z, y, x = (F.element_at(tail, -i) for i in (1, 2, 3))
    whole = 4 / 3 * odd + 2 / 3 * even - (first + z) / 3
    short = 4 / 3 * (odd - z) + 2 / 3 * even - (first + y) / 3 + 5 / 12 * z + 2 / 3 * y - x / 12
    infinite = F.lit(float("inf"))
    return F.when(n == 1, 0.0).when(F.col("peak") == infinite, infinite).when(n == 2, (first + z) / 2).when(n % 2 == 1, whole).otherwise(short)


def run_rows(traces: DataFrame, stack: Column, unit: list[str] | None = None, *more: str) -> DataFrame:
    """Trials of stacks with their number of frames and their stretches in place of the frames, and ``more`` columns; a projection."""
    rows = traces.withColumn("stack", stack).where(F.col("stack").isNotNull())
    return rows.select(*(unit or UNIT), "stack", "trial", "outcome", "row_ord", *more, F.greatest(F.size("y"), F.lit(0)).cast("long").alias("frames"), runs_of("y", F.col("threshold")).alias("runs"))


def merge_ranges(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of whole stacks, merged over trials; ``dealt`` has trials in ranges of their order, as ``prefix.ranges`` deals them.

    A range is reduced by itself: to its frames, the stretches that touch its edges, and closed ones. Ranges meet by these
    alone, two stretches each at most, wherever a stack is cut.
    """
    dealt = with_offsets(dealt, keys, begin=F.col("frames"))
    within = W.partitionBy(*keys, RANGE)
    before = F.coalesce(F.sum("frames").over(within.orderBy("row_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = dealt.withColumns({"origin": F.col("begin") + before, "until": F.col("begin") + F.sum("frames").over(within)})
    each = rows.select(*keys, RANGE, "begin", "until", "trial", "outcome", "row_ord", "origin", F.inline("runs")).withColumn("place", F.col("origin") + F.col("start"))
    # Sums by even and odd places are those of the trial; along the stack they change places if the trial begins at an odd one.
    swap = F.col("origin") % 2 == 1
    sides = {"even": F.when(swap, F.col("odd")).otherwise(F.col("even")), "odd": F.when(swap, F.col("even")).otherwise(F.col("odd"))}
    each = each.withColumns({**sides, "peak_at": F.col("origin") + F.col("peak_at")}).drop("start")
    own = _merged(each, [*keys, RANGE, "begin", "until"])
    at_edge = (F.col("place") == F.col("begin")) | (F.col("place") + F.col("n") == F.col("until"))
    return _merged(own.withColumn(RANGE, F.when(at_edge, F.lit(-1)).otherwise(F.col(RANGE))), [*keys, RANGE])


def stacked_events(
    traces: DataFrame, stack: Column, fps: float, min_samples: int = 6, label_base: int = 0, window: tuple[float, float] | None = None, unit: list[str] | None = None
) -> DataFrame:
    """Events of traces with a ``threshold``, where the trials of a stack follow one another in ``row_ord``.

    An event belongs to the trial in which it begins; its times count from that trial's first frame, and may run past
    its last. Trials may have any number of frames; null arrays have none. Rows whose ``stack`` is null are left out.
    Frames stay where they are: what moves is a trial's stretches, in summary. Stacks of any length are dealt to ranges of
    their trials, whose outcomes are merged.
    """
    keys = [*(unit or UNIT), "stack"]
    whole = merge_ranges(ranges(run_rows(traces, stack, unit), keys, ["row_ord"]), keys).where(F.col("n") >= min_samples)
    out = whole.select(*(unit or UNIT), "trial", "outcome", "row_ord", *run_metrics(label_base, fps))
    return out if window is None else out.where(inside("ev_onset", window))


def run_metrics(base: int, fps: float) -> list[Column]:
    """The metrics of a merged stretch, its times counted from its first trial's first frame."""
    place = F.col("place") - F.col("origin")
    return [
        F.col("peak"),
        seconds(place, base, fps).alias("ev_onset"),
        seconds(F.col("peak_at") - F.col("origin"), base, fps).alias("peak_time"),
        seconds(place + F.col("n") - 1, base, fps).alias("ev_offset"),
        (F.col("n") / F.lit(float(fps))).alias("ev_duration"),
        _simpson_of_sums().alias("integral"),
    ]


def trial_events(
    traces: DataFrame, fps: float, min_samples: int = 6, label_base: int = 0, window: tuple[float, float] | None = None, unit: list[str] | None = None
) -> DataFrame:
    """Events of traces with a ``threshold``, each trial on its own: a projection, which needs no other rows."""
    found = detect_segments(traces, F.col("threshold"), F.col("threshold"), min_samples)
    out = found.select(*(unit or UNIT), "trial", "outcome", "row_ord", *_metrics(F.col("start"), F.col("values"), label_base, fps))
    return out if window is None else out.where(inside("ev_onset", window))


def stack_of(mode: str) -> Column:
    """What a trial is stacked by."""
    kinds = {"per_trial": F.col("row_ord").cast("string"), "per_branch": branch(), "flattened": F.lit("all")}
    if mode not in kinds:
        raise ValueError(f"mode must be one of {sorted(kinds)}, got {mode!r}")
    return kinds[mode]


def detect(
    traces: DataFrame,
    mode: str,
    fps: float,
    sd: float = 2.0,
    min_samples: int = 6,
    baseline: tuple[float, float] = (2.0, 3.0),
    label_base: int = 0,
    window: tuple[float, float] | None = None,
    validated_only: bool = True,
    unit: list[str] | None = None,
) -> DataFrame:
    """Events of each unit in one of the stacking modes; the threshold comes from the kept trials only.

    Trials on their own need no order: the threshold is all that moves.
    """
    unit = unit or UNIT
    kept = traces.where(is_validated()) if validated_only else traces
    held = kept.join(thresholds(kept, fps, baseline, sd, unit), unit)
    if mode != "per_trial":
        return stacked_events(held, stack_of(mode), fps, min_samples, label_base, window, unit)
    return trial_events(held, fps, min_samples, label_base, window, unit)


def without_empty_frames(traces: DataFrame, unit: list[str] | None = None) -> DataFrame:
    """``traces`` without the frames that no trial of the unit has a value for."""
    unit = unit or UNIT
    places = traces.select(*unit, F.posexplode("y").alias("place", "v")).where("v is not null and not isnan(v)")
    held = places.groupBy(*unit).agg(F.array_sort(F.collect_set("place")).alias("places"))
    return traces.join(held, unit).withColumn("y", F.transform("places", lambda i: F.get("y", i))).drop("places")
