"""Events of a stream of trials, by thresholds that are known from earlier recordings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewise.operators.detect import UNIT, run_metrics, run_rows, stack_of, trial_events
from tracewise.operators.windows import inside

#: Numbers of a stretch, in the order in which state and rows hold them; a missing one of the last three values is NaN.
FIELDS = ("place", "n", "peak", "peak_at", "even", "odd", "first", "x", "y", "z")


def detect_stream(
    traces: DataFrame, thresholds: DataFrame, fps: float, min_samples: int = 6, label_base: int = 0, window: tuple[float, float] | None = None, unit: list[str] | None = None
) -> DataFrame:
    """Events of each trial as it arrives; trials of units without a threshold are left out.

    ``thresholds`` is a static table, as ``operators.detect.thresholds`` makes it; each micro-batch meets it by unit. No
    state is kept, so late trials need no watermark and the output can be appended to any sink.
    """
    unit = unit or UNIT
    return trial_events(traces.join(thresholds, unit), fps, min_samples, label_base, window, unit)


def joined(a: list[float], b: list[float]) -> list[float]:
    """Two stretches of a stack, the second from where the first ends, as one."""
    tail = [v for v in (*a[7:], *b[7:]) if v == v][-3:]
    top = a if a[2] >= b[2] else b
    return [a[0], a[1] + b[1], top[2], top[3], a[4] + b[4], a[5] + b[5], a[6], *[float("nan")] * (3 - len(tail)), *tail]


class Stretches(StatefulProcessor):
    """State of a stack: trials that wait for the watermark, by their order, and the stretch that the last one left open.

    A timer stands at the time of each waiting trial. Once the watermark has passed it, no earlier trial can come, and the
    trial is taken in its turn. A trial that repeats one that waits or was taken is passed over. One more timer, ``idle``
    after the last trial taken, ends the stack: it closes the open stretch.
    """

    def __init__(self, idle_ms: int, columns: list[str]):
        self.idle_ms, self.columns = idle_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        trial = "at long, trial string, outcome string, frames long, runs array<double>"
        self.waiting = handle.getMapState("waiting", "row_ord long", trial)
        # How far the stack has come: the last trial's order and time, its end along the stack, and the stretch that touches it.
        self.line = handle.getValueState("line", "row_ord long, at long, until long, open array<double>, trial string, outcome string, home long, origin long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.line.get()[0] if self.line.exists() else None
        for batch in rows:
            for r in batch.itertuples(index=False):
                order = int(r.row_ord)
                if done is not None and order <= done or self.waiting.containsKey((order,)):
                    continue
                at = int(r.at)
                self.waiting.updateValue((order,), (at, r.trial, r.outcome, int(r.frames), [float(v) for v in r.runs]))
                # A timer is due when the watermark is beyond it, so that rows of the watermark's own time still count.
                self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _taken(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """The stretches that are closed by the trials whose time the watermark has passed, or by its passing."""
        held = sorted((k[0], *v) for k, v in self.waiting.iterator())
        # Trials are taken by their order; one that must wait holds up those behind it.
        ready = []
        for x in held:
            if x[1] >= watermark:
                break
            ready.append(x)
        last, at, until, open_, *home = self.line.get() if self.line.exists() else (None, None, 0, None, None, None, None, None)
        open_, out = list(open_) if open_ else None, []
        for order, when, trial, outcome, frames, flat in ready:
            self.waiting.removeKey((order,))
            runs = [list(flat[i : i + len(FIELDS)]) for i in range(0, len(flat), len(FIELDS))]
            for run in runs:
                if until % 2:
                    run[4], run[5] = run[5], run[4]
                run[0], run[3] = run[0] + until, run[3] + until
                if open_ and open_[0] + open_[1] == run[0]:
                    open_ = joined(open_, run)
                    continue
                if open_:
                    out.append((*home, open_))
                open_, home = run, [trial, outcome, order, until]
            until += frames
            # A stretch that ends before the trial does is closed; trials without frames leave it open.
            if open_ and open_[0] + open_[1] < until:
                out.append((*home, open_))
                open_ = None
            last, at = order, max(when, at if at is not None else when)
        if ready:
            self.handle.registerTimer(at + self.idle_ms + 1)
        if at is not None and at + self.idle_ms < watermark and len(ready) == len(held):
            if open_:
                out.append((*home, open_))
            self.line.clear()
        elif ready:
            self.line.update((last, at, until, open_, *(home if open_ else [None] * 4)))
        if out:
            yield pd.DataFrame([(*key, *x[:4], *x[4]) for x in out], columns=self.columns)


def stacked_stream(
    traces: DataFrame,
    thresholds: DataFrame,
    time_col: str,
    mode: str,
    fps: float,
    late: str = "10 minutes",
    idle: str = "1 day",
    min_samples: int = 6,
    label_base: int = 0,
    window: tuple[float, float] | None = None,
    unit: list[str] | None = None,
) -> DataFrame:
    """Events of stacks of trials as they arrive, those that run on into later trials among them.

    The events of ``operators.detect.stacked_events``, however the trials are cut into batches: trials may come out of
    order by up to ``late``, and repeatedly; they are taken in ``row_ord``, which must rise with ``time_col``. Later ones
    than that may be dropped, as the watermark has it. A stack is over, and its open event complete, once the watermark is
    ``idle`` beyond its last trial; what comes then begins anew. State is a stack's waiting trials, in summary, and one
    open stretch, whatever its length. Sessions need the RocksDB state store.
    """
    unit = unit or UNIT
    keys = [*unit, "stack"]
    timed = traces.withWatermark(time_col, late).join(thresholds, unit)
    flat = F.flatten(
        F.transform(
            "runs",
            lambda r: F.concat(
                F.array(r["start"].cast("double"), r["n"].cast("double"), r["peak"], r["peak_at"].cast("double"), r["even"], r["odd"], r["first"]),
                F.array_repeat(F.lit(float("nan")), 3 - F.size(r["tail"])),
                r["tail"],
            ),
        )
    )
    rows = run_rows(timed, stack_of(mode), unit, time_col)
    rows = rows.select(*keys, F.col("trial").cast("string").alias("trial"), F.col("outcome").cast("string").alias("outcome"), "row_ord", time_col, F.unix_millis(time_col).alias("at"), "frames", flat.alias("runs"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    home = [T.StructField("trial", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("row_ord", T.LongType()), T.StructField("origin", T.LongType())]
    fields = [*[T.StructField(k, kinds[k]) for k in keys], *home, *[T.StructField(n, T.DoubleType()) for n in FIELDS]]
    idle_ms = int(traces.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {idle})")).first()[0])
    made = rows.groupBy(*keys).transformWithStateInPandas(
        Stretches(idle_ms, [f.name for f in fields]), T.StructType(fields), outputMode="Append", timeMode="EventTime"
    )
    tail = F.filter(F.array("x", "y", "z"), lambda v: ~F.isnan(v))
    whole = made.withColumns({**{c: F.col(c).cast("long") for c in ("place", "n", "peak_at")}, "tail": tail}).where(F.col("n") >= min_samples)
    out = whole.select(*unit, F.col("trial").cast(traces.schema["trial"].dataType).alias("trial"), "outcome", "row_ord", *run_metrics(label_base, fps))
    return out if window is None else out.where(inside("ev_onset", window))
