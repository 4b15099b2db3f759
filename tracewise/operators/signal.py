"""Low-pass filter, baseline and normalised fluorescence of traces (one row per trial, ``y`` an array of frames)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracewise.functions.arrays import median, part
from tracewise.functions.formats import frame_index
from tracewise.operators.prefix import running_sums
from tracewise.plans.lineage import checkpointed

#: Trials, in their order, over which the baseline is smoothed: so many before and after the one at hand.
SMOOTHING = (10, 9)
DESIGNS = ("sos", "ba")


def baseline(y: str, fps: float, window: tuple[float, float] = (2.0, 3.0)) -> Column:
    """Median of the window, which lies one frame early at both ends; null if that begins before the trace."""
    start, stop = frame_index(window[0], fps), frame_index(window[1], fps)
    return median(part(y, start - 1, stop - 1)) if start >= 1 else F.lit(None).cast("double")


def _smoothed(raw: DataFrame, unit: list[str], block: int) -> DataFrame:
    """``raw`` (unit, row_ord, raw) with ``f0``, by blocks of a unit's trials.

    Trials are numbered by ranges; a block has copies of the trials that its first and last medians reach out to.
    """
    before, after = SMOOTHING
    placed = running_sums(raw, unit, ["row_ord"], __place=F.lit(1))
    own, place = F.floor(F.col("__place") / block), F.col("__place")
    reach = F.sequence(F.greatest(F.floor((place - after) / block), F.lit(0)), F.floor((place + before) / block))
    sent = placed.withColumn("__own", own).withColumn("__block", F.explode(reach))
    order = W.partitionBy(*unit, "__block").orderBy("__place").rowsBetween(-before, after)
    return sent.withColumn("f0", F.expr("percentile(raw, 0.5)").over(order)).where("__own = __block").select(*unit, "row_ord", "f0")


def with_baseline(
    traces: DataFrame, fps: float, window: tuple[float, float] = (2.0, 3.0), unit: list[str] | None = None, in_place: bool = False, block: int | None = None
) -> DataFrame:
    """``traces`` plus ``f0``: the baseline's running median over the unit's trials in ``row_ord``.

    Only the baselines take part in the ordering, and meet their traces again by unit and ``row_ord``. ``in_place`` is for
    tables that are bucketed by the unit, as ``sources.tables.write_bucketed`` makes them: a unit's traces lie together
    there, and the median runs over them where they are, without moving any. ``block`` is for units with more trials than a
    task should order: so many are smoothed together.
    """
    unit = unit or ["session", "roi"]
    order = W.partitionBy(*unit).orderBy("row_ord").rowsBetween(-SMOOTHING[0], SMOOTHING[1])
    f0 = F.expr("percentile(raw, 0.5)").over(order).alias("f0")
    if in_place:
        return traces.withColumn("raw", baseline("y", fps, window)).select(*traces.columns, f0)
    raw = traces.select(*unit, "row_ord", baseline("y", fps, window).alias("raw"))
    smooth = raw.select(*unit, "row_ord", f0) if block is None else _smoothed(raw, unit, block)
    return traces.join(smooth, [*unit, "row_ord"])


def dff(traces: DataFrame, fps: float, window: tuple[float, float] = (2.0, 3.0), unit: list[str] | None = None, in_place: bool = False) -> DataFrame:
    """``traces`` with ``y`` as its relative distance from the smoothed baseline; ``in_place`` as for ``with_baseline``."""
    held = with_baseline(traces, fps, window, unit, in_place)
    return held.withColumn("y", F.transform("y", lambda v: (v - F.col("f0")) / F.col("f0"))).drop("f0")


@lru_cache(maxsize=16)
def butterworth(order: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the digital low-pass filter whose cut-off is a share of the highest frequency."""
    warped = 4 * np.tan(np.pi * cut / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    a = np.real(np.poly((4 + poles) / (4 - poles)))
    b = np.poly(-np.ones(order))
    return b * a.sum() / b.sum(), a


def _settled(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of the filter after a long constant input of 1."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] += np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def _run(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows run through the filter from a state each, and the states that they end in."""
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        out[:, t] = b[0] * x[:, t] + state[:, 0]
        state = np.concatenate([state[:, 1:], np.zeros((len(x), 1))], axis=1) + x[:, t : t + 1] * b[1:] - out[:, t : t + 1] * a[1:]
    return out, state


def _filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rows run through the filter, from the state of their first value."""
    return _run(x, b, a, _settled(b, a)[None, :] * x[:, :1])[0]


def zero_phase(x: np.ndarray, order: int = 3, cut: float = 0.2) -> np.ndarray:
    """Rows filtered forwards and backwards, with both ends mirrored oddly for three lengths of the filter."""
    b, a = butterworth(order, cut)
    pad = 3 * (order + 1)
    if x.shape[1] <= pad:
        raise ValueError(f"a trace must have more than {pad} values, got {x.shape[1]}")
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    there = _filtered(wide, b, a)
    return _filtered(there[:, ::-1], b, a)[:, ::-1][:, pad:-pad]


def lowpass(traces: DataFrame, order: int = 3, cut: float = 0.2, design: str = "sos") -> DataFrame:
    """``traces`` with ``y`` low-passed without delay.

    Null and NaN are left out before; as many nulls stand at the end afterwards. Both designs are the same filter. A recursion over
    frames has no column expression, so batches of rows of one length go through numpy together.
    """
    if design not in DESIGNS:
        raise ValueError(f"design must be one of {DESIGNS}, got {design!r}")

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            held = [None if y is None else np.asarray(y, float) for y in rows]
            kept = [None if y is None else y[~np.isnan(y)] for y in held]
            out: list = [None] * len(held)
            for size in {len(k) for k in kept if k is not None}:
                at = [i for i, k in enumerate(kept) if k is not None and len(k) == size]
                smooth = zero_phase(np.stack([kept[i] for i in at]), order, cut) if size else np.zeros((len(at), 0))
                for i, y in zip(at, smooth, strict=True):
                    out[i] = np.concatenate([y, np.full(len(held[i]) - size, np.nan)])
            yield pd.Series(out)

    return traces.withColumn("y", run("y"))


def _by_length(rows: pd.Series) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and values of rows of one length at a time."""
    sizes = [len(x) for x in rows]
    for size in sorted(set(sizes)):
        at = [i for i, n in enumerate(sizes) if n == size]
        yield at, np.stack([np.asarray(rows.iloc[i], float) for i in at]).reshape(len(at), size)


def _block_pass(rows: DataFrame, keys: list[str], order: int, cut: float, backward: bool) -> DataFrame:
    """``rows`` (keys, block, x) with ``x`` run through the filter along each trace, whose blocks are filtered apart.

    Over a block the filter's state goes through an affine map: a power of one matrix, and the state that the block alone
    leads to from nothing. Blocks give these few numbers; composed in order they give the state that each block begins in.
    """
    b, a = butterworth(order, cut)
    n = len(a) - 1

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def alone(x: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        for at, values in _by_length(x):
            for i, state in zip(at, _run(values, b, a, np.zeros((len(at), n)))[1], strict=True):
                out[i] = state
        return pd.Series(out)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def begun(x: pd.Series, state: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        for at, values in _by_length(x):
            for i, y in zip(at, _run(values, b, a, np.stack([np.asarray(state.iloc[j], float) for j in at]))[0], strict=True):
                out[i] = y
        return pd.Series(out)

    step = np.eye(n, k=1)
    step[:, 0] -= a[1:]

    def composed(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block", ascending=not backward)
        state, states = _settled(b, a) * blocks["first"].iloc[0], []
        for size, own in zip(blocks["size"], blocks["alone"], strict=True):
            states.append(state)
            state = np.linalg.matrix_power(step, int(size)) @ state + np.asarray(own, float)
        return blocks[[*keys, "block"]].assign(state=states)

    rows = checkpointed(rows.withColumn("x", F.reverse("x")) if backward else rows)
    kinds = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*[kinds[k] for k in keys], kinds["block"], T.StructField("state", T.ArrayType(T.DoubleType()))])
    told = rows.select(*keys, "block", F.size("x").alias("size"), F.get("x", F.lit(0)).alias("first"), alone("x").alias("alone"))
    states = told.groupBy(*keys).applyInPandas(composed, schema)
    out = rows.join(states, [*keys, "block"]).withColumn("x", begun("x", "state")).drop("state")
    return out.withColumn("x", F.reverse("x")) if backward else out


def lowpass_blocks(blocks: DataFrame, keys: list[str], order: int = 3, cut: float = 0.2) -> DataFrame:
    """``blocks`` with ``y`` low-passed without delay along whole traces, of which no task sees more than a block.

    A row is a block of a trace, numbered by ``block``; all but the last have more values than the mirrored ends are long,
    three lengths of the filter, and none is missing. The outcome is that of ``lowpass`` over the trace in one piece.
    """
    pad = 3 * (order + 1)
    line = W.partitionBy(*keys).orderBy("block")
    ends = blocks.select(*keys, "block", F.size("y").alias("size"), F.slice("y", 1, pad + 1).alias("head"), F.slice("y", -F.least(F.size("y"), F.lit(pad + 1)), pad + 1).alias("tail"))
    bad = F.exists("y", lambda v: v.isNull() | F.isnan(v))
    last = F.concat(F.coalesce(F.lag("tail").over(line), F.array().cast("array<double>")), "tail")
    ends = ends.withColumns({"is_first": F.lag("size").over(line).isNull(), "is_last": F.lead("size").over(line).isNull(), "last": F.slice(last, -F.least(F.size(last), F.lit(pad + 1)), pad + 1)})
    none = F.array().cast("array<double>")
    short = F.size("last") <= pad
    # Mirrored oddly about the first and the last value of the trace.
    before = F.when(F.col("is_first"), F.transform(F.reverse(F.slice("head", 2, pad)), lambda v: 2 * F.get("head", F.lit(0)) - v)).otherwise(none)
    after = F.when(F.col("is_last"), F.transform(F.reverse(F.slice("last", 1, pad)), lambda v: 2 * F.element_at("last", -1) - v)).otherwise(none)
    wrong = (F.col("is_first") & (F.size("head") <= pad)) | (F.col("is_last") & short) | (~F.col("is_last") & (F.col("size") <= pad))
    checked = F.when(wrong, F.raise_error(F.lit(f"a trace, and each of its blocks but the last, must have more than {pad} values"))).otherwise(before)
    edges = ends.select(*keys, "block", checked.alias("before"), after.alias("after"), F.col("size").alias("kept"))
    held = blocks.withColumn("y", F.when(bad, F.raise_error(F.lit("a block has missing values"))).otherwise(F.col("y"))).join(edges, [*keys, "block"])
    held = held.withColumn("x", F.concat("before", "y", "after")).withColumn("skip", F.size("before")).drop("before", "after", "y")
    both = _block_pass(_block_pass(held, keys, order, cut, False), keys, order, cut, True)
    return both.withColumn("y", F.slice("x", F.col("skip") + 1, F.col("kept"))).select(*blocks.columns)
