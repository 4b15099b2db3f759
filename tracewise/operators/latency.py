"""Lick latency against event latency, per trial."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.functions import pvalues
from tracewise.functions.keys import null_safe_join
from tracewise.operators.recipes import RECIPES, chosen_rows
from tracewise.operators.windows import inside


def reward_lick_latency(tables: Mapping[str, DataFrame], group: str) -> DataFrame:
    """``session, trial, lick_latency`` of a group whose behaviour was recorded; what is no number is null."""
    pieces = [
        chosen_rows(tables[r.behavior], r).select(r.session().alias("session"), F.col("trial").cast("long").alias("trial"), F.expr("try_cast(`Rew lick latency` AS DOUBLE)").alias("lick_latency"))
        for r in RECIPES[group]
        if r.behavior
    ]
    if not pieces:
        raise ValueError(f"group {group!r} has no recorded behaviour")
    return reduce(DataFrame.unionByName, pieces)


def per_trial_latencies(events: DataFrame, units: DataFrame, licks: DataFrame, window: tuple[float, float] = (5.0, 5.5)) -> DataFrame:
    """``session, trial, ev_onset, lick_latency``: mean onset within the window over the chosen units' events, and the trial's lick.

    The session is the first part of the unit's key. Each event counts; a trial without a lick has null.
    """
    chosen = null_safe_join(events.where(inside("ev_onset", window)), units.select("k0", "k1").distinct(), ["k0", "k1"], "left_semi")
    means = chosen.groupBy(F.col("k0").alias("session"), F.col("trial").cast("long").alias("trial")).agg(F.avg(F.col("ev_onset") - window[0]).alias("ev_onset"))
    return means.join(licks, ["session", "trial"], "left")


def zscored(per_trial: DataFrame, z_clip: float = 3.0) -> DataFrame:
    """Trials with a lick, both latencies as distances from the mean in standard deviations, those beyond the clip left out."""
    held = per_trial.where(F.col("lick_latency").isNotNull() & ~F.isnan("lick_latency"))
    names = ("lick_latency", "ev_onset")
    moments = held.agg(*[x for n in names for x in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))])
    z: dict[str, Column] = {n: F.try_divide(F.col(n) - F.col(f"m_{n}"), F.col(f"s_{n}")) for n in names}
    # One row of moments meets every trial.
    scored = held.crossJoin(F.broadcast(moments)).withColumns(z).drop(*[f"{p}_{n}" for n in names for p in "ms"])
    return scored.where(" and ".join(f"abs({n}) < {z_clip}" for n in names))


@F.pandas_udf(T.DoubleType())
def _pearson(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for r, n in rows:
        yield pd.Series([pvalues.pearson_p(a, int(b)) for a, b in zip(r, n, strict=True)], dtype=float)


def regression(points: DataFrame) -> DataFrame:
    """One row: ``r, slope, intercept, n_points`` of event latency on lick latency."""
    y, x = "ev_onset", "lick_latency"
    return points.agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n_points"))


def latency_correlation(per_trial: DataFrame, z_clip: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """The points, and one row: ``r, p, slope, intercept, n_points, n_trials, n_no_lick, n_sessions``."""
    points = zscored(per_trial, z_clip)
    lick = F.col("lick_latency").isNotNull() & ~F.isnan("lick_latency")
    all_ = per_trial.agg(F.count_if(lick).alias("n_trials"), F.count_if(~lick).alias("n_no_lick"), F.count_distinct(F.when(lick, F.col("session"))).alias("n_sessions"))
    line = regression(points).crossJoin(F.broadcast(all_))
    return points, line.withColumn("p", _pearson("r", "n_points"))
