"""Open time windows on event onsets, with overrides by protocol."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Window = tuple[float, float]


def inside(column: str | Column, window: Window) -> Column:
    """Strictly between the ends of the window."""
    column = F.col(column) if isinstance(column, str) else column
    return (column > window[0]) & (column < window[1])


def events_in_window(events: DataFrame, window: Window) -> DataFrame:
    """Events whose onset lies strictly inside the window."""
    return events.where(inside("ev_onset", window))


def window_bound(default: float, overrides: Mapping[str, float]) -> Column:
    """One end of the window by protocol: a case for each override, so no join is needed."""
    out = F.lit(float(default))
    for protocol, value in overrides.items():
        out = F.when(F.col("protocol") == protocol, F.lit(float(value))).otherwise(out)
    return out


def events_in_epoch(events: DataFrame, default: Window, per_protocol: Mapping[str, Window] | None = None) -> DataFrame:
    """Events inside the window of their protocol."""
    special = per_protocol or {}
    low, high = (window_bound(default[i], {p: w[i] for p, w in special.items()}) for i in (0, 1))
    return events.where((F.col("ev_onset") > low) & (F.col("ev_onset") < high))
