"""Stages of a session's analysis: functions from DataFrame to DataFrame, chained by ``transform``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame

from tracewise.operators import detect, signal
from tracewise.plans.session import SessionConfig

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    """Named stages in order."""

    stages: tuple[tuple[str, Stage], ...]

    def __call__(self, traces: DataFrame) -> DataFrame:
        """What the last stage makes; one plan, nothing runs yet."""
        for _, stage in self.stages:
            traces = traces.transform(stage)
        return traces

    def results(self, traces: DataFrame) -> dict[str, DataFrame]:
        """What each stage makes, by name."""
        out = {}
        for name, stage in self.stages:
            out[name] = traces = traces.transform(stage)
        return out

    def __len__(self) -> int:
        return len(self.stages)


def session_pipeline(config: SessionConfig, critical_freq: float = 0.2, threshold_sd: float = 2.0, min_samples: int = 6) -> Pipeline:
    """Low-pass, normalise and detect, with a session's frame rate and baseline."""
    window = config.baseline_window_s
    return Pipeline(
        (
            ("filter", partial(signal.lowpass, cut=critical_freq)),
            ("dff", partial(signal.dff, fps=config.fps, window=window)),
            ("events", partial(detect.event_table, fps=config.fps, sd=threshold_sd, min_samples=min_samples, window=window)),
        )
    )
