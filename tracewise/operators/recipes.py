"""How each group's events are found again from its traces, and the operator that does it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.keys import session_name, suffixed_key
from tracewise.operators.detect import METRICS, detect, without_empty_frames
from tracewise.plans.specs import EventTableParams

PASSIVE_PROTOCOL = "NAIVE STIM REW"
TARGET_OUTCOMES = ("cHIT", "nHIT")


@dataclass(frozen=True)
class Recipe:
    """Where a group's traces and outcomes are, and the numbers of its detection."""

    traces: str
    fps: float
    group_by: tuple[str, ...]
    outcome: str | None = None
    behavior: str | None = None
    label_base: int = 0
    baseline: tuple[float, float] = (2.0, 3.0)
    fps_of: Mapping[str, float] = field(default_factory=dict)
    validated_only: bool = True
    prefix: str = ""
    compartment: str | None = None
    mode: str = "per_trial"

    @property
    def passive(self) -> bool:
        return self.outcome is None

    def session(self) -> Column:
        return session_name(self.prefix, *self.group_by)


# Tables, frame rates, baselines and modes with which the published tables were made.
RECIPES: dict[str, tuple[Recipe, ...]] = {
    "task_axons": (Recipe("traces_task_axons", 30.54, ("id",), outcome="unvalidated_type", label_base=1),),
    "NO_DREADDs": (
        Recipe("traces_no_dreadds", 30.54, ("id",), outcome="trial_type", fps_of={"GCaMP_Batch8_muji_FOV3": 30.3, "GCaMP_Batch8_one_FOV7": 30.3}, mode="per_branch"),
    ),
    "passive_axons": (
        Recipe("traces_batch3", 30.54, ("id", "fov"), behavior="behavior_batch3", prefix="GCaMP_POm_Batch3", validated_only=False, mode="flattened"),
        Recipe("traces_batch1", 30.3, ("id",), behavior="behavior_batch1", prefix="RGECO_GCaMP_Batch1", compartment="AXONS", baseline=(0.0, 2.0), validated_only=False, mode="flattened"),
    ),
    "passive_dendrites": (
        Recipe("traces_batch1", 30.3, ("id",), behavior="behavior_batch1", prefix="RGECO_GCaMP_Batch1", compartment="DENDRITES", baseline=(0.0, 2.0), validated_only=False, mode="flattened"),
    ),
}
#: Groups that no recipe can make, because their traces were not kept.
NOT_REGENERABLE = (
    "task_dendrites_TD0", "task_dendrites_TD1", "task_dendrites_TD2", "task_dendrites_TD3",
    "control_dendrites_TD0", "control_dendrites_TD2", "control_dendrites_TD3",
)


def recipe_tables(groups: list[str]) -> list[str]:
    """Names of the tables that the groups need, in order."""
    names = [n for g in groups for r in RECIPES[g] for n in (r.traces, r.behavior) if n]
    return list(dict.fromkeys(names))


def chosen_rows(table: DataFrame, recipe: Recipe) -> DataFrame:
    """Rows of the recipe's protocol and compartment; these filters reach the scan."""
    if "protocol" in table.columns:
        table = table.where(F.col("protocol") == PASSIVE_PROTOCOL)
    if recipe.compartment is not None:
        table = table.where(F.col("compartment") == recipe.compartment)
    return table


def session_traces(tables: Mapping[str, DataFrame], recipe: Recipe) -> DataFrame:
    """``session, roi, trial, outcome, y, row_ord``; trials without a label have the outcome ``nan``."""
    rows = chosen_rows(tables[recipe.traces], recipe).withColumn("session", recipe.session())
    rows = rows.withColumn("trial", F.col("trial").cast("string"))
    if recipe.passive:
        behavior = chosen_rows(tables[recipe.behavior], recipe)
        labels = behavior.select(recipe.session().alias("session"), F.col("trial").cast("string").alias("trial"), F.col("history").alias("outcome"))
    else:
        labels = rows.groupBy("session", "trial").agg(F.min_by(recipe.outcome, "row_ord").alias("outcome"))
    held = rows.select("session", "id", "roi", "trial", "y", "row_ord").join(labels, ["session", "trial"], "left")
    return held.withColumn("outcome", F.coalesce("outcome", F.lit("nan")))


def side_of(passive: bool, alignment: str) -> Column:
    """Target, reference or neither."""
    if not passive:
        return F.when(F.col("outcome").isin(*TARGET_OUTCOMES), "target").otherwise("reference")
    target, reference = ("Rew", "Stim") if alignment == "reward" else ("Stim", "Rew")
    return F.when(F.col("outcome").contains(target), "target").when(F.col("outcome").contains(reference), "reference")


def regenerate(tables: Mapping[str, DataFrame], params: EventTableParams, alignment: str, groups: list[str] | None = None) -> DataFrame:
    """Events of the groups whose tables are there: ``group, side, k0, k1, trial, outcome, history, …`` and metrics.

    Passive groups have a key of session and unit, the others one text; passive outcomes are also the history.
    """
    window = params.reward_window_s if alignment == "reward" else params.stim_window_s
    pieces = []
    for group in groups or list(RECIPES):
        for recipe in RECIPES[group]:
            if recipe.traces not in tables:
                continue
            rows = without_empty_frames(session_traces(tables, recipe))
            baseline = params.baseline_window_overrides.get(group, recipe.baseline)
            by_rate: dict[float, Column] = {recipe.fps: ~F.col("session").isin(*recipe.fps_of)} if recipe.fps_of else {recipe.fps: F.lit(True)}
            for name, fps in recipe.fps_of.items():
                by_rate[fps] = by_rate.get(fps, F.lit(False)) | (F.col("session") == name)
            for fps, where in by_rate.items():
                found = detect(
                    rows.where(where), recipe.mode, fps, params.threshold_sd, params.min_samples, baseline,
                    recipe.label_base, window, recipe.validated_only,
                )
                none = F.lit(None).cast("string")
                own = (F.col("session"), F.col("roi")) if recipe.passive else (suffixed_key("session", "roi"), none)
                key = [c.alias(n) for n, c in zip(("k0", "k1"), own, strict=True)]
                history = F.col("outcome") if recipe.passive else none
                head = [F.lit(group).alias("group"), side_of(recipe.passive, alignment).alias("side"), *key]
                pieces.append(found.select(*head, "trial", "outcome", history.alias("history"), *METRICS, "row_ord"))
    if not pieces:
        raise ValueError(f"none of the groups' tables is there: {recipe_tables(groups or list(RECIPES))}")
    return reduce(DataFrame.unionByName, pieces).where("side is not null")
