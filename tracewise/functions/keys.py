"""Spelling of keys and labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes and day labels that the recordings' file names use.
PRE_DAYS = ("TD0", "TD1")
POST_DAYS = ("TD2", "TD3")
PRE, POST = " (pre-CNO)", " (post-CNO)"
MODIFIED = "MODIFIED_"


def canonical_key(*parts: Column | str) -> Column:
    """Parts joined by ``::``, each without the ``.0`` of whole numbers between its underscores."""
    plain = [
        F.array_join(F.transform(F.split(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), "_"), lambda x: F.regexp_replace(x, r"^(\d+)\.0$", "$1")), "_")
        for p in parts
    ]
    return F.concat_ws("::", *plain)


def suffixed_key(session: str, roi: str) -> Column:
    """``session_roi.0``, the one-part spelling of task recordings."""
    return F.concat(F.col(session), F.lit("_"), F.col(roi), F.lit(".0"))


def session_name(prefix: str, *parts: str) -> Column:
    """``prefix_part_part``; without a prefix the parts alone."""
    return F.concat_ws("_", *([F.lit(prefix)] if prefix else []), *[F.col(p).cast("string") for p in parts])


def match_key(k0: str, k1: str, trial: str) -> Column:
    """Unit and trial of an event, so spelled that differently stored tables agree."""
    return F.concat_ws("|", F.col(k0), F.col(k1), F.col(trial).cast("double").cast("long").cast("string"))


def without_modified(stem: Column) -> Column:
    """The stem after its last ``MODIFIED_``."""
    return F.when(stem.contains("MODIFIED"), F.element_at(F.split(stem, MODIFIED), -1)).otherwise(stem)


def contains_any(text: Column, marks) -> Column:
    """Whether the text holds one of the marks."""
    return reduce(Column.__or__, [text.contains(m) for m in marks], F.lit(False))


def phase_label(stem: Column) -> Column:
    """The protocol that a dendrite stem belongs to; other stems stand for themselves."""
    kind = F.when(stem.contains("task"), F.lit("task_dendrites")).otherwise(F.lit("control_dendrites"))
    return F.when(contains_any(stem, PRE_DAYS), F.concat(kind, F.lit(PRE))).when(contains_any(stem, POST_DAYS), F.concat(kind, F.lit(POST))).otherwise(stem)


def day_label(prefix: Column | str, day: Column) -> Column:
    """Protocol of a dendrite recording day."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(prefix, F.when(day.isin(*PRE_DAYS), F.lit(PRE)).otherwise(F.lit(POST)))


def whole_numbers(column: str) -> Column:
    """A text as a number where it is all digits, else null."""
    return F.when(F.col(column).rlike(r"^\d+$"), F.expr(f"try_cast(`{column}` AS BIGINT)"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet, with one copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "full_outer"):
        joined = joined.withColumns({k: F.coalesce(k, f"__r_{k}") for k in keys})
    return joined.drop(*[f"__r_{k}" for k in keys])
