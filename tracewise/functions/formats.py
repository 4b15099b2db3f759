"""Times, percentages and the wording of results."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The levels at which a p-value gets its stars, and what regressions print beyond the last.
STARS = ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (5e-2, "*"))
NOT_SIGNIFICANT = "n.s"


def frame_index(seconds: float, fps: float) -> int:
    """Nearest frame; halves go to the even one."""
    return round(seconds * fps)


def seconds(place: Column, base: int, fps: Column | float) -> Column:
    """Time of a frame whose labels count from ``base``."""
    return (place + F.lit(base)) / (F.lit(float(fps)) if isinstance(fps, (int, float)) else fps)


def rounded_half_even(x: Column, digits: int) -> Column:
    """``x`` to so many digits, by the exact value that the double holds; a tie goes to the even digit.

    Twice the value in units of the last digit is compared with the odd number in between. To be exact, the product is
    taken of the value's upper and lower bits apart (Dekker's split). Beyond 2^53 such units nothing is left to round.
    """
    unit = F.lit(float(10**digits))
    low = F.floor(x * unit).cast("double")
    wide = x * F.lit(134217729.0)
    upper = wide - (wide - x)
    over = (upper * (2 * unit) - (2 * low + 1)) + (x - upper) * (2 * unit)
    up = (over > 0) | ((over == 0) & (low % 2 != 0))
    return F.when(F.abs(x) * unit < F.lit(2.0**53), (low + F.when(up, 1.0).otherwise(0.0)) / unit).otherwise(x)


def shown(x: Column, digits: int) -> Column:
    """A number rounded to four digits at most, and spelled without trailing zeros, but with a digit after the point."""
    value = rounded_half_even(x, digits)
    plain = F.regexp_replace(F.format_string(f"%.{digits}f", value), r"(\.\d+?)0+$", "$1")
    out = F.when(value.isNull() | F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
    return out.otherwise(plain)


def significance_symbol(p: Column) -> Column:
    """Stars, or the p-value to three digits."""
    out = F.when(F.isnan(p) | p.isNull(), F.lit("nan"))
    for level, stars in STARS:
        out = out.when(p < level, F.lit(stars))
    return out.otherwise(shown(p, 3))


def regression_symbol(p: Column) -> Column:
    """Stars, or that the slope is not significant."""
    out = F.when(p < STARS[0][0], F.lit(STARS[0][1]))
    for level, stars in STARS[1:]:
        out = out.when(p < level, F.lit(stars))
    return out.otherwise(F.lit(NOT_SIGNIFICANT))


def percent(part: Column, whole: Column) -> Column:
    """Per cent to one digit."""
    return rounded_half_even(part / whole * 100, 1)


def describe_comparison() -> Column:
    """A sentence on a row of comparison results."""
    of = lambda g: F.concat(shown(F.col(f"mean_{g}"), 3), F.lit(" +/- "), shown(F.col(f"sem_{g}"), 3))
    return F.concat(F.col("n_a").cast("string"), F.lit(" ROIs vs. "), F.col("n_b").cast("string"), F.lit(", p="), shown(F.col("p_value"), 4), F.lit("; a: "), of("a"), F.lit(", b: "), of("b"))


def describe_match() -> Column:
    """A sentence on a row of a match report."""
    return F.format_string(
        "%s/%s: %d/%d exact (%.1f%%), %d onset-only, %d missing, %d extra (regenerated %d)",
        "group", "side", "n_exact", "n_reference", rounded_half_even(F.col("exact_fraction") * 100, 1), "n_onset_only", "n_missing", "n_extra", "n_regenerated",
    )


def slug(*parts: str) -> str:
    """A name for files: parts joined by underscores, without what paths don't bear."""
    return re.sub(r"[^A-Za-z0-9.+-]+", "_", "_".join(p for p in parts if p)).strip("_")
