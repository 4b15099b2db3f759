"""Two-group tests on per-unit values: statistics by Spark, p-values on the one row each comparison ends in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions import pvalues
from tracewise.functions.formats import significance_symbol
from tracewise.operators.prefix import running_sums

PAIRED = ("paired_t", "wilcoxon")
TESTS = ("student_t", "welch_t", "mannwhitney", "wilcoxon", "paired_t")
#: Digits that values are rounded to before they are ranked, so that sums in another order do not break ties.
RANK_DIGITS = 12
RESULTS = "name string, test string, statistic double, p_value double, n_a long, n_b long, mean_a double, mean_b double, sem_a double, sem_b double"


def samples(values: DataFrame, comparisons: DataFrame) -> DataFrame:
    """``name, test, group, k0, k1, value`` for each side of each comparison; null and NaN are left out.

    ``comparisons`` has one row per comparison: ``name, test, a_protocol, a_outcome, b_protocol, b_outcome``.
    """
    sides = comparisons.select("name", "test", F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"{g}_protocol").alias("protocol"), F.col(f"{g}_outcome").alias("outcome")) for g in "ab"])).alias("side"))
    sides = sides.select("name", "test", "side.*")
    rows = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.join(sides, ["protocol", "outcome"]).select("name", "test", "group", "k0", "k1", F.col("value").cast("double").alias("value"))


def _sides(rows: DataFrame) -> DataFrame:
    """``name, test`` with n, mean, standard error and variance of both groups."""
    out = []
    for g in "ab":
        v = F.when(F.col("group") == g, F.col("value"))
        out += [F.count(v).alias(f"n_{g}"), F.avg(v).alias(f"mean_{g}"), F.var_samp(v).alias(f"var_{g}"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"sem_{g}")]
    return rows.groupBy("name", "test").agg(*out)


def _tied(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` summed by distinct value, with ``tied`` and the mean ``place`` of each; ``rows`` has counts a and b.

    Distinct values are dealt to ranges, which are counted first; no task orders a whole comparison.
    """
    sums = rows.groupBy("name", "test", value).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("tied", F.col("a") + F.col("b"))
    return running_sums(sums, ["name", "test"], [value], before=F.col("tied")).withColumn("place", F.col("before") + (F.col("tied") + 1) / 2)


def rank_sums(rows: DataFrame) -> DataFrame:
    """``name, test, u, tie_sum``: U of the first group, and the sum of t^3 - t over tied values."""
    of = lambda g: (F.col("group") == g).cast("long").alias(g)
    placed = _tied(rows.select("name", "test", F.round("value", RANK_DIGITS).alias("value"), of("a"), of("b")), "value")
    n = F.sum("a")
    return placed.groupBy("name", "test").agg((F.sum(F.col("a") * F.col("place")) - n * (n + 1) / 2).alias("u"), F.sum(F.pow("tied", F.lit(3)) - F.col("tied")).alias("tie_sum"))


def paired_rows(rows: DataFrame) -> DataFrame:
    """Rows of units that have a value in both groups."""
    both = rows.groupBy("name", "test", "k0", "k1").agg(*[F.avg(F.when(F.col("group") == g, F.col("value"))).alias(g) for g in "ab"])
    return both.where("a is not null and b is not null")


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """``name, test, w, kept, zeros, tie_sum``: the smaller rank sum of differences other than zero."""
    d = pairs.withColumn("d", F.round(F.col("a") - F.col("b"), RANK_DIGITS))
    zeros = d.groupBy("name", "test").agg(F.count_if(F.col("d") == 0).alias("zeros"))
    rows = d.where("d <> 0").select("name", "test", F.abs("d").alias("size"), (F.col("d") > 0).cast("long").alias("a"), (F.col("d") < 0).cast("long").alias("b"))
    placed = _tied(rows, "size")
    sums = placed.groupBy("name", "test").agg(
        F.least(F.sum(F.col("a") * F.col("place")), F.sum(F.col("b") * F.col("place"))).alias("w"), F.sum("tied").alias("kept"), F.sum(F.pow("tied", F.lit(3)) - F.col("tied")).alias("tie_sum")
    )
    return zeros.join(sums, ["name", "test"], "left")


def _p(kind: str):
    if kind == "student_t":

        @F.pandas_udf("double")
        def run(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for t, freedom in rows:
                yield pd.Series([pvalues.student_p(*x) for x in zip(t, freedom, strict=True)], dtype=float)

    elif kind == "mannwhitney":

        @F.pandas_udf("double")
        def run(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for u, n, m, ties in rows:
                yield pd.Series([pvalues.rank_sum_p(a, int(b), int(c), d) for a, b, c, d in zip(u, n, m, ties, strict=True)], dtype=float)

    else:

        @F.pandas_udf("double")
        def run(rows: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for w, n, zeros, ties in rows:
                yield pd.Series([pvalues.signed_rank_p(a, int(b), int(c), d) for a, b, c, d in zip(w, n, zeros, ties, strict=True)], dtype=float)

    return run


def statistics(rows: DataFrame, test: str) -> DataFrame:
    """One row per comparison of this test among samples: statistic, ``freedom`` or rank terms, and both groups' n, mean and SEM."""
    if test not in TESTS:
        raise ValueError(f"test must be one of {TESTS}, got {test!r}")
    rows = rows.where(F.col("test") == test)
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    if test in PAIRED:
        pairs = paired_rows(rows)
        both = pairs.select("name", "test", F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).alias("value")) for g in "ab"])).alias("x")).select("name", "test", "x.*")
        held = _sides(both)
        if test == "paired_t":
            d = F.col("a") - F.col("b")
            t = pairs.groupBy("name", "test").agg((F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("statistic"), (F.count(d) - 1).cast("double").alias("freedom"))
            return held.join(t, ["name", "test"])
        return held.join(signed_ranks(pairs), ["name", "test"]).withColumn("statistic", F.col("w"))
    held = _sides(rows)
    if test == "mannwhitney":
        return held.join(rank_sums(rows), ["name", "test"]).withColumn("statistic", F.col("u"))
    gap = F.col("mean_a") - F.col("mean_b")
    if test == "student_t":
        pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
        return held.withColumns({"statistic": gap / F.sqrt(pooled * (1 / na + 1 / nb)), "freedom": (na + nb - 2).cast("double")})
    ea, eb = va / na, vb / nb
    return held.withColumns({"statistic": gap / F.sqrt(ea + eb), "freedom": (ea + eb) ** 2 / (ea**2 / (na - 1) + eb**2 / (nb - 1))})


def run_test(rows: DataFrame, test: str) -> DataFrame:
    """Results of all comparisons of one test among samples."""
    held = statistics(rows, test)
    if test == "mannwhitney":
        p = _p("mannwhitney")("u", "n_a", "n_b", "tie_sum")
    elif test == "wilcoxon":
        p = _p("wilcoxon")(F.coalesce("w", F.lit(0.0)), F.coalesce("kept", F.lit(0)), "zeros", F.coalesce("tie_sum", F.lit(0.0)))
    else:
        p = _p("student_t")("statistic", "freedom")
    return held.withColumn("p_value", p).select("name", "test", "statistic", "p_value", "n_a", "n_b", "mean_a", "mean_b", "sem_a", "sem_b")


def run_comparisons(rows: DataFrame, comparisons: DataFrame, tests: tuple[str, ...] = TESTS) -> DataFrame:
    """Results of all comparisons of samples, with the stars and whether p is below the comparison's ``p_threshold``."""
    out = run_test(rows, tests[0])
    for test in tests[1:]:
        out = out.unionByName(run_test(rows, test))
    gates = comparisons.select("name", "test", "p_threshold")
    marked = out.join(gates, ["name", "test"]).withColumn("passed", F.col("p_value") < F.col("p_threshold"))
    return marked.withColumn("symbol", significance_symbol(F.col("p_value"))).drop("p_threshold")
