"""Rounding and wording against Python's own."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracewise.functions import formats

TIES = [0.0625, 6.25, 0.15, 0.25, 0.35, 12.5 / 2, 0.1875, 2.675, 1.005, 0.5, 1.5, 2.5, -0.25, -6.25, -0.0625, 100.0, 0.0, 67.05, 1e-9, 0.99995, 1 / 16 * 100, 3 / 16 * 100, 1e17 + 0.5]


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(3)
    values = TIES + [rng.uniform(-120, 120) for _ in range(3000)] + [n / 16 for n in range(-400, 400)] + [n / 2000 for n in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 3, 4):
        for r in df.select("v", formats.rounded_half_even(F.col("v"), digits).alias("r")).collect():
            assert r.r == round(r.v, digits), r.v


def test_symbols_and_sentences_are_spelled_alike(spark):
    df = spark.createDataFrame([(v,) for v in [0.0625, 0.15, 0.05, 0.9996, 1.0, 0.1, 0.0735]], "p double")
    for r in df.select("p", formats.significance_symbol(F.col("p")).alias("s")).collect():
        assert r.s == str(round(r.p, 3))
    assert spark.range(1).select(formats.percent(F.lit(1.0), F.lit(16.0))).first()[0] == 6.2
    row = [(9, 42, 0.01085, 5.2545, 5.4285, 0.0625, 0.028, "x")]
    held = spark.createDataFrame(row, "n_a int, n_b int, p_value double, mean_a double, mean_b double, sem_a double, sem_b double, name string")
    n_a, n_b, p, a, b, sa, sb, _ = row[0]
    want = f"{n_a} ROIs vs. {n_b}, p={round(p, 4)}; a: {round(a, 3)} +/- {round(sa, 3)}, b: {round(b, 3)} +/- {round(sb, 3)}"
    assert held.select(formats.describe_comparison()).first()[0] == want
    assert spark.range(1).select(formats.shown(F.lit(float("nan")), 3)).first()[0] == "nan"


def test_file_names():
    assert formats.slug("early reward", "NO_DREADDs cHIT vs. nHIT") == "early_reward_NO_DREADDs_cHIT_vs._nHIT"
