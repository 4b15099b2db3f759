"""Counting, grouping, modulation, metrics, tests, latencies and reports on cases small enough to check by eye."""

from __future__ import annotations

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tracewise.functions import formats, keys, pvalues
from tracewise.operators import display, grouping, latency, metrics, modulation, prefix, selection, stats, validation

PASSIVE = "NAIVE STIM REW"


@pytest.fixture(scope="module")
def tables(spark):
    flat = "id string, ttype string, n_trials int, row_ord long"
    behavior = "id string, protocol string, compartment string, history string"
    dendrite = "cohort string, td string, mouse string, `trial type` string"
    traces = "id string, protocol string, compartment string, fov string, roi string, row_ord long"
    of = spark.createDataFrame
    days = lambda cohort, by: [(cohort, td, "MUJI", t) for td, types in by.items() for t in types]
    return {
        "trials_task_axons": of([("muji_FOV2", t, n, i) for i, (t, n) in enumerate([("HIT", 4), ("HIT", 5), ("FA", 1), ("CATCH", 2), ("ALL", 10), ("resp x", 9), ("None", 3)])], flat),
        "trials_no_dreadds": of([("one_FOV7", "HIT", 4, 0), ("one_FOV7", "CATCH", 3, 1), ("one_FOV7", "ALL", 9, 2)], flat),
        "behavior_batch1": of([("two", PASSIVE, "AXONS", h) for h in ("cRew", "nRew", "nStim")] + [("two", "OTHER", "AXONS", "cRew")], behavior),
        "behavior_batch3": of([("two", PASSIVE, h) for h in ("cRew", "cStim", "nStim")], "id string, protocol string, history string").withColumn("fov", F.lit("FOV1")),
        "behavior_task_dendrites": of(days("t", {"TD0": ["cHIT", "nHIT", "CR"], "TD2": ["cHIT", "FA", "nCATCH"]}), dendrite),
        "behavior_control_dendrites": of(days("c", {"TD1": ["cHIT", "miss"], "TD2": ["nHIT", "CATCH"]}), dendrite),
        "traces_batch1": of([("two", PASSIVE, "AXONS", None, f"ROI{i}", i) for i in (1, 2)], traces),
        "traces_batch3": of([("two", PASSIVE, None, "FOV0", "ROI6", 0)] + [("two", PASSIVE, None, "FOV1", f"ROI{i}", i) for i in (7, 8, 9)], traces),
        "traces_task_axons": of([("muji_FOV2", None, None, None, r, 0) for r in ("1", "2")], traces),
        "traces_no_dreadds": of([("one_FOV7", None, None, None, "3", 0)], traces),
    }


def test_totals_and_their_slip(tables):
    counts = grouping.trial_counts(tables)
    got = {r.protocol: (r.n_target, r.n_reference) for r in grouping.trial_totals(counts, "reward").collect()}
    assert got["task_axons"] == (5, 3) and got["passive_axons"][0] == 3
    assert counts.where("ttype in ('resp x', 'None')").count() == 0
    slip = {r.protocol: (r.n_target, r.n_reference) for r in grouping.trial_totals(counts, "stimulus").collect()}
    mended = {r.protocol: (r.n_target, r.n_reference) for r in grouping.trial_totals(counts, "stimulus", legacy=False).collect()}
    pre, post = "task_dendrites (pre-CNO)", "task_dendrites (post-CNO)"
    assert slip[pre] == (2, 2) and mended[pre] == (2, 0) and mended[post][1] == 2
    control = counts.where("protocol = 'control_dendrites (pre-CNO)'").collect()
    assert {(r.td, r.session, r.ttype, r.n) for r in control} == {("TD1", "muji", "cHIT", 1), ("TD1", "muji", "miss", 1)}


def test_denominators(spark, tables):
    counts = grouping.trial_counts(tables)
    rates = {(r.protocol, r.session, r.outcome): r.n_trials for r in metrics.rate_denominators(counts, "reward").collect()}
    assert rates["task_dendrites (pre-CNO)", "muji", "HIT"] == 2 and rates["task_axons", "muji_FOV2", "HIT"] == 5
    units = spark.createDataFrame([("task_axons", "muji_FOV2_66.0", None), ("task_dendrites (post-CNO)", "muji", "42.0"), ("passive_axons", "GCaMP_POm_Batch3_two_FOV1", "ROI7")], "protocol string, k0 string, k1 string")
    got = {r.protocol: (r.n_target, r.n_reference) for r in grouping.modulation_denominators(units, counts, "reward").collect()}
    assert got == {"task_axons": (5, 5), "task_dendrites (post-CNO)": (1, 2), "passive_axons": (1, 2)}
    days = {r.k1: r.td for r in grouping.with_day(spark.createDataFrame([("p (post-CNO)", "m", "5_TD3"), ("p (post-CNO)", "m", "5")], units.schema), spark.createDataFrame([("p (post-CNO)", "TD2"), ("p (post-CNO)", "TD3")], "protocol string, td string")).collect()}
    assert days == {"5_TD3": "TD3", "5": "TD2"}


def test_sessions_of_one_part_keys(spark):
    rows = spark.createDataFrame([("a_b_1.0", None), ("a_b_1", None), ("s", "r")], "k0 string, k1 string")
    got = rows.select(grouping.rate_session().alias("r"), grouping.modulation_session().alias("m")).collect()
    assert [(r.r, r.m) for r in got] == [("a_b", "a_b"), ("a_b_1", "a_b"), ("s", "s")]


def test_pooling_and_its_slip(spark):
    files = spark.createDataFrame([("task_dendrites_TD0", "r1"), ("task_dendrites_TD0", "r2"), ("task_dendrites_TD1", "r2"), ("task_dendrites_TD1", "r3"), ("MODIFIED_task_dendrites_TD3", "r4_TD3")], "stem string, k0 string").withColumn("k1", F.lit(None).cast("string"))
    of = lambda legacy: sorted((r.protocol, r.k0) for r in grouping.pooled_events(files, legacy=legacy).collect())
    pre, post = "task_dendrites (pre-CNO)", ("task_dendrites (post-CNO)", "r4_TD3")
    assert of(True) == [post, (pre, "r1"), (pre, "r2"), (pre, "r2")]
    assert of(False) == [post, (pre, "r1"), (pre, "r2")]


def test_universe_and_its_slips(spark, tables):
    stems = [("TD0_CONTROL_f", "1"), ("TD0_CONTROL_f", "2"), ("TD2_CONTROL_f", "3"), ("MODIFIED_TD3_CONTROL_f", "4"), ("MODIFIED_TD3_CONTROL_f", "5")]
    frequencies = spark.createDataFrame(stems, "stem string, k1 string").withColumn("k0", F.lit("m"))
    n = lambda legacy, p: grouping.unit_universe(frequencies, tables, legacy).where(F.col("protocol") == p).count()
    assert (n(True, "control_dendrites (post-CNO)"), n(False, "control_dendrites (post-CNO)")) == (1, 3)
    one = lambda legacy: sorted(r.k1 for r in grouping.trace_units(tables, legacy).where("k0 like 'RGECO%'").collect())
    assert one(True) == ["ROI7", "ROI8", "ROI9"] and one(False) == ["ROI1", "ROI2"]
    flat = grouping.trace_units(tables).where("protocol = 'task_axons'").collect()
    assert sorted((r.k0, r.k1) for r in flat) == [("muji_FOV2_1", None), ("muji_FOV2_2", None)]


UNIT = "protocol string, k0 string, k1 string"


@pytest.mark.parametrize(("targets", "references", "want"), [(2, 1, 0.6), (2, 0, 0.2), (15, 0, 1.0)])
def test_modulation_index(spark, targets, references, want):
    rows = [("p", "s", "r", side) for side, n in (("target", targets), ("reference", references)) for _ in range(n)] + [("p", "s", "only reference", "reference")]
    events = spark.createDataFrame(rows, UNIT + ", side string")
    denominators = spark.createDataFrame([("p", "s", "r", 10, 20)], UNIT + ", n_target long, n_reference long")
    got = modulation.modulation_index(events, denominators).collect()
    assert [(r.k1, round(r.mi, 9)) for r in got] == [("r", want)]


def test_units_without_counts_are_errors(spark):
    events = spark.createDataFrame([("p", "s", "r", "target")], UNIT + ", side string")
    none = spark.createDataFrame([], UNIT + ", n_target long, n_reference long")
    with pytest.raises(SparkRuntimeException):
        modulation.modulation_index(events, none).collect()


@pytest.mark.parametrize(("values", "kind", "want"), [([0.1, 0.2, 0.3], "median", [0.3]), ([-1.0, 0.0, 1.0], "half_std", [1.0]), ([0.0, 0.0, 0.9], "mean", [0.9])])
def test_cutoffs(spark, values, kind, want):
    rows = spark.createDataFrame([("p", "s", str(i), v) for i, v in enumerate(values)], UNIT + ", mi double")
    assert [r.mi for r in modulation.modulated_units(rows, kind).collect()] == want
    with pytest.raises(ValueError):
        modulation.cutoffs(rows, "mode")


def test_proportions(spark):
    many = lambda n: spark.range(n).select(F.lit("p").alias("protocol"), F.lit("s").alias("k0"), F.col("id").cast("string").alias("k1"))
    row = modulation.modulation_proportions(many(130), many(194)).first()
    assert (row.n_modulated, row.n_total, row.percent) == (130, 194, 67.0)


METRIC = UNIT + ", side string, outcome string, history string, ev_onset double, peak double"


def events(spark, rows):
    made = spark.createDataFrame(rows, METRIC)
    return made.withColumns({c: F.lit(1.0) for c in ("peak_time", "ev_offset", "ev_duration", "integral")})


def test_metrics_rates_and_pools(spark):
    rows = [("task_axons", "muji_FOV2_66.0", None, "target", o, None, on, p) for o, on, p in (("cHIT", 5.2, 1.0), ("cHIT", 5.4, 2.0), ("nHIT", 5.3, 3.0), ("nHIT", 6.5, 9.0), ("FA", 5.2, 4.0), ("cHIT", 5.15, 5.0))]
    counts = spark.createDataFrame([("task_axons", "muji_FOV2", t, n) for t, n in (("HIT", 10), ("cHIT", 4), ("nHIT", 6), ("FA", 2), ("ALL", 12))], "protocol string, session string, ttype string, n long")
    held = metrics.pooled_outcomes(metrics.whitelisted(events(spark, rows), "reward"), "reward").withColumn("of", grouping.rate_session())
    held = held.where("ev_onset > 5.1 and ev_onset < 6.1")
    denominators = metrics.rate_denominators(counts, "reward")
    got = {r.outcome: r for r in metrics.metrics_by_unit(held, denominators, "reward", "of").collect()}
    assert set(got) == {"cHIT", "nHIT", "HIT"}
    assert got["cHIT"].rate == 0.75 and got["HIT"].rate == 0.4 and got["HIT"].peak == 2.75
    universe = spark.createDataFrame([("task_axons", "muji_FOV2_66.0", None, "muji_FOV2"), ("task_axons", "muji_FOV2_7.0", None, "muji_FOV2"), ("task_axons", "x_1.0", None, "x")], UNIT + ", of string")
    filled = metrics.fill_inactive(metrics.metrics_by_unit(held, denominators, "reward", "of"), universe, denominators, "of")
    assert {(r.k0, r.outcome): r.rate for r in filled.collect() if r.k0 != "muji_FOV2_66.0"} == {(k, o): v for k, v in (("muji_FOV2_7.0", 0.0), ("x_1.0", None)) for o in ("cHIT", "nHIT", "HIT")}
    with pytest.raises(SparkRuntimeException):
        metrics.metrics_by_unit(held, denominators.where("false"), "reward", "of").collect()


def test_reference_side_wins_an_outcome(spark):
    rows = [("passive_axons", "s", "r", side, "x", "cRew", 5.2, p) for side, p in (("target", 1.0), ("reference", 3.0))]
    held = metrics.whitelisted(events(spark, rows), "reward")
    counts = spark.createDataFrame([("passive_axons", "s", "cRew", 2)], "protocol string, session string, outcome string, n_trials long")
    assert [r.peak for r in metrics.metrics_by_unit(held, counts, "reward").collect()] == [3.0]


def test_pooled_names_stand_twice(spark):
    rows = [("task_axons", "k", None, "target", "HIT", None, 5.2, 1.0), ("passive_axons", "k", "r", "target", "x", "cRew", 5.2, 1.0)]
    got = metrics.pooled_outcomes(metrics.whitelisted(events(spark, rows), "reward"), "reward").collect()
    assert sorted(r.outcome for r in got) == ["HIT", "HIT", "Rew", "cRew"]


def test_modulated_only_leaves_unlisted_protocols(spark):
    rows = spark.createDataFrame([("p", "s", "a", 1), ("p", "s", "b", 2), ("q", "s", None, 3)], UNIT + ", v int")
    got = metrics.modulated_only(rows, spark.createDataFrame([("p", "s", "b")], UNIT))
    assert sorted(r.v for r in got.collect()) == [2, 3]


def test_normalisation(spark):
    values = spark.createDataFrame([("p", o, "s", str(i), v) for o, vs in (("a", (6.0, 8.0)), ("ref", (10.0, None, 20.0))) for i, v in enumerate(vs)], "protocol string, outcome string, k0 string, k1 string, value double")
    got = lambda off: sorted(round(r.value, 6) for r in metrics.normalized(values, ("p", "a"), ("p", "ref"), off).collect())
    assert got(0.0) == [0.4, round(8 / 15, 6)] and got(5.0) == [0.1, 0.3]


# N, mean, standard error and p of published Student and regression results.
STUDENT = [
    ((67, 95), (0.9409414852072405, 1.1160085164132116), (0.07613637766318239, 0.06703298520846161), 0.0888901506867474),
    ((37, 83), (4.290479058181663, 4.238076181739128), (0.2742415572121849, 0.1554403503960267), 0.8597929860444746),
    ((9, 42), (5.255262264929833, 5.428860736199918), (0.04972790711613515, 0.02838754698005071), 0.010977656236674125),
    ((28, 9), (5.659532790013695, 5.255262264929833), (0.04615339471725565, 0.04972790711613515), 4.363571057450155e-05),
    ((8, 76), (3.3835258525852585, 3.3062141740489834), (0.03124468582921277, 0.01281401394573381), 0.06196578489635797),
]
REGRESSIONS = [(0.2615272474698988, 209, 1.3079040810485187e-4), (0.23407690040157622, 215, 5.393073657787408e-4)]


@pytest.mark.parametrize(("n", "mean", "sem", "p"), STUDENT)
def test_published_student_values(n, mean, sem, p):
    va, vb = (s * s * k for s, k in zip(sem, n, strict=True))
    pooled = ((n[0] - 1) * va + (n[1] - 1) * vb) / (n[0] + n[1] - 2)
    t = (mean[0] - mean[1]) / math.sqrt(pooled * (1 / n[0] + 1 / n[1]))
    assert pvalues.student_p(t, n[0] + n[1] - 2) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize(("r", "n", "p"), REGRESSIONS)
def test_published_regressions(r, n, p):
    assert pvalues.pearson_p(r, n) == pytest.approx(p, rel=1e-9)


def test_exact_rank_nulls_by_counting():
    from itertools import combinations, product

    n, m = 4, 5
    us = [sum(c) - n * (n - 1) // 2 for c in combinations(range(n + m), n)]
    for u in range(n * m + 1):
        high = max(u, n * m - u)
        assert pvalues.rank_sum_p(u, n, m, 0) == pytest.approx(min(1, 2 * sum(x >= high for x in us) / len(us)))
    ws = [sum(i + 1 for i, s in enumerate(signs) if s) for signs in product((0, 1), repeat=6)]
    for w in range(11):
        assert pvalues.signed_rank_p(w, 6, 0, 0) == pytest.approx(min(1, 2 * sum(x <= w for x in ws) / 64))
    assert pvalues.normal_p(1.959963984540054) == pytest.approx(0.05)
    assert pvalues.student_p(2.2281388519649385, 10) == pytest.approx(0.05)
    assert pvalues.student_p(12.706204736432095, 1) == pytest.approx(0.05)


def compare(spark, a, b, test, threshold=0.05):
    rows = [("p", side, "s", str(i), v) for side, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)]
    values = spark.createDataFrame(rows, "protocol string, outcome string, k0 string, k1 string, value double")
    specs = spark.createDataFrame([("x", test, "p", "a", "p", "b", threshold)], "name string, test string, a_protocol string, a_outcome string, b_protocol string, b_outcome string, p_threshold double")
    return stats.run_comparisons(stats.samples(values, specs), specs, (test,)).first()


def test_pairs_and_missing_values(spark):
    nan = float("nan")
    a, b = [nan, *[float(i) for i in range(1, 12)]], [float(2 * i) for i in range(12)]
    b[3] = nan
    assert (compare(spark, a, b, "student_t").n_a, compare(spark, a, b, "student_t").n_b) == (11, 11)
    paired = compare(spark, a, b, "paired_t")
    kept = [(x, y) for x, y in zip(a, b, strict=True) if not (math.isnan(x) or math.isnan(y))]
    assert (paired.n_a, paired.n_b) == (10, 10) and paired.mean_a == pytest.approx(sum(x for x, _ in kept) / 10)
    w = compare(spark, [1.0, 2.0, 3.0, 4.0, 9.0], [2.0, 2.0, 5.0, 1.0, 5.0], "wilcoxon")
    assert w.statistic == 3.0 or w.statistic == pytest.approx(3.0)


def test_rank_sum_and_gate(spark):
    r = compare(spark, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], "mannwhitney", 0.1)
    assert (r.statistic, r.p_value, r.passed, r.symbol) == (0.0, pytest.approx(0.1), False, "0.1")
    tied = compare(spark, [1.0, 1.0, 2.0], [1.0, 2.0, 2.0], "mannwhitney")
    assert tied.statistic == pytest.approx(3.0) and 0 < tied.p_value <= 1
    welch = compare(spark, [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0], "welch_t")
    assert welch.statistic == pytest.approx(-2.5 / math.sqrt((5 / 3) / 4 + (20 / 3) / 4))


def test_symbols(spark):
    rows = spark.createDataFrame([(p,) for p in (5e-5, 5e-4, 5e-3, 0.04, 0.2)], "p double")
    assert [r[0] for r in rows.select(formats.significance_symbol(F.col("p"))).collect()] == ["****", "***", "**", "*", "0.2"]
    assert [r[0] for r in rows.select(formats.regression_symbol(F.col("p"))).collect()][-1] == "n.s"


def test_key_spellings(spark):
    rows = spark.createDataFrame([("muji_FOV2_66.0", None), ("muji", "57.0"), ("muji", "42.0_TD3")], "a string, b string")
    assert [r[0] for r in rows.select(keys.canonical_key("a", "b")).collect()] == ["muji_FOV2_66", "muji::57", "muji::42_TD3"]


def test_latency_per_trial(spark):
    rows = [("s", "r", 1, 5.1), ("s", "r", 1, 5.2), ("s", "r", 1, 5.4), ("s", "r", 1, 5.5), ("s", "r", 2, 5.3), ("s", "other", 2, 5.4)]
    found = spark.createDataFrame(rows, "k0 string, k1 string, trial int, ev_onset double")
    licks = spark.createDataFrame([("s", 1, 0.3)], "session string, trial long, lick_latency double")
    units = spark.createDataFrame([("s", "r")], "k0 string, k1 string")
    got = {r.trial: r for r in latency.per_trial_latencies(found, units, licks).collect()}
    assert got[1].ev_onset == pytest.approx((0.1 + 0.2 + 0.4) / 3) and got[1].lick_latency == 0.3
    assert got[2].lick_latency is None and set(got) == {1, 2}


def test_correlation_clips_and_drops(spark):
    rows = [("s", i, i / 100, i / 50 + (i % 3) / 40) for i in range(58)] + [("s", 58, 40.0, 0.1), ("t", 59, None, 0.2)]
    per = spark.createDataFrame(rows, "session string, trial long, lick_latency double, ev_onset double")
    points, line = latency.latency_correlation(per)
    row = line.first()
    assert (points.count(), row.n_points, row.n_trials, row.n_no_lick, row.n_sessions) == (58, 58, 59, 1, 1)
    assert row.r > 0.9 and row.p < 1e-6


def test_match_report(spark):
    base = "group string, side string, k0 string, k1 string, trial string, ev_onset double, ev_offset double, peak double, row_ord long"
    more = {c: F.lit(1.0) for c in ("peak_time", "ev_duration", "integral")}
    row = lambda t, on, off, peak, i: ("g", "target", "s", "r", t, on, off, peak, i)
    reference = spark.createDataFrame([row("1", 5.0, 5.5, 1.0, 0), row("2", 5.1, 5.6, 1.0, 1), row("3", 5.2, 5.7, 1.0, 2)], base).withColumns(more)
    found = spark.createDataFrame([row("1.0", 5.0, 5.5, 1.5, 0), row("2", 5.1, 5.9, 1.0, 1), row("9", 6.0, 6.1, 1.0, 2)], base).withColumns(more)
    r = validation.match_report(found, reference).withColumn("m", validation.max_metric_diff()).withColumn("s", formats.describe_match()).first()
    assert (r.n_reference, r.n_regenerated, r.n_exact, r.n_onset_only, r.n_missing, r.n_extra) == (3, 3, 1, 1, 1, 1)
    assert r.exact_fraction == pytest.approx(1 / 3) and r.m["peak"] == 0.5 and r.s.startswith("g/target: 1/3 exact")
    nothing = validation.match_report(found, reference.limit(0)).first()
    assert nothing.exact_fraction == 1.0 and nothing.n_extra == 3


def test_pinned_values():
    pinned = {"a": {"x": 1, "y": 2.0}, "b": (1, 2), "c": 3.0}
    got = validation.check_values({"a": {"x": 1, "y": 2.0001, "z": 9}, "b": [1, 2]}, pinned)
    assert [r["passed"] for r in got] == [True, True, False]


def test_pinned_values_grade_a_run():
    assert not any(r["passed"] for r in validation.check_values({}))
    assert all(r["passed"] for r in validation.check_values(dict(validation.PINNED)))
    near = dict(validation.PINNED) | {"reward.regression.task_axons_p_value": 0.91, "reward.rewarded_trials": validation.PINNED["reward.rewarded_trials"] | {"task_axons": 69}}
    assert {r["name"] for r in validation.check_values(near) if not r["passed"]} == {"reward.rewarded_trials"}
    wanted = validation.PINNED["reward.modulated_proportions"]
    assert {k: round(100 * a / b, 1) for k, (a, b) in wanted.items()}["passive_axons"] == 67.0



def test_histogram(spark):
    rows = [("p", "target", x) for x in (5.0, 5.05, 5.1, 6.45, 6.5, 6.51, 4.99)]
    totals = spark.createDataFrame([("p", 10, 5)], "protocol string, n_target long, n_reference long")
    units = spark.createDataFrame([("p", 4)], "protocol string, n_units long")
    df = spark.createDataFrame(rows, "protocol string, side string, ev_onset double")
    got = {r.bin: (r.n_events, round(r.weight, 9)) for r in display.onset_histogram(df, totals, unit_counts=units).collect()}
    assert sum(n for n, _ in got.values()) == 5 and got[0] == (2, 0.05) and got[14] == (2, 0.05)


def brute_matches(found, reference, tolerance):
    out = []
    for ref, key, on, off in reference:
        near = [f for f in found if f[1] == key and on is not None and f[2] is not None and abs(f[2] - on) <= tolerance]
        exact = [f for f in near if off is not None and f[3] is not None and abs(f[3] - off) <= tolerance]
        out.append((ref, "exact" if exact else "onset" if near else "missing", min(f[0] for f in exact) if exact else max((f[0] for f in near), default=None)))
    return sorted(out)


@pytest.mark.parametrize("tolerance", [1e-9, 0.0, 0.25])
def test_matches_at_the_edges_of_bins(spark, tolerance):
    rng = np.random.default_rng(1)
    width = max(4 * tolerance, 1e-9)
    # Whole multiples of a bin, and just a tolerance from them, one double less or more; many equal; far ones with coarse doubles.
    near = [float(v) for i in rng.integers(0, 6, 60) for v in (i * width, i * width + tolerance, np.nextafter(i * width - tolerance, 9), np.nextafter(i * width + tolerance, -9))]
    values = [*near, *[1e6 + i * 1e-10 for i in range(20)], None, float("nan"), float("inf")]
    pick = lambda: values[int(rng.integers(0, len(values)))]
    found, reference = ([(i, f"r{int(rng.integers(0, 2))}", pick(), pick()) for i in range(250)] for _ in range(2))
    table = lambda rows: spark.createDataFrame([("g", "target", "s", k, 1, on, off, 1.0, 1.0, 1.0, 1.0, i) for i, k, on, off in rows], "group string, side string, k0 string, k1 string, trial long, ev_onset double, ev_offset double, peak double, peak_time double, ev_duration double, integral double, row_ord long")
    got = validation.matched(table(found), table(reference), tolerance=tolerance).collect()
    assert sorted((r.ref_ord, r.how, r.match and r.match.f_row_ord) for r in got) == brute_matches(found, reference, tolerance)


def test_matching_one_hot_trial_is_linear(spark):
    """One unit and trial with 30,000 events, a third at one onset: in pairs, 3e8 candidates."""
    n = 30_000
    onset = F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 100)
    rows = spark.range(n).select(
        F.lit("g").alias("group"), F.lit("target").alias("side"), F.lit("s").alias("k0"), F.lit("r").alias("k1"), F.lit(1).alias("trial"), onset.alias("ev_onset"),
        (onset + F.col("id") % 7).alias("ev_offset"), *[F.lit(1.0).alias(m) for m in validation.METRICS], F.col("id").alias("row_ord"),
    )
    began = time.perf_counter()
    report = validation.match_report(rows, rows).first()
    assert (report.n_reference, report.n_exact, report.n_missing) == (n, n, 0) and time.perf_counter() - began < 60


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ranks_do_not_depend_on_ranges(spark, parts, monkeypatch):
    """Ties over the edges of ranges, several comparisons, one of them hot; no range holds the whole of it."""
    rng = np.random.default_rng(2)
    rows = [("hot", "mannwhitney", "ab"[int(rng.integers(0, 2))], float(rng.integers(0, 40)) / 10) for _ in range(900)] + [("small", "mannwhitney", g, v) for g, v in (("a", 1.0), ("b", 1.0), ("a", 2.0))]
    df = spark.createDataFrame(rows, "name string, test string, group string, value double")
    plain, dealt = prefix.running_sums, []

    def spy(*args, **kw):
        kw["parts"] = parts
        dealt.append(prefix.ranges(args[0], args[1], args[2], parts).groupBy(prefix.RANGE).count().count())
        return plain(*args, **kw)

    monkeypatch.setattr(stats, "running_sums", spy)
    got = {r["name"]: (r.u, r.tie_sum) for r in stats.rank_sums(df).collect()}
    for name in ("hot", "small"):
        held = [(v, g) for n, _, g, v in rows if n == name]
        u = sum((a > b) + 0.5 * (a == b) for a, g in held if g == "a" for b, h in held if h == "b")
        ties = sum(t**3 - t for t in Counter(v for v, _ in held).values())
        assert got[name] == (u, ties)
    assert dealt == [parts]


def test_running_sums_and_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", None, "c"][int(rng.integers(0, 3))], i, int(rng.integers(0, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    for parts in (None, 1, 7):
        got = {r.i: r.before for r in prefix.running_sums(df, ["k"], ["i"], parts, before=F.col("v")).collect()}
        assert got == {i: sum(v for k2, j, v in rows if k2 == k and j < i) for k, i, _ in rows}
        numbers = prefix.numbered(df, [F.desc("v"), F.asc("i")], "place", parts).collect()
        assert [r.place for r in sorted(numbers, key=lambda r: (-r.v, r.i))] == list(range(1, 301))
    assert prefix.numbered(df.limit(0), ["i"]).count() == 0 and prefix.running_sums(df.limit(0), ["k"], ["i"], before=F.col("v")).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_by_narrowing_are_exact(spark, q):
    rng = np.random.default_rng(4)
    inf, nan = float("inf"), float("nan")
    groups = {
        "normal": rng.normal(0, 1, 500), "tail": np.exp(rng.normal(0, 80, 401)) * rng.choice([-1, 1], 401), "tied": rng.choice([0.1, 0.2, 0.3], 300), "one": [7.0], "same": [2.5] * 50,
        "endless": [-inf, -inf, 1.0, 2.0, inf, nan, nan], "wide": [-1.7e308, 1.7e308, 1.0, -1.0], "least": np.arange(20) * 5e-324, "close": 1.0 + np.arange(30) * 2.0**-52, "zeros": [0.0, -0.0, 0.0, 1e-320], None: [3.0, 1.0],
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None)], "k string, v double").repartition(4)
    by = {r.k: r.quantile for r in selection.narrowed(df, ["k"], "v", q).collect()}
    want = {r.k: r.quantile for r in selection.quantiles(df, ["k"], "v", q).collect()}
    assert repr(sorted(by.items(), key=repr)).replace("-0.0", "0.0") == repr(sorted(want.items(), key=repr)).replace("-0.0", "0.0") and set(by) == set(groups)
    assert selection.quantiles(df, ["k"], "v", q, buffered=10).where("k = 'same'").first().quantile == 2.5
    assert selection.quantiles(df.limit(0), ["k"], "v", q).count() == 0
