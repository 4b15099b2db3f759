"""Segmentation, integrals, baselines, filters and detection on signals that are worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tracewise.functions.arrays import median, simpson
from tracewise.operators import detect as D
from tracewise.operators import recipes, signal
from tracewise.plans.specs import EventTableParams

SCHEMA = "session string, roi string, trial string, outcome string, y array<double>, row_ord long"
FPS = 30.54


def boxcar(n=100, at=50, size=10, height=5.0, noise=((10, 20, 0.1),)):
    y = np.zeros(n)
    for a, b, v in noise:
        y[a:b] = v * (-1.0) ** np.arange(b - a)
    y[at : at + size] = height
    return y.tolist()


def one(spark, *traces, outcome="cHIT"):
    return spark.createDataFrame([("s", "r", str(i), outcome, y, i) for i, y in enumerate(traces)], SCHEMA)


def test_boxcar_is_one_event(spark):
    rows = D.event_table(one(spark, boxcar()), 10.0).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.peak, r.ev_onset, r.peak_time, r.ev_offset, r.ev_duration) == (5.0, 5.0, 5.0, 5.9, 1.0)
    assert r.integral == pytest.approx(45.0)


@pytest.mark.parametrize(("height", "events"), [(0.15, 0), (0.25, 1)])
def test_threshold_is_two_deviations(spark, height, events):
    assert D.event_table(one(spark, boxcar(height=height)), 10.0).count() == events


@pytest.mark.parametrize(("size", "events"), [(5, 0), (6, 1)])
def test_least_width(spark, size, events):
    assert D.event_table(one(spark, boxcar(size=size)), 10.0).count() == events


def test_event_at_the_first_frame_is_segmented_but_not_listed(spark):
    rows = one(spark, boxcar(at=0))
    assert D.detect_segments(rows, F.lit(0.2), F.lit(0.2), 6).count() == 1
    found = D.event_table(rows, 10.0)
    assert found.count() == 0 and set(D.METRICS) <= set(found.columns)


def test_stretches_below_count_if_upper_is_below_lower(spark):
    y = [1.0] * 4 + [0.2] * 4 + [1.0] * 4
    found = D.detect_segments(one(spark, y), F.lit(0.1), F.lit(0.5), 4)
    assert sorted(r.start for r in found.collect()) == [0, 4, 8]


def test_nan_is_not_above_and_empty_traces_have_no_events(spark):
    nan = float("nan")
    rows = one(spark, [1.0, nan, 1.0, 1.0, None, 1.0], [])
    found = D.detect_segments(rows, F.lit(0.5), F.lit(0.5), 1).collect()
    assert sorted((r.start, len(r["values"])) for r in found) == [(0, 1), (2, 2), (5, 1)]


def test_missing_baseline_means_no_threshold(spark):
    y = boxcar()
    y[12] = float("nan")
    assert D.thresholds(one(spark, y), 10.0, (1.0, 2.0), 2.0).first().threshold is None
    assert D.event_table(one(spark, y), 10.0).count() == 0


@pytest.mark.parametrize(("values", "want"), [([3.0], 0.0), ([1.0, 3.0], 2.0), ([0.0, 1.0, 4.0], 8 / 3), ([0.0, 1.0, 4.0, 9.0], 9.0), ([5.0] * 10, 45.0), ([float(i) for i in range(11)], 50.0)])
def test_simpson(spark, values, want):
    assert spark.createDataFrame([(values,)], "y array<double>").select(simpson("y")).first()[0] == pytest.approx(want)


def test_median(spark):
    rows = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0, 2.0, 3.0],), ([],), ([1.0, float("nan")],)], "y array<double>")
    assert [r[0] for r in rows.select(median(F.col("y"))).collect()] == [2.0, 2.5, None, None]


def test_baseline_window_is_one_frame_early(spark):
    made = signal.with_baseline(one(spark, [float(i) for i in range(100)]), 10.0)
    assert made.first().f0 == 23.5
    first = signal.with_baseline(one(spark, [float(i) for i in range(100)]), 10.0, (0.0, 1.0))
    assert first.first().f0 is None


def test_baselines_are_smoothed_over_trials(spark):
    made = signal.with_baseline(one(spark, *[[v] * 100 for v in (10.0, 20.0, 60.0)]), 10.0)
    assert sorted(r.f0 for r in made.collect()) == [20.0, 20.0, 20.0]
    assert {round(v, 6) for r in signal.dff(one(spark, [10.0] * 100, [20.0] * 100, [60.0] * 100), 10.0).collect() for v in r.y} == {-0.5, 0.0, 2.0}


def test_lowpass_keeps_slow_and_stops_fast(spark):
    t = np.arange(200)
    slow, fast = np.sin(2 * np.pi * t / 100), np.sin(2 * np.pi * t / 3)
    out = signal.zero_phase(np.stack([slow, fast, np.full(200, 7.0), slow + fast]))
    assert np.abs(out[0] - slow)[20:-20].max() < 0.01
    assert np.abs(out[1])[20:-20].max() < 0.02
    assert np.allclose(out[2], 7.0)
    assert np.allclose(out[3], out[0] + out[1])
    assert np.allclose(signal.zero_phase(slow[None, ::-1])[0], out[0][::-1], atol=5e-3)


def test_lowpass_gain_is_the_squared_butterworth():
    b, a = signal.butterworth(3, 0.2)
    for w in (0.05, 0.2, 0.5):
        z = np.exp(-1j * np.pi * w)
        gain = abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) ** 2
        assert gain == pytest.approx(1 / (1 + (np.tan(np.pi * w / 2) / np.tan(np.pi * 0.1)) ** 6))


def test_lowpass_of_missing_values(spark):
    y = [float(i % 5) for i in range(60)]
    gaps = [*y[:30], float("nan"), *y[30:], float("nan")]
    rows = {r.trial: r.y for r in signal.lowpass(one(spark, y, gaps)).collect()}
    assert np.allclose(rows["0"], rows["1"][:60]) and rows["1"][60:] == [None] * 2
    with pytest.raises(ValueError):
        signal.lowpass(one(spark, y), design="fir")


def quiet(events=(), n=216):
    y = np.random.default_rng(0).normal(0, 0.01, n)
    for a, size, v in events:
        y[a : a + size] = v
    return y.tolist()


def flat_table(spark, trials, column, name="muji_FOV2", roi="66"):
    rows = [(name, roi, str(i), outcome, quiet(events), i) for i, (outcome, events) in enumerate(trials)]
    return spark.createDataFrame(rows, f"id string, roi string, trial string, {column} string, y array<double>, row_ord long")


def regenerated(spark, group, trials, alignment="reward"):
    name = {"task_axons": "traces_task_axons", "NO_DREADDs": "traces_no_dreadds"}[group]
    column = recipes.RECIPES[group][0].outcome
    return recipes.regenerate({name: flat_table(spark, trials, column)}, EventTableParams(), alignment, [group]).collect()


def test_labels_count_from_one_in_one_group_and_from_zero_in_another(spark):
    rows = regenerated(spark, "task_axons", [("cHIT", [(160, 8, 1.0)]), ("nHIT", [])])
    assert len(rows) == 1 and rows[0].ev_onset == pytest.approx(161 / FPS)
    assert (rows[0].k0, rows[0].k1, rows[0].side, rows[0].outcome) == ("muji_FOV2_66.0", None, "target", "cHIT")
    assert regenerated(spark, "NO_DREADDs", [("cHIT", [(160, 8, 1.0)])])[0].ev_onset == pytest.approx(160 / FPS)


def test_windows_sides_and_validation(spark):
    assert regenerated(spark, "task_axons", [("cHIT", [(30, 8, 1.0)])]) == []
    both = regenerated(spark, "task_axons", [("cHIT", [(160, 8, 1.0)]), ("nCATCH", [(160, 8, 1.0)])])
    assert sorted((r.side, r.outcome) for r in both) == [("reference", "nCATCH"), ("target", "cHIT")]
    assert regenerated(spark, "task_axons", [("post-mistake-HIT", [(160, 8, 1.0)]), ("miss", [(160, 8, 1.0)])]) == []
    assert len(regenerated(spark, "task_axons", [("cHIT", [(160, 8, 1.0)]), ("miss", [(61, 31, 50.0)])])) == 1
    assert regenerated(spark, "task_axons", [("cHIT", [(95, 8, 1.0)])], "stimulus")[0].ev_onset == pytest.approx(96 / FPS)


def test_events_run_on_within_a_branch_only(spark):
    tail, head = [(200, 16, 1.0)], [(0, 6, 1.0)]
    merged = regenerated(spark, "NO_DREADDs", [("nCATCH", tail), ("nCATCH", head)])
    assert len(merged) == 1 and merged[0].trial == "0" and merged[0].ev_offset > 216 / FPS
    assert merged[0].ev_duration == pytest.approx(22 / FPS)
    apart = regenerated(spark, "NO_DREADDs", [("nCATCH", tail), ("cHIT", head)])
    assert [r.ev_offset for r in apart if r.side == "reference"] == [pytest.approx(215 / FPS)]


def test_an_event_through_whole_trials(spark):
    rows = spark.createDataFrame([("s", "r", str(i), "FA", y, i) for i, y in enumerate([[0.0, 0.0, 1.0], [1.0, 2.0, 1.0], [1.0, 0.0, 1.0]])], SCHEMA).withColumn("threshold", F.lit(0.5))
    found = D.stacked_events(rows, F.lit("all"), 1.0, 1).orderBy("ev_onset", "trial").collect()
    assert sorted((r.trial, r.ev_onset, r.peak_time, r.ev_offset, r.peak) for r in found) == [("0", 2.0, 4.0, 6.0, 2.0), ("2", 2.0, 2.0, 2.0, 1.0)]


def passive_tables(spark):
    rows = [("two", "FOV1", "ROI7", t, quiet([(160, 8, 1.0)]), t) for t in range(3)]
    traces = spark.createDataFrame(rows, "id string, fov string, roi string, trial int, y array<double>, row_ord long").withColumn("protocol", F.lit("NAIVE STIM REW"))
    behavior = spark.createDataFrame([("two", "FOV1", 0, "cRew"), ("two", "FOV1", 1, "nStim")], "id string, fov string, trial int, history string").withColumn("protocol", F.lit("NAIVE STIM REW"))
    return {"traces_batch3": traces, "behavior_batch3": behavior}


def test_passive_sides_swap_and_unlabelled_trials_have_none(spark):
    params = EventTableParams(stim_window_s=(5.0, 7.0))
    for alignment, want in (("reward", {("target", "cRew"), ("reference", "nStim")}), ("stimulus", {("target", "nStim"), ("reference", "cRew")})):
        found = recipes.regenerate(passive_tables(spark), params, alignment, ["passive_axons"]).collect()
        assert {(r.side, r.outcome) for r in found} == want
        assert {(r.k0, r.k1) for r in found} == {("GCaMP_POm_Batch3_two_FOV1", "ROI7")}
    with pytest.raises(ValueError):
        recipes.regenerate({}, params, "reward")


def test_empty_frames_are_dropped_for_the_unit(spark):
    nan = float("nan")
    rows = one(spark, [1.0, nan, 2.0, nan], [3.0, nan, nan, nan])
    got = {r.trial: r.y for r in D.without_empty_frames(rows).collect()}
    assert got["0"] == [1.0, 2.0] and got["1"][0] == 3.0 and len(got["1"]) == 2


def test_a_stream_of_trials_gives_the_same_events(spark, tmp_path):
    from tracewise.streaming.detect import detect_stream

    rows = one(spark, boxcar(), boxcar(at=70, size=7), boxcar(height=0.0))
    limits = D.thresholds(rows, 10.0, (1.0, 2.0), 2.0)
    want = D.trial_events(rows.join(limits, D.UNIT), 10.0).collect()
    for i in range(3):
        rows.where(F.col("row_ord") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = detect_stream(stream, limits, 10.0).writeStream.outputMode("append").format("memory").queryName("events_found").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("events_found").collect())) == sorted(map(tuple, want)) and len(want) == 2


def plain_segments(y, upper, lower, least):
    """Stretches cut wherever the trace crosses ``lower``, by a loop."""
    out, at = [], 0
    while at < len(y):
        end = at
        while end < len(y) and (y[end] > lower) == (y[at] > lower):
            end += 1
        if sum(v > upper for v in y[at:end]) >= least:
            out.append((at, tuple(y[at:end])))
        at = end
    return out


def test_random_traces_against_a_loop(spark):
    rng = np.random.default_rng(4)
    made = [[float(v) for v in rng.choice([0.0, 1.0, 2.0, float("nan")], rng.integers(1, 30), p=[0.4, 0.3, 0.2, 0.1])] for _ in range(60)]
    rows = one(spark, *made)
    for upper, lower, least in ((0.5, 0.5, 2), (1.5, 0.5, 1), (0.5, 1.5, 1)):
        found = {}
        for r in D.detect_segments(rows, F.lit(upper), F.lit(lower), least).collect():
            found.setdefault(int(r.trial), []).append((r.start, tuple(r["values"])))
        for i, y in enumerate(made):
            assert repr(sorted(found.get(i, []))) == repr(plain_segments(y, upper, lower, least)), (y, upper, lower)


def test_random_stacks_against_one_long_trace(spark):
    rng = np.random.default_rng(5)
    frames, trials = 7, 40
    made = rng.choice([0.0, 1.0, 2.0], (trials, frames), p=[0.5, 0.3, 0.2])
    rows = one(spark, *made.tolist()).withColumn("threshold", F.lit(0.5))
    found = D.stacked_events(rows, F.lit("all"), 1.0, 3).collect()
    want = []
    for start, values in plain_segments(made.ravel().tolist(), 0.5, 0.5, 3):
        trial, place = divmod(start, frames)
        want.append((str(trial), float(place), float(place + len(values) - 1), max(values), float(place + values.index(max(values)))))
    assert sorted((r.trial, r.ev_onset, r.ev_offset, r.peak, r.peak_time) for r in found) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_ragged_stacks_are_one_long_trace(spark, seed):
    rng = np.random.default_rng(seed)
    pieces = [(rng.random(int(n)) < 0.7).astype(float).tolist() for n in rng.integers(0, 9, 12)]
    rows = [("s", "r", str(i), "cHIT", y if i != 5 else None, i) for i, y in enumerate(pieces)]
    held = spark.createDataFrame(rows, SCHEMA).withColumn("threshold", F.lit(0.5))
    found = D.stacked_events(held, F.lit("all"), 1.0, min_samples=3).collect()
    pieces[5] = []
    fronts = np.cumsum([0, *map(len, pieces)])
    line, want, at = np.concatenate(pieces), [], 0
    while at < len(line):
        end = at
        while end < len(line) and line[end] > 0.5:
            end += 1
        if end - at >= 3:
            trial = int(np.searchsorted(fronts, at, side="right")) - 1
            want.append((str(trial), float(at - fronts[trial]), float(end - 1 - fronts[trial]), float(end - at)))
        at = max(end, at + 1)
    assert sorted((r.trial, r.ev_onset, r.ev_offset, r.ev_duration) for r in found) == sorted(want)


def plain_simpson(values):
    n = len(values)
    if n < 3:
        return 0.0 if n == 1 else (values[0] + values[1]) / 2
    odd = n - (n % 2 == 0)
    whole = sum((values[i] + 4 * values[i + 1] + values[i + 2]) / 3 for i in range(0, odd - 2, 2))
    return whole if n % 2 else whole + 5 / 12 * values[-1] + 2 / 3 * values[-2] - values[-3] / 12


def ragged_stacks(seed):
    """Two units of ragged trials, and the events of each as one long trace; many stretches run over trials."""
    rng = np.random.default_rng(seed)
    rows, want = [], []
    for roi in ("r", "q"):
        pieces = [np.where(rng.random(n) < 0.85, rng.uniform(1, 2, n), 0.0).tolist() for n in rng.integers(0, 6, 30).tolist()]
        rows += [("s", roi, str(i), "cHIT", y if i % 11 else None, 100 - 3 * i) for i, y in enumerate(pieces)]
        pieces = [y if i % 11 else [] for i, y in enumerate(pieces)][::-1]
        fronts, line, at = np.cumsum([0, *map(len, pieces)]), sum(pieces, []), 0
        while at < len(line):
            end = at
            while end < len(line) and line[end] > 0.5:
                end += 1
            if end - at >= 2:
                trial = int(np.searchsorted(fronts, at, side="right")) - 1
                held = line[at:end]
                want.append((roi, str(29 - trial), float(at - fronts[trial]), float(at - fronts[trial] + np.argmax(held)), float(end - 1 - fronts[trial]), float(end - at), max(held), round(plain_simpson(held), 9)))
            at = max(end, at + 1)
    return rows, sorted(want)


def told(rows):
    return sorted((r.roi, r.trial, r.ev_onset, r.peak_time, r.ev_offset, r.ev_duration, r.peak, round(r.integral, 9)) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_stacks_cut_anywhere_give_the_same_events(spark, seed):
    from tracewise.operators.prefix import RANGE

    rows, want = ragged_stacks(seed)
    held = spark.createDataFrame(rows, SCHEMA).withColumn("threshold", F.lit(0.5))
    assert told(D.stacked_events(held, F.lit("all"), 1.0, 2).collect()) == want
    rng, keys = np.random.default_rng(seed), [*D.UNIT, "stack"]
    for n in (1, 3, 12, 60):
        cuts = sorted(rng.integers(0, 110, n).tolist())
        number = sum((F.col("row_ord") > c).cast("int") for c in cuts)
        whole = D.merge_ranges(D.run_rows(held, F.lit("all")).withColumn(RANGE, number), keys).where("n >= 2")
        assert told(whole.select("roi", "trial", *D.run_metrics(0, 1.0)).collect()) == want, cuts


def test_endless_values_have_endless_integrals(spark):
    inf = float("inf")
    rows = one(spark, [0.0, 1.0, inf], [1.0, 1.0, 0.0]).withColumn("threshold", F.lit(0.5))
    assert [(r.peak, r.integral, r.ev_duration) for r in D.stacked_events(rows, F.lit("all"), 1.0, 1).collect()] == [(inf, inf, 4.0)]


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", range(2))
def test_a_stream_cut_anywhere_gives_the_events_of_the_stack(spark, two_partitions, seed):
    """Trials come out of order, repeated, in random batches; one that comes beyond the watermark is dropped."""
    from tracewise.streaming.detect import stacked_stream
    from tracewise.streaming.replay import replay

    rows, want = ragged_stacks(seed)
    rng = np.random.default_rng(seed)
    timed = lambda held: spark.createDataFrame(held, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("row_ord") * 10)).coalesce(1)
    rows = sorted(rows, key=lambda r: r[5] + rng.uniform(0, 20))
    cuts = [0, *sorted(rng.integers(1, 60, 2).tolist()), 60]
    slices = [timed(rows[max(0, a - 3) : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    # Beyond the idle time, so that stacks are closed; then a late trial, and the first of a new stack of the unit.
    slices += [timed([("s", "none", "x", "FA", None, 10**5)])] * 2 + [timed([("s", "r", "late", "cHIT", [1.0] * 9, 50)]), timed([("s", "r", "new", "cHIT", [1.0] * 4, 10**6)]), timed([("s", "none", "y", "FA", None, 10**7)])]
    limits = spark.createDataFrame([("s", "r", 0.5), ("s", "q", 0.5)], "session string, roi string, threshold double")
    found = replay(spark, slices, lambda x: stacked_stream(x, limits, "ts", "flattened", 1.0, late="10 minutes", idle="1 day", min_samples=2), files_a_batch=1).collect()
    assert told(found) == sorted([*want, ("r", "new", 0.0, 0.0, 3.0, 4.0, 1.0, 3.0)])


def test_stretches_merge_in_any_grouping():
    from tracewise.streaming.detect import joined

    nan, rng = float("nan"), np.random.default_rng(0)
    for _ in range(50):
        values, parts, at = rng.integers(1, 4, 12).astype(float).tolist(), [], 0
        while at < 12:
            own = values[at : at + int(rng.integers(1, 5))]
            tail = own[-3:]
            sums = [sum(v for i, v in enumerate(own, at) if i % 2 == r) for r in (0, 1)]
            parts.append([at, len(own), max(own), at + own.index(max(own)), *sums, own[0], *[nan] * (3 - len(tail)), *tail])
            at += len(own)
        whole = [0, 12, max(values), values.index(max(values)), sum(values[::2]), sum(values[1::2]), values[0], *values[-3:]]
        while len(parts) > 1:
            i = int(rng.integers(0, len(parts) - 1))
            parts[i : i + 2] = [joined(parts[i], parts[i + 1])]
        assert parts[0] == whole


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_traces_in_buckets_stay_where_they_are(spark, adaptive):
    """No exchange of traces in the plans of baselines and detection over a bucketed table; the same values as without."""
    from tracewise.sources.tables import write_bucketed

    rng = np.random.default_rng(6)
    made = [("s", f"r{i % 5}", str(i), "cHIT", (5 + rng.normal(0, 1, 40)).tolist(), i) for i in range(60)]
    plain = spark.createDataFrame(made, SCHEMA)
    table = write_bucketed(plain, f"bucketed_{adaptive}", 4)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = signal.dff(table, 10.0, in_place=True)
        far = signal.dff(plain, 10.0)
        assert sorted((r.trial, tuple(r.y)) for r in near.collect()) == sorted((r.trial, tuple(r.y)) for r in far.collect())
        found, want = (D.detect(x, "per_trial", 10.0, sd=0.5, min_samples=2) for x in (table, plain))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
        for df, moved in ((near, False), (found, False), (far, True)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert ("Exchange" in plan) == moved, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql(f"DROP TABLE bucketed_{adaptive}")


@pytest.mark.parametrize("size", [13, 40, 1000])
def test_lowpass_in_blocks_is_that_of_the_whole_trace(spark, size):
    rng = np.random.default_rng(8)
    whole = {k: np.cumsum(rng.normal(0, 1, n)) for k, n in (("a", 400), ("b", 401), ("c", 13), ("d", 3 * size + 1))}
    rows = [(k, i // size, y[i : i + size].tolist()) for k, y in whole.items() for i in range(0, len(y), size)]
    df = spark.createDataFrame(rows, "k string, block long, y array<double>").repartition(3)
    got: dict[str, list] = {}
    for r in signal.lowpass_blocks(df, ["k"]).orderBy("k", "block").collect():
        got.setdefault(r.k, []).extend(r.y)
    for k, y in whole.items():
        assert np.allclose(got[k], signal.zero_phase(y[None, :])[0], rtol=0, atol=1e-9)
    for bad in ([("a", 0, [1.0] * 5)], [("a", 0, [1.0] * 20 + [float("nan")])], [("a", 0, [1.0] * 9), ("a", 1, [1.0] * 30)]):
        with pytest.raises(SparkRuntimeException):
            signal.lowpass_blocks(spark.createDataFrame(bad, df.schema), ["k"]).collect()


@pytest.mark.parametrize("block", [1, 7, 25, 1000])
def test_baselines_by_blocks_are_those_of_the_whole_unit(spark, block):
    rng = np.random.default_rng(9)
    # Some trials have no baseline: a value of theirs is missing.
    made = [("s", roi, str(i), "cHIT", [float("nan") if v < 0.1 else float(v) for v in rng.random(3)] * 10, 7 * i) for roi, n in (("r", 60), ("q", 3), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(made, SCHEMA)
    want, got = (sorted((r.roi, r.trial, r.f0) for r in signal.with_baseline(df, 10.0, (1.0, 2.0), block=b).collect()) for b in (None, block))
    assert got == want and len(want) == 64 and any(f is not None for *_, f in want)
