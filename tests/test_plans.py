"""Specs, manifests, sources, the store, and a whole analysis on made-up recordings."""

from __future__ import annotations

import json

import pytest
import yaml
from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.plans import cohort, published, session, specs, store
from tracewise.sources import event_files, nested
from tracewise.sources import tables as T

EPOCH = {"name": "early", "default_window": [5.1, 6.1], "per_protocol": {"NO_DREADDs": [5.0, 5.8]}}
COMPARISON = {"name": "c", "a": ["p", "cHIT"], "b": ["p", "nHIT"], "metric": "rate", "epoch": "early", "test": "mannwhitney"}
CONFIG = {"run_id": "x", "alignment": "reward", "epochs": [EPOCH], "modulation": {"epoch": "early"}, "comparisons": [COMPARISON]}


def test_a_config_is_read():
    c = specs.CohortConfig.read(CONFIG)
    assert c.epoch("early").window_for("NO_DREADDs") == (5.0, 5.8) and c.epoch("early").window_for("x") == (5.1, 6.1)
    assert c.comparisons[0].a == ("p", "cHIT") and c.histogram.nbins == 15
    with pytest.raises(KeyError):
        c.epoch("late")


@pytest.mark.parametrize(
    "change",
    [
        {"run_id": ""}, {"alignment": "lick"}, {"strange": 1}, {"epochs": [EPOCH, EPOCH]}, {"event_source": "regenerated"}, {"regenerated_groups": ["g"]},
        {"epochs": [EPOCH | {"default_window": [6, 5]}]}, {"epochs": [EPOCH | {"default_window": [1]}]}, {"modulation": {"epoch": "late"}},
        {"modulation": {"epoch": "early", "threshold": "mode"}}, {"comparisons": [COMPARISON | {"epoch": "late"}]}, {"comparisons": [COMPARISON | {"a": ["p"]}]},
        {"comparisons": [COMPARISON | {"test": "anova"}]}, {"comparisons": [COMPARISON | {"metric": "size"}]}, {"histogram": {"bins": 3}}, {"event_tables": {"stim_window_s": 3}},
    ],
)
def test_what_can_not_be_right_is_refused(change):
    with pytest.raises(specs.SpecError):
        specs.CohortConfig.read(CONFIG | change)


def test_manifests_inherit(tmp_path):
    base, derived = tmp_path / "base.yaml", tmp_path / "derived.yaml"
    base.write_text(yaml.safe_dump({"defaults": {"alignment": "reward", "notes": "n"}, "states": [{"run_id": "a"}, {"run_id": "b"}]}))
    derived.write_text(yaml.safe_dump({"base": "base.yaml", "run_id_suffix": "-m", "defaults": {"notes": "other"}}))
    assert [(c.run_id, c.notes) for c in specs.load_manifest(derived)] == [("a-m", "other"), ("b-m", "other")]
    for bad in ({"base": "base.yaml"}, {"base": "base.yaml", "run_id_suffix": "-m", "states": []}, {"states": []}, {"states": [3]}, {"states": [{"run_id": "a", "alignment": "reward"}] * 2}):
        derived.write_text(yaml.safe_dump(bad))
        with pytest.raises(specs.SpecError):
            specs.load_manifest(derived)
    derived.write_text(yaml.safe_dump({"base": "derived.yaml", "run_id_suffix": "-m"}))
    with pytest.raises(specs.SpecError, match="circle"):
        specs.load_manifest(derived)
    derived.write_text("- 1")
    with pytest.raises(specs.SpecError):
        specs.load_config(derived)


def test_published_states():
    states = published.published()
    assert [len(s.comparisons) for s in states] == [4, 4, 5, 24, 8, 9, 3]
    labels = [f"{'n ' if c.normalize else ''}{c.name} {c.epoch} {c.metric}" for s in states for c in s.comparisons]
    assert len(set(labels)) == 57
    assert all(s.event_source == "regenerated" and s.run_id.endswith("-passive-methods") for s in published.passive_methods())


def test_sessions(tmp_path, monkeypatch):
    s = session.SessionConfig.read({"subject": "a", "study": "b", "session": "c", "fps": 30.54, "baseline_window_s": [1, 2.99]})
    assert (s.run_id, s.baseline_samples, str(s.relative_path)) == ("a_c", (30, 91), "b/a/c")
    for bad in ({"fps": 0}, {"baseline_window_s": [2, 1]}, {"channels": []}, {"colour": 1}):
        with pytest.raises(session.SessionError):
            session.SessionConfig.read({"subject": "a", "study": "b", "session": "c"} | bad)
    saved = tmp_path / "paths.yaml"
    for name in ("DATA_ROOT", "DERIVATIVES_ROOT"):
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(session.DataRootMissing):
        session.data_root(saved=saved)
    (tmp_path / "env").write_text("# paths\nexport DATA_ROOT='/dotenv'\nOTHER = 1\n")
    saved.write_text("data_root: /saved")
    assert session.data_root(saved=saved, env_file=tmp_path / "env") == "/dotenv" and session.dotenv(tmp_path / "env")["OTHER"] == "1"
    assert session.data_root(saved=saved) == "/saved" and session.derivatives_root(saved=saved) == "/saved/derivatives"
    monkeypatch.setenv("DATA_ROOT", "/env")
    assert session.data_root(saved=saved) == "/env" and session.data_root("/given") == "/given"


def numbers(n: int) -> DataFrame:
    return SparkSession.getActiveSession().range(n)


def doubled(df: DataFrame, by: int = 2) -> DataFrame:
    return df.select((F.col("id") * by).alias("id"))


def test_store_writes_once_and_keys_hold_parameters(spark, tmp_path):
    held = store.Store(spark, str(tmp_path))
    key, made = held.get_or_compute("n", numbers, parameters={"n": 5})
    assert made.count() == 5 and held.record(key).representation == store.STORED
    again, _ = held.get_or_compute("n", numbers, parameters={"n": 5})
    other, _ = held.get_or_compute("n", numbers, parameters={"n": 6})
    assert again == key and other != key
    twice, rows = held.get_or_compute("d", doubled, [key], {"by": 3})
    assert sorted(r.id for r in rows.collect()) == [0, 3, 6, 9, 12]
    assert [r.key for r in held.lineage(twice)] == [key, twice]
    with pytest.raises(store.StoreError):
        held.resolve("nothing")


def test_artifacts_are_made_again_from_the_command_line(spark, tmp_path, monkeypatch):
    from tracewise import __main__ as cli

    monkeypatch.setenv("DERIVATIVES_ROOT", str(tmp_path))
    held = store.Store.from_env(spark)
    assert held.root == f"{tmp_path}/store" and not held.exists("n")
    key, _ = held.get_or_compute("n", numbers, parameters={"n": 7})
    assert held.exists(key) and held.folder(key) == f"{held.root}/{key}"
    command = held.record(key).replay_command(held.root, f"{tmp_path}/again").split()
    assert command[:4] == ["python", "-m", "tracewise", "replay"] and cli.main(command[3:]) == 0
    assert spark.read.parquet(f"{tmp_path}/again/{key}").count() == 7


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace as Fake

    from tracewise.plans.lineage import checkpointed

    context = Fake(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match=r"spark.checkpoint.dir"):
        checkpointed(Fake(sparkSession=Fake(sparkContext=context, conf={})))


def test_recipes_are_replayed(spark, tmp_path):
    held = store.Store(spark, str(tmp_path), store.Policy(never=frozenset({"data"})))
    key, _ = held.get_or_compute("n", numbers, parameters={"n": 4})
    twice, _ = held.get_or_compute("d", doubled, [key])
    assert held.record(twice).representation == store.RECIPE
    assert sorted(r.id for r in held.resolve(twice).collect()) == [0, 2, 4, 6]
    with pytest.raises(store.StoreError):
        held.get_or_compute("x", lambda: None)


@pytest.mark.parametrize(("slow", "large", "want"), [(True, True, store.STORED), (False, True, store.RECIPE), (False, False, store.STORED), (True, False, store.STORED)])
def test_what_took_long_is_stored_however_large(spark, tmp_path, slow, large, want):
    held = store.Store(spark, str(tmp_path), store.Policy(compute_seconds=0.0 if slow else 1e6, size_bytes=1 if large else 1 << 40))
    key, made = held.get_or_compute("n", numbers, parameters={"n": 1000})
    record = held.record(key)
    assert record.representation == want and record.compute_seconds > 0 and record.size_bytes > 1
    assert made.count() == 1000 and spark.read.parquet(f"{tmp_path}/{key}/data").count() == (1000 if want == store.STORED else 0)


@pytest.mark.parametrize(
    ("seconds", "size", "kind", "want"),
    [
        (1, 1, "figure", "kind_always_materialized"), (None, None, "data", "expensive_to_recompute"), (60, 9 << 40, "data", "expensive_to_recompute"),
        (1, 2 << 30, "data", "storage_heavy_cheap_compute"), (1, 1, "data", "cheap_and_small"), (99, 1, "cache", "kind_never_materialized"), (1, None, "data", "cheap_and_small"),
    ],
)
def test_policy(seconds, size, kind, want):
    assert store.Policy(never=frozenset({"cache"})).decide(seconds, size, kind)[1] == want


def test_policies_are_read():
    p = store.Policy.read({"compute_seconds_threshold": 5, "size_gib_threshold": 0.5, "always_materialize_kinds": ["a"], "never_materialize_kinds": ["b"]})
    assert (p.compute_seconds, p.size_bytes, p.always, p.never) == (5.0, 1 << 29, frozenset("a"), frozenset("b"))


def test_wide_traces_become_arrays(spark, tmp_path):
    wide = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 7)], "id string, f000 double, f001 double, f1000 double, row_ord long")
    made = T.as_arrays(wide).first()
    assert made.y == [1.0, 2.0, 3.0] and made.row_ord == 7
    with pytest.raises(ValueError):
        T.as_arrays(wide.drop("row_ord"))
    with pytest.raises(T.ConvertedDataMissing):
        T.read_table(spark, str(tmp_path), "traces_batch1")


def test_event_files(spark, tmp_path):
    (tmp_path / "task_axons_all_2s_reward_events.csv").write_text(",ROI,outcome,trial,peak,ev_onset,peak_time,ev_offset,ev_duration,integral\n0,muji_FOV2_57.0,cHIT,3,1.5,5.2,5.3,5.4,0.2,\n")
    (tmp_path / "passive_axons_all_2s_reward_events.csv").write_text(",,stimtype,outcome,history,trial,peak,ev_onset,ROI\ns1,0,x,y,cRew,1,2.0,5.3,57.0\n")
    (tmp_path / "MODIFIED_task_dendrites_TD3_all_2s_reward_events.csv").write_text(",,outcome,trial,peak,ev_onset,ROI\nmuji,0,cHIT,4,2.5,5.5,42.0_TD3\n")
    rows = {r.stem: r for r in event_files.read_event_folder(spark, str(tmp_path), "_all_2s_reward_events").collect()}
    assert (rows["task_axons"].k0, rows["task_axons"].k1, rows["task_axons"].integral) == ("muji_FOV2_57.0", None, None)
    assert (rows["passive_axons"].k0, rows["passive_axons"].k1, rows["passive_axons"].history) == ("s1", "57.0", "cRew")
    assert (rows["MODIFIED_task_dendrites_TD3"].k0, rows["MODIFIED_task_dendrites_TD3"].k1) == ("muji", "42.0_TD3")
    (tmp_path / "TD0_COHORT_fullreward_event_frequencies.csv").write_text(",,cHIT\nmuji,57.0,0.5\n")
    got = event_files.read_frequencies(spark, str(tmp_path), event_files.FREQUENCY_GLOBS["reward"]).first()
    assert (got.stem, got.k0, got.k1, got.cHIT) == ("TD0_COHORT_fullreward_event_frequencies", "muji", "57.0", 0.5)
    with pytest.raises(FileNotFoundError):
        event_files.read_event_folder(spark, str(tmp_path), "_none")


def quiet(at=None):
    y = [0.01 * (-1) ** i for i in range(216)]
    if at:
        y[at : at + 8] = [1.0] * 8
    return y


def write_sources(folder):
    """Nested sources with three sessions of flat recordings, passive batches and dendrite behaviour."""

    def put(name, rows):
        (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))

    def trials(kinds, label):
        return [{"trial": str(i), "labels": {label: k}, "y": quiet(160 + i % 3)} for i, k in enumerate(kinds)]

    kinds = ["cHIT", "nHIT", "cHIT", "nHIT", "FA", "nCATCH"]
    for name, label, ids in (("task_axons", "unvalidated_type", ("a_FOV1", "b_FOV2")), ("no_dreadds", "trial_type", ("one_FOV1",))):
        rows = []
        for p, i in enumerate(ids):
            units = lambda n: [{"roi": r, "trials": trials(kinds, label)[:n]} for r in ("1", "2", "3")]  # noqa: E731, B023
            branches = [("ALL", 6), ("HIT", 4), ("cHIT", 2), ("nHIT", 2), ("FA", 1), ("CATCH", 1), (None, 3)]
            rows.append({"position": p, "id": i, "branches": [{"ttype": t, "rois": units(n)} for t, n in branches]})
        put(name, rows)
    histories = ["cRew", "nRew", "cStim", "nStim"]
    group = lambda name, rois: {
        "name": name,
        "behavior": [{"trial": t, "row": t, "fields": {"history": h, "Rew lick latency": "0.3" if t else "none"}} for t, h in enumerate(histories)],
        "rois": [{"roi": r, "trials": [{"trial": t, "y": quiet(158 + t)} for t in range(4)]} for r in rois],
    }
    put("batch1", [{"position": 0, "id": "two", "protocols": [{"protocol": "NAIVE STIM REW", "groups": [group("AXONS", ["R1", "R2"]), group("DENDRITES", ["R3"])]}]}])
    put("batch3", [{"position": 0, "id": "six", "protocols": [{"protocol": "NAIVE STIM REW", "groups": [group("FOV1", ["R4", "R5", "R6"])]}]}])
    for name, days in (("task_dendrites", ("TD0", "TD2")), ("control_dendrites", ("TD1", "TD2"))):
        rows = [{"trial type": t, "response latency": "0.1"} for t in kinds]
        put(f"{name}_behavior", [{"position": p, "td": d, "mice": [{"mouse": "MUJI", "rows": rows}]} for p, d in enumerate(days)])


def write_event_files(folder):
    def put(stem, suffix, header, rows):
        (folder / f"{stem}{suffix}.csv").write_text("\n".join([header, *[",".join(map(str, r)) for r in rows]]) + "\n")

    metrics = "peak,ev_onset,peak_time,ev_offset,ev_duration,integral"
    values = lambda i: (1 + i / 7, 5.2 + i / 20, 5.3 + i / 20, 5.4 + i / 20, 0.2, 1.5)
    for suffix, outcomes in (("_all_2s_reward_events", ("cHIT", "nHIT")), ("_all_2s_noreward_events", ("FA", "nCATCH"))):
        rows = [(n, f"{s}_{r}.0", o, n, *values(n % 9)) for n, (s, r, o) in enumerate((s, r, o) for s in ("a_FOV1", "b_FOV2") for r in (1, 2, 3) for o in outcomes for _ in range(1 if "noreward" in suffix else r))]
        put("task_axons", suffix, f",ROI,outcome,trial,{metrics}", rows)
        put("NO_DREADDs", suffix, f",ROI,outcome,trial,{metrics}", [(n, f"one_FOV1_{1 + n % 3}.0", outcomes[n % 2], n, *values(n)) for n in range(6)])
        put("task_dendrites_TD0", suffix, f",,outcome,trial,{metrics},ROI", [("muji", n, outcomes[n % 2], n, *values(n), f"{57 + n % 3}.0") for n in range(6)])
        passive = ("cRew", "nRew") if "noreward" not in suffix else ("cStim", "nStim")
        put("passive_axons", suffix, f",,stimtype,outcome,history,trial,{metrics},ROI", [("GCaMP_POm_Batch3_six_FOV1", n, "x", "y", passive[n % 2], n % 4, *values(n), f"R{4 + n % 3}") for n in range(6 if "noreward" in suffix else 7)])
    (folder / "TD0_COHORT_fullreward_event_frequencies.csv").write_text(",,cHIT\nmuji,57.0,0.5\nmuji,58.0,0.5\nmuji,59.0,0.5\n")


@pytest.fixture(scope="module")
def converted(spark, tmp_path_factory):
    source, dest = tmp_path_factory.mktemp("nested"), str(tmp_path_factory.mktemp("converted"))
    write_sources(source)
    paths = nested.convert_all(spark, str(source), dest)
    assert sorted(paths) == sorted(T.CONVERTED)
    return dest


def test_conversion(spark, converted):
    manifest = T.read_manifest(spark, converted)
    assert manifest["row_counts"]["traces_task_axons"] == 2 * 3 * 6 and manifest["row_counts"]["trials_task_axons"] == 2 * 6
    assert len(manifest["sha256"]) == 6 and all(len(v) == 64 for v in manifest["sha256"].values())
    held = T.read_converted(spark, converted)
    rows = held["traces_task_axons"].orderBy("row_ord").collect()
    assert [(r.id, r.roi, r.trial) for r in rows[:7]] == [("a_FOV1", "1", str(t)) for t in range(6)] + [("a_FOV1", "2", "0")]
    assert rows[0].unvalidated_type == "cHIT" and len(rows[0].y) == 216
    counts = {(r.id, r.ttype): r.n_trials for r in held["trials_task_axons"].collect()}
    assert counts["a_FOV1", "HIT"] == 4 and counts["b_FOV2", "ALL"] == 6
    behavior = held["behavior_batch1"].where("compartment = 'AXONS'").orderBy("trial").collect()
    assert [r["Rew lick latency"] for r in behavior] == ["none", "0.3", "0.3", "0.3"] and behavior[0].history == "cRew"
    assert held["behavior_task_dendrites"].where("td = 'TD0'").count() == 6
    order = held["traces_batch1"].select("compartment", "source_order").distinct().orderBy("source_order").collect()
    assert [r.compartment for r in order] == ["AXONS", "DENDRITES"]


def test_pickled_content_is_refused(spark, tmp_path):
    (tmp_path / "task_axons.json").write_bytes(b"\x80\x04\x95 pickled")
    with pytest.raises(Exception, match="(?i)malformed"):
        nested.read_nested(spark, str(tmp_path), "task_axons", nested.FLAT).collect()


def config(**more):
    pairs = [("task_axons", "cHIT", "nHIT"), ("passive_axons", "cRew", "nRew")]
    comparisons = [COMPARISON | {"name": f"{p} {m}", "a": [p, a], "b": [p, b], "metric": m, "roi_set": r} for p, a, b in pairs for m, r in (("rate", "active"), ("ev_onset", "modulated"), ("rate", "all"))]
    comparisons = [c | {"name": f"{c['name']} {c['roi_set']}"} for c in comparisons]
    comparisons.append(COMPARISON | {"name": "norm", "a": ["passive_axons", "cRew"], "b": ["task_axons", "cHIT"], "normalize": {"a_reference": ["passive_axons", "nRew"], "b_reference": ["task_axons", "nHIT"]}, "test": "student_t"})
    return specs.CohortConfig.read(CONFIG | {"epochs": [EPOCH | {"default_window": [5.1, 6.1], "per_protocol": {}}], "comparisons": comparisons} | more)


def test_a_whole_analysis(spark, converted, tmp_path):
    write_event_files(tmp_path)
    tables = T.read_converted(spark, converted)
    c = config()
    inputs = cohort.read_inputs(spark, c, str(tmp_path), tables)
    out = cohort.run_onset_analysis(c, inputs)
    totals = {r.protocol: (r.n_target, r.n_reference) for r in out.totals.collect()}
    assert totals["task_axons"] == (8, 4) and totals["passive_axons"] == (4, 4) and totals["task_dendrites (pre-CNO)"] == (4, 2)
    shares = {r.protocol: r for r in out.proportions.collect()}
    assert shares["task_axons"].n_total == 6 and 0 < shares["task_axons"].n_modulated < 6
    results = {r.name: r for r in out.results.collect()}
    assert len(results) == 7
    r = results["task_axons rate active early rate"]
    assert (r.n_a, r.n_b) == (6, 6) and 0 <= r.p_value <= 1 and r.sentence.startswith("6 ROIs vs. 6")
    assert any(n.startswith(cohort.PREFIX) for n in results)
    assert out.histogram.where("protocol = 'task_axons'").count() > 0
    points, line = cohort.run_latency_correlation(c, inputs, window=(5.0, 6.5))
    assert line.first().n_trials + line.first().n_no_lick >= 1 and points.columns
    with pytest.raises(KeyError):
        cohort.run_latency_correlation(c, inputs, group="passive_dendrites")
    both = cohort.run_manifest((c, specs.CohortConfig.read({**CONFIG, "run_id": "empty", "comparisons": []})), {"reward": inputs})
    assert {r.state for r in both.select("state").distinct().collect()} == {"x"}


def test_groups_found_again_replace_files(spark, converted, tmp_path):
    write_event_files(tmp_path)
    tables = T.read_converted(spark, converted)
    c = config(event_source="regenerated", regenerated_groups=["passive_axons", "passive_dendrites"])
    inputs = cohort.read_inputs(spark, c, str(tmp_path), tables)
    all_ = cohort.pooled(c, inputs).where("stem like 'passive%'").collect()
    rows = [r for r in all_ if r.stem == "passive_axons"]
    assert {r.k0 for r in rows} == {"GCaMP_POm_Batch3_six_FOV1", "RGECO_GCaMP_Batch1_two"}
    assert {(r.side, r.history) for r in rows} == {("target", "cRew"), ("target", "nRew"), ("reference", "cStim"), ("reference", "nStim")}
    assert len(rows) == len(all_), "a group without a file stays out"
    with pytest.raises(ValueError):
        cohort.pooled(config(event_source="regenerated", regenerated_groups=["unknown"]), inputs)


def test_command_line(spark, converted, tmp_path, capsys):
    from tracewise import __main__ as cli

    write_event_files(tmp_path)
    assert cli.main(["validate", "--source", str(tmp_path), "--converted", converted]) == 0
    assert "task_axons/target" in capsys.readouterr().out
    assert cli.main(["validate", "--source", str(tmp_path), "--converted", converted, "--floor", "1.0"]) == 1
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(CONFIG | {"comparisons": []}))
    assert cli.main(["onset", "--config", str(path), "--source", str(tmp_path), "--converted", converted, "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out/x/totals")).count() >= 4
    with pytest.raises(SystemExit):
        cli.main(["latency", "--manifest", "v10", "--state", "v10", "--source", str(tmp_path), "--converted", converted, "--out", str(tmp_path)])


def test_session_stages(spark):
    from tracewise.plans.stages import session_pipeline

    y = [100 + 2 * (i % 11 - 5) / 5 for i in range(216)]
    y[150:180] = [300.0] * 30
    rows = spark.createDataFrame([("s", "r", i, y, i) for i in range(3)], "session string, roi string, trial int, y array<double>, row_ord long")
    config = session.SessionConfig("a", "b", "c", fps=30.0, baseline_window_s=(2.0, 3.0))
    made = session_pipeline(config)
    assert len(made) == 3 and list(made.results(rows)) == ["filter", "dff", "events"]
    found = [r for r in made(rows).collect() if r.peak > 1]
    assert len(found) == 3 and all(abs(r.ev_onset - 5.0) < 0.3 and 1.5 < r.peak < 2.6 for r in found)


def test_many_trials_of_a_unit_keep_their_order(spark):
    trials = [(i, [float(i)]) for i in range(5000, 0, -1)]
    rows = [(0, "m", [("NAIVE STIM REW", [("AXONS", [], [("a", trials), ("b", trials[:3])])])])]
    traces, _ = nested.flatten_series(spark.createDataFrame(rows, nested.SERIES), "batch1")
    got = traces.orderBy("row_ord").select("roi", "trial").collect()
    assert [tuple(r) for r in got] == [("a", t) for t, _ in trials] + [("b", t) for t, _ in trials[:3]]
    assert traces.select("row_ord").distinct().count() == 5003
    with pytest.raises(SparkRuntimeException, match="places"):
        nested.flatten_series(spark.createDataFrame([(1 << 15, "m", [("P", [("AXONS", [], [("a", trials[:1])])])])], nested.SERIES), "batch1")[0].collect()
