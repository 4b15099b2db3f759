"""Files by ranges: CSV files with headers of their own in one scan, and checksums as trees."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewise.sources import event_files, files, keyed_csv

SUFFIX = "_all_2s_reward_events"


def load(spark, folder, **options):
    spark.dataSource.register(keyed_csv.KeyedCsv)
    reader = spark.read.format("keyed_csv")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(str(folder))


def test_rows_are_the_same_by_ranges_of_any_size(spark, tmp_path):
    rng = random.Random(5)
    lines = [f'{i},"é{"x" * rng.randrange(40)}, {i}",{rng.random()}' for i in range(400)]
    (tmp_path / "a.csv").write_bytes(("﻿n,word,value\r\n" + "\r\n".join(lines)).encode())
    (tmp_path / "b.csv").write_text("n,value\n\n7,1.5\n8\n9,2,3\n")
    (tmp_path / "c.csv").write_text("n,value\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("n\n1\n")
    whole = load(spark, tmp_path).orderBy("row_ord").collect()
    assert [r.keys for r in whole] == [[str(i)] for i in range(400)] + [["7"], ["8"], ["9"]]
    assert whole[3].fields["word"].startswith("é") and whole[3].fields["word"].endswith(", 3")
    assert [r.fields for r in whole[400:]] == [{"value": "1.5"}, {}, {"value": "2"}]
    assert load(spark, tmp_path, bytes=3000, opening=0).orderBy("row_ord").collect() == whole
    found = files.listed(str(tmp_path / "a.csv").rsplit("/", 1)[0], "a.csv")[0]
    cut = lambda n: [keyed_csv.Piece(found.path, found.name, 0, at, min(at + n, found.size)) for at in range(0, found.size, n)]
    rows = list(keyed_csv.rows_of(cut(found.size)[0]))
    assert len(rows) == 400
    for size in (1, 7, 64):
        assert [r for piece in cut(size) for r in keyed_csv.rows_of(piece)] == rows


def test_many_small_files_of_mixed_layouts_are_one_scan_of_few_tasks(spark, tmp_path):
    for i in range(3000):
        if i % 3 == 0:
            text = f",peak,ROI,outcome,trial\n0,{i},m_{i}.0,cHIT,{i}\n"
        elif i % 3 == 1:
            text = f",,history,trial,peak,ROI\ns{i},0,cRew,{i},{i},R{i}\n"
        else:
            text = f",,ROI,outcome,trial,peak\nm{i},0,{i}.0,nHIT,{i},none\n"
        stem = "task_axons" if i == 0 else "NO_DREADDs" if i == 3 else f"g{i:04d}_MODIFIED_" + ("task_axons", "passive_axons", "task_dendrites_TD0")[i % 3]
        (tmp_path / f"{stem}{SUFFIX}.csv").write_text(text)
    found = event_files.read_event_folder(spark, str(tmp_path), SUFFIX)
    assert found.rdd.getNumPartitions() < 100
    assert found._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    rows = {int(r.trial): r for r in found.collect()}
    assert len(rows) == 3000
    for i, r in rows.items():
        want = [(f"m_{i}.0", None, "cHIT", None, float(i)), (f"s{i}", f"R{i}", None, "cRew", float(i)), (f"m{i}", f"{i}.0", "nHIT", None, None)][i % 3]
        assert (r.k0, r.k1, r.outcome, r.history, r.peak) == want
    # The order of files by name, whatever the case.
    stems = [r.stem for r in sorted(rows.values(), key=lambda r: r.row_ord)]
    assert stems == sorted(stems, key=lambda s: f"{s}{SUFFIX}.csv".lower())


def test_event_file_without_key_is_an_error(spark, tmp_path):
    (tmp_path / f"task_axons{SUFFIX}.csv").write_text(",trial\n0,1\n")
    with pytest.raises(Exception, match="no column ROI in task_axons"):
        event_files.read_event_folder(spark, str(tmp_path), SUFFIX).collect()


def test_frequency_files_with_columns_of_their_own(spark, tmp_path):
    (tmp_path / "TD0_COHORT_x.csv").write_text(",,cHIT,nHIT\nm,57.0,0.5,1\nm,58.0,,bad\n")
    (tmp_path / "TD1_COHORT_x.csv").write_text("id,ROI,FA,cHIT\nm,57.0,0.25,2\n")
    rows = event_files.read_frequencies(spark, str(tmp_path), "*_x.csv").orderBy("stem", "k1")
    assert rows.columns == ["stem", "k0", "k1", "FA", "cHIT", "nHIT"]
    assert [tuple(r)[2:] for r in rows.collect()] == [("57.0", None, 0.5, 1.0), ("58.0", None, None, None), ("57.0", 0.25, 2.0, None)]
    with pytest.raises(FileNotFoundError):
        event_files.read_frequencies(spark, str(tmp_path), "*_y.csv")


def tree(content: bytes, leaf: int) -> str:
    level = [hashlib.sha256(content[i : i + leaf]).hexdigest() for i in range(0, max(len(content), 1), leaf)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 256]).encode()).hexdigest() for i in range(0, len(level), 256)]
    return level[0]


def test_checksums_are_trees_whatever_the_ranges(spark, tmp_path):
    rng = random.Random(6)
    sizes = {"empty": 0, "one": 1, "leaf": 16, "more": 17, "node": 16 * 256, "two": 16 * 257 + 3, "sub/two": 16 * 256 + 1, "three": 16 * 256 * 3}
    (tmp_path / "sub").mkdir()
    contents = {n: rng.randbytes(s) for n, s in sizes.items()}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = {n: tree(c, 16) for n, c in contents.items()}
    assert want["leaf"] == hashlib.sha256(contents["leaf"]).hexdigest()
    found = files.listed(str(tmp_path), recursive=True)
    for task in (2000, 1 << 20):
        assert {r.name: r.sha256 for r in files.tree_checksums(spark, found, leaf=16, task=task).collect()} == want
    shorter = [f._replace(size=f.size + 5) for f in found if f.name == "two"]
    with pytest.raises(Exception, match="shorter than it was"):
        files.tree_checksums(spark, shorter, leaf=16).collect()


def test_checksum_of_a_file_beyond_one_value(spark, tmp_path):
    """3 GB: more than a binary value holds. The file is sparse, so it takes no room; its leaves are all the same but the last."""
    size = 3 << 30
    with open(tmp_path / "large", "wb") as file:
        file.truncate(size - 1)
        file.seek(size - 1)
        file.write(b"x")
    leaf = hashlib.sha256(bytes(files.LEAF)).hexdigest()
    last = hashlib.sha256(bytes(files.LEAF - 1) + b"x").hexdigest()
    level = [leaf] * (size // files.LEAF - 1) + [last]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 256]).encode()).hexdigest() for i in range(0, len(level), 256)]
    assert files.tree_checksums(spark, files.listed(str(tmp_path))).select(F.col("sha256")).first()[0] == level[0]
