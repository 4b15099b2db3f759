"""Exact, line and near dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewise.llm import exact_dedup, line_dedup, simhash
from tracewise.llm.components import components

from .conftest import awkward_rows, words

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    out = []
    for r in rows:
        text = SPACE.sub(" ", r[1] or "")
        ids = [i for i in groups[text] if i is not None]
        keep = min(ids) if ids else None
        out.append((r[0], keep, len(groups[text]), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [10**6, 0])
def test_exact_is_brute_force_on_both_sides_of_the_broadcast_bound(docs, bound, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", bound)
    found = exact_dedup.mark(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(found) == brute_exact(awkward_rows())


@pytest.mark.parametrize("bound", [10**6, 0])
def test_exact_keeps_rows_and_columns(clashing, empty, bound, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", bound)
    kept = exact_dedup.keep_first(clashing)
    assert kept.columns == clashing.columns
    texts = [SPACE.sub(" ", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({SPACE.sub(" ", r[1] or "") for r in awkward_rows()})
    assert exact_dedup.mark(empty).count() == exact_dedup.keep_first(empty).count() == 0


def test_texts_with_equal_prefixes_and_lengths_differ(spark):
    head = "x" * 400
    df = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + "a")], "doc_id long, text string")
    assert [r.keep_id for r in exact_dedup.mark(df).orderBy("doc_id").collect()] == [1, 2, 1]


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(r[0])
    out = []
    for r in rows:
        lines, kept = (r[1] or "").split("\n"), []
        for line in lines:
            held = holders[key(line)]
            ids = [i for i in held if i is not None]
            first = min(ids) if ids else None
            if not (len(key(line)) >= 10 and len(held) > 1 and first != r[0]):
                kept.append(line)
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_are_brute_force(docs, clashing):
    index = line_dedup.LineIndex(docs.sparkSession)
    found = index.apply(docs, index.insert(docs))
    assert rows_of(found.select("doc_id", "n_lines", "n_dropped", "kept")) == brute_lines(awkward_rows())
    other = index.apply(clashing)
    assert rows_of(other.select("doc_id", "n_lines", "n_dropped", "kept")) == brute_lines(awkward_rows())


def test_lines_are_counted_across_batches_and_back(spark):
    all_ = [(i, f"common line number {i % 3}\nown line number {i}\nshort", None, None, None) for i in range(12)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    index = line_dedup.LineIndex(spark)
    assert rows_of(index.apply(make(all_[:5]), index.insert(make(all_[:5]))).select("doc_id", "n_lines", "n_dropped", "kept")) == brute_lines(all_[:5])
    index.insert(make(all_[5:]))
    assert rows_of(index.apply(make(all_)).select("doc_id", "n_lines", "n_dropped", "kept")) == brute_lines(all_)
    gone = {0, 1, 4}
    index.delete(make(all_).where(F.col("doc_id").isin(*gone)).select("doc_id"))
    left = [r for r in all_ if r[0] not in gone]
    assert rows_of(index.apply(make(left)).select("doc_id", "n_lines", "n_dropped", "kept")) == brute_lines(left)
    seen = index.insert(make([all_[0]]))
    assert {r.n_docs for r in seen.collect()} == {4}
    index.delete(make(all_).select("doc_id"))
    assert index.references().count() == 0
    assert 0 < index._filters().count() <= index.shards
    assert all(not np.any(t) for r in index._filters().collect() for t in line_dedup.CuckooFilter.load(r.content).tables)


def test_line_dedup_of_nothing(empty):
    index = line_dedup.LineIndex(empty.sparkSession)
    assert index.apply(empty, index.insert(empty)).count() == 0


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, (60_000, 2))
    held = line_dedup.CuckooFilter()
    held.add(keys[:20_000])
    held.add(keys[20_000:40_000])
    held = line_dedup.CuckooFilter.load(held.dump())
    assert held.contains(keys[:40_000]).all()
    assert held.contains(keys[40_000:]).mean() < 0.002
    held.remove(keys[:5_000])
    assert held.contains(keys[5_000:40_000]).all()
    assert held.contains(keys[:5_000]).mean() < 0.01
    held.add(np.repeat(keys[:1], 40, axis=0))
    assert held.contains(keys[:1]).all()


def test_removal_with_a_smaller_second_table_leaves_other_keys():
    rng = np.random.default_rng(1)
    first = rng.integers(0, 2**31, (20_000, 2))
    held = line_dedup.CuckooFilter()
    held.add(first)
    # These look like one of the first table in the small second one, but not in the first.
    second = first[:12] + np.array([[1 << 10, 1 << 16]])
    small = line_dedup.CuckooFilter()
    small.add(second)
    held.tables += small.tables
    assert len(held.tables[1]) < len(held.tables[0])
    held.remove(first[:12])
    assert held.contains(second).all() and held.contains(first[12:]).all()
    held.remove(second)
    held.remove(first[12:])
    assert not any(np.any(t) for t in held.tables)


@pytest.mark.parametrize("gone", [0, 1])
def test_lines_survive_the_deletion_of_a_line_with_the_same_mark(spark, gone, monkeypatch):
    monkeypatch.setattr(line_dedup, "MIN_SHARDS", 1)
    # All marks and buckets are equal, so that each line looks like every other one.
    key = lambda line: np.frombuffer(b"\0" * 7 + line[-1:] + b"\1" + b"\0" * 6 + line[-1:], "<i8").tolist()
    keyed = lambda docs, *_: spark.createDataFrame([(*key(r.text.encode()), r.doc_id) for r in docs.collect()], "k1 long, k2 long, id long")
    monkeypatch.setattr(line_dedup, "references", keyed)
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    lines = ["a first long line 1", "a second long line 2"]
    index = line_dedup.LineIndex(spark)
    index.insert(make((0, lines[0])))
    index.insert(make((1, lines[1])))
    index.delete(make((gone, "")).select("doc_id"))
    again = index.insert(make((5, lines[1 - gone])))
    assert [(r.n_docs, r.first_id) for r in again.collect()] == [(2, 1 - gone)]
    index.delete(spark.createDataFrame([(0,), (1,), (5,)], "doc_id long"))
    assert all(not np.any(t) for r in index._filters().collect() for t in line_dedup.CuckooFilter.load(r.content).tables)


@pytest.mark.parametrize("alike", [1, 7, 10**9])
def test_any_order_of_insertions_and_deletions_is_brute_force(spark, alike, monkeypatch):
    """Marks collide for all lines (1), for many (7), or for none; shards grow; the index is opened anew each time."""
    monkeypatch.setattr(line_dedup, "MIN_SHARDS", 1)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 12)
    key = lambda line: np.array([n := int(line.split()[-1]), ((n * 7919) << 20) + n % alike], "<i8").tobytes()
    plain = line_dedup.line_key
    keyed = lambda docs, *_: spark.createDataFrame([(*np.frombuffer(key(x), "<i8").tolist(), r.doc_id) for r in docs.collect() for x in set(r.text.split("\n"))], "k1 long, k2 long, id long")
    if alike < 100:
        monkeypatch.setattr(line_dedup, "references", keyed)
        monkeypatch.setattr(line_dedup, "line_key", lambda line: key(line.decode()))
    rng, index = np.random.default_rng(alike), line_dedup.LineIndex(spark)
    texts = {i: "\n".join(f"a line with number {n}" for n in rng.integers(0, 40, 6)) for i in range(24)}
    make = lambda ids: spark.createDataFrame([(int(i), texts[i]) for i in ids], "doc_id long, text string").coalesce(1)
    held: set[int] = set()
    for turn in range(5):
        index = line_dedup.LineIndex(spark, index.folder)
        assert index.version == turn
        if turn in (1, 3):
            gone = set(rng.choice(sorted(held), 4 if turn == 1 else len(held) - 1, replace=False).tolist())
            index.delete(make(sorted(gone)).select("doc_id"))
            held -= gone
        else:
            new = sorted(set(range(24)) - held)[: 9 if turn < 4 else 24]
            told = {(r.k1, r.k2): (r.n_docs, r.first_id) for r in index.insert(make(new)).collect()}
            held |= set(new)
            mine = {line_dedup.line_key(x.encode()) for i in new for x in texts[i].split("\n")}
            want = {}
            for x in mine:
                ids = [i for i in held if x in {line_dedup.line_key(y.encode()) for y in texts[i].split("\n")}]
                if len(ids) > 1:
                    want[tuple(np.frombuffer(x, "<i8").tolist())] = (len(ids), min(ids))
            assert told == want
        rows = [(i, texts[i]) for i in sorted(held)]
        found = index.apply(make(sorted(held))).select("doc_id", "n_lines", "n_dropped", "kept")
        if plain is line_dedup.line_key:
            assert rows_of(found) == brute_lines(rows)
        else:
            assert sum(r.n_lines for r in found.collect()) == 6 * len(held)
        live = {x for i in held for x in map(line_dedup.line_key, texts[i].encode().split(b"\n"))}
        filters = [line_dedup.CuckooFilter.load(r.content) for r in index._filters().collect()]
        assert sum(np.count_nonzero(t) for f in filters for t in f.tables) == len(live)
    assert index.shards > 1


def test_the_query_consults_the_filters(spark, tmp_path, docs):
    docs.drop("lang").write.parquet(str(tmp_path / "documents.parquet"))
    found = line_dedup.query(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(tuple, found), key=repr) == sorted(((i, n, d, sha(t)) for i, n, d, t in brute_lines(awkward_rows())), key=repr)


def plain_shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    held = re.findall(r"[^\x20\x09-\x0D]+", low)
    return [" ".join(held[i : i + n]) for i in range(len(held) - n + 1)] or ([" ".join(held)] if held else [])


def plain_fingerprint(text, n=3):
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in plain_shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows, link=simhash.CLOSE):
    made = [plain_fingerprint(r[1], link.words) for r in rows]
    keys = [set(simhash.band_keys(simhash.shingle_hashes(r[1], link.words), link.bands).tolist()) if link.bands else {0} for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if made[i] == made[j] or (made[i] ^ made[j]).bit_count() <= link.radius and keys[i] & keys[j]:
            parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(((r[0], f"{made[i]:016x}", least(groups[root(i)])) for i, r in enumerate(rows)), key=repr)


def digest(df):
    return rows_of(df.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id"))


def test_near_groups_are_brute_force(docs, spark, clashing, empty):
    assert digest(simhash.near_groups(docs)) == brute_components(awkward_rows())
    assert digest(simhash.near_groups(clashing)) == brute_components(awkward_rows())
    assert simhash.near_groups(empty).count() == simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    near = [(i, words(150, i % 10) + (" changed" if i >= 10 else ""), None, None, None) for i in range(40)]
    df = spark.createDataFrame(near, "doc_id long, text string, lang string, source string, n_chars long")
    assert digest(simhash.near_groups(df)) == brute_components(near)


def edited(text, share, rng):
    """The text with a share of its words replaced, spread over it."""
    held = text.split()
    for i in rng.choice(len(held), max(1, int(share * len(held))), replace=False):
        held[i] = f"w{rng.integers(10**6)}"
    return " ".join(held)


@pytest.mark.parametrize("tile", [8, 2048])
def test_similar_texts_are_found(spark, tile, monkeypatch):
    """Near copies down to a five-word similarity of 0.8 are found; texts that share a passage or nothing are left alone."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(11)
    rows = [(i, words(int(rng.integers(80, 400)), i)) for i in range(60)]
    rows += [(1000 + i, edited(rows[i % 30][1], 0.015, rng)) for i in range(90)]
    shared = words(40, 999)
    rows += [(2000 + i, f"{words(200, 3000 + i)} {shared}") for i in range(40)]
    rows += [(3000, None), (3001, ""), (None, rows[0][1]), (3002, "two words"), (3003, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(simhash.near_groups(df, link=simhash.SIMILAR)) == brute_components(rows, simhash.SIMILAR)
    kept = {r.doc_id for r in simhash.keep_one(df, link=simhash.SIMILAR).collect()}
    held = [(i, set(plain_shingles(t, 5))) for i, t in rows if i is not None]
    group = dict(simhash.near_groups(df, link=simhash.SIMILAR).where("id is not null").select("id", "component_id").collect())
    pairs = [(i, j) for (i, a), (j, b) in combinations(held, 2) if a and b and len(a & b) >= 0.8 * len(a | b)]
    assert len(pairs) > 80 and sum(group[i] == group[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert {2000 + i for i in range(40)} <= kept and all(group[i] == i for i in range(2000, 2040))


@pytest.mark.parametrize("tile", [4, 64])
def test_tiles_lose_no_link(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(tile)
    seeds = rng.integers(0, 2**63, 6, dtype=np.int64).astype(np.uint64)
    values = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(60):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            values.add(int(s) ^ sum(1 << int(b) for b in flips))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), simhash.CLOSE)).collect()
    root = {v: v for v in signed}
    root |= {r.node: r.root for r in found}
    u = np.array(signed).astype(np.uint64) if min(signed) >= 0 else np.array([v % 2**64 for v in signed], np.uint64)
    parent = {v: v for v in signed}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, j in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2), strict=True):
        a, b = top(signed[i]), top(signed[j])
        parent[max(a, b)] = min(a, b)
    assert root == {v: top(v) for v in signed}


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[1000 + i] == 1000 for i in range(300))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
