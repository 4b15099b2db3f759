"""Resampling, fill-in-middle and packing against plain loops and the tokenizers library."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewise.llm import fim, packing, queries, resample

from .conftest import SCHEMA, awkward_rows, words

TARGET = [("a", "same line of text here"), ("b", None), ("c", ""), ("d", words(60, 1))]


def plain_features(text, lengths=(1, 1)):
    held = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return held, [" ".join(held[i : i + n]) for n in range(lengths[0], lengths[1] + 1) for i in range(len(held) - n + 1)]


def brute_resample(rows, targets, buckets=10_000, lengths=(1, 1), min_words=20, percent=10):
    of = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(of, plain_features(r[1], lengths)[1]))
    for r in targets:
        t.update(map(of, plain_features(r[1], lengths)[1]))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        held, features = plain_features(r[1], lengths)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(of, features))
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(held), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for i, x in enumerate(able[: len(able) * percent // 100]):
        x[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def scored(df, target, percent=10, min_words=20, **how):
    rows = resample.ranked(resample.scores(df, target, **how), min_words, percent).collect()
    return sorted(((r.id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, "item_id string, text string")


@pytest.mark.parametrize(("buckets", "lengths"), [(10_000, (1, 1)), (7, (1, 3)), (100, (2, 2))])
def test_resampling_is_brute_force(spark, target, monkeypatch, buckets, lengths):
    # Texts in many parts; features that the task forgets.
    monkeypatch.setattr(resample, "PART_BYTES", 5)
    monkeypatch.setattr(resample, "KEPT", 50)
    monkeypatch.setattr(resample, "SLICE_BYTES", 100)
    rows = awkward_rows() + [(100 + i, words(30, i), "en", "a", 1) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert scored(df, target, 50, buckets=buckets, lengths=lengths) == brute_resample(rows, TARGET, buckets, lengths, percent=50)


def test_resampling_of_awkward_tables(spark, docs, clashing, empty, target):
    want = brute_resample(awkward_rows(), TARGET)
    assert scored(docs, target) == want and scored(clashing.withColumns({c: F.lit("x") for c in ("n_words", "weight", "rank", "__words", "__weight")}), target) == want
    assert scored(empty, target) == []
    assert scored(docs, empty.select("text")) == brute_resample(awkward_rows(), [])
    assert resample.drawn(empty, target).count() == 0 and resample.drawn(docs, target, percent=0).count() == 0


@pytest.mark.parametrize("percent", [10, 37, 100])
def test_drawn_rows_are_the_ranked_ones(spark, target, percent):
    # A third of the rows repeat one row, others have no id.
    rows = [(i, words(25, i), "en", "a", 1) for i in range(60)] + [(7, words(25, 7), "en", "a", 1)] * 40 + [(None, words(25, i % 3), "de", "b", 1) for i in range(20)] + [(200, "too few", "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("x") for c in ("score", "__words", "__number", "__row")})
    taken = resample.drawn(df, target, percent=percent)
    assert taken.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in taken.collect())
    assert sum(got.values()) == 120 * percent // 100 and not got - Counter((r[0], r[1]) for r in rows)
    ranks = Counter(x[0] for x in brute_resample(rows, TARGET, percent=percent) if x[5])
    assert Counter({i: sum(n for (j, _), n in got.items() if i == j) for i in {j for j, _ in got}}) == ranks


def test_counts_of_no_partitions_and_of_many(spark, target):
    assert not resample.bucket_counts(spark.createDataFrame(spark.sparkContext.emptyRDD(), "text string")).any()
    rows = [(words(9, i),) for i in range(90)]
    found = resample.bucket_counts(spark.createDataFrame(rows, "text string").repartition(70), buckets=50)
    assert found.sum() == 90 * 9 and len(found) == 50


def brute_fim(doc_id, text, rate=90):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def test_fill_in_middle_is_brute_force(spark, docs, clashing, empty, monkeypatch):
    monkeypatch.setattr(fim, "KEPT_RUNS", 20)
    odd = ["a<P>b", "<P", "P>", "<<S>>", "<M", "é‍\U0001f469‍\U0001f4bb" * 9, "\r\n\r\n", "\x00\x1c\x85  　", "x" * 1000 + " " * 1000, "a  b\t\tc\n\n  d ", "S>" * 50]
    more = spark.createDataFrame([(i, odd[i % len(odd)], "en", "a", 1) for i in range(1000, 1100)], SCHEMA)
    made = fim.restore(fim.fill_in_middle(clashing.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit(1) for c in ("n", "output", "restored", "__hashes", "hashes")}))).collect()
    assert len(made) == len(awkward_rows()) + 100
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty).count() == 0
    assert fim.fill_in_middle(docs).columns == [*docs.columns, *fim.OUT]


def test_units_of_other_patterns(spark):
    """Words with the gaps between them as units: cuts fall on their edges only."""
    rule = fim.Rule(rate=100, suffix_first=50, unit=r"\S+", prefix="[pre]", suffix="[suf]", middle="[mid]")
    rows = [(i, " ".join(f"ä{j}" for j in range(i % 7))) for i in range(60)]
    made = fim.restore(fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rule=rule), rule).collect()
    for r in made:
        units = re.findall(r"\S+|\s+", r.text)
        assert r.n == len(units) and r.restored == r.text
        edges = {len("".join(units[:i])) for i in range(len(units) + 1)}
        assert r.form == "plain" and not r.text or {r.prefix_chars, r.prefix_chars + r.middle_chars} <= edges


@pytest.mark.parametrize("marks", [("<P>", "<S>", "<P>"), ("ab", "bc", "x"), ("", "b", "c"), ("aa", "aab", "c"), ("aba", "x", "y")])
def test_marks_that_can_arise_by_chance_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Rule(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_offsets_are_those_of_the_whole_text():
    splitter = fim.Splitter(fim.CODE_POINT)
    texts = [words(500, 3) * 3, "ünï\r\n\t  \x85 😀" * 40, "z" * 5000, ""]
    for text, found in zip(texts, splitter.offsets(texts), strict=True):
        assert found.tolist() == [a for _, (a, _) in splitter.split(text)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(library, rows, found, capacity=1024):
    """Every id in one piece, sequences gapless; returns the shares of padding and the number of pieces."""
    encoded = library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = Counter((i, tuple(e.ids + [0])) for (i, _), e in zip(rows, encoded, strict=True))
    sequences, parts = defaultdict(list), defaultdict(list)
    for doc, start, ids, n, sequence, offset in found:
        assert ids
        sequences[sequence].append((offset, len(ids)))
        parts[doc, n].append((start, ids))
    filled = 0
    for held in sequences.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= capacity
        filled += packing.padded(at, capacity)
    # Documents that repeat an id and a length are told apart by what they hold.
    for key, held in parts.items():
        docs = Counter({ids: k for (i, ids), k in want.items() if (i, len(ids)) == key})
        assert sum(docs.values()) * key[1] == sum(len(ids) for _, ids in held)
        for ids in docs:
            for start, piece in held:
                if len(docs) == 1:
                    assert ids[start : start + len(piece)] == piece
        covered = Counter(p for start, piece in held for p in range(start, start + len(piece)))
        assert set(covered.values()) == {sum(docs.values())} and len(covered) == key[1]
    assert {(i, len(ids)) for i, ids in want} == set(parts)
    total = sum(len(ids) * k for (_, ids), k in want.items())
    return (filled - total) / max(filled, 1), len(found)


def pieces_of(packed):
    return [(r.doc, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.doc_tokens, r.sequence_id, r.offset) for r in packing.pieces(packed).collect()]


def test_packing_of_awkward_tables(spark, docs, clashing, empty, library):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    for df in (docs, clashing.withColumns({c: F.lit("x") for c in ("doc", "pieces", "sequence_id", "all")})):
        packed = packing.pack(df)
        share, _ = check_packing(library, rows, pieces_of(packed))
        assert share < 0.02
        for r in packed.collect():
            assert len(r.ids) == 4 * packing.padded(r.n_tokens, 1024) and r.n_tokens == sum(p.length for p in r.pieces)
    assert packing.pack(empty).count() == 0
    strange = spark.createDataFrame([(["k"], " " * 70_000 + "a" * 70_000), (None, "<|endoftext|>" * 3)], "doc_id array<string>, text string")
    found = [(tuple(p[0] or ()), *p[1:]) for p in pieces_of(packing.pack(strange))]
    check_packing(library, [(("k",), " " * 70_000 + "a" * 70_000), ((), "<|endoftext|>" * 3)], found)


@pytest.mark.parametrize("capacity", [8, 100, 1024])
def test_cuts_leave_little_room(capacity):
    for n in range(1, 3 * capacity + 1):
        made = packing.cuts(n, capacity)
        assert sum(made) == n and all(0 < x <= capacity for x in made) and made == sorted(made, reverse=True)
        for x in made:
            k = capacity // x
            assert k * x * (packing.FREE + 1) > capacity * packing.FREE - k * packing.FREE - capacity or k >= packing.FREE or x == capacity // k
    assert packing.powers(0b1011001) == [64, 16, 8, 1] and packing.powers(0) == []


def test_classes_take_a_fixed_number_of_pieces(library):
    packer = packing.Packer(1024, 16)
    whole = [s for i in range(3000) for s in packer.add(i, np.full(1 + i * 7 % 1500, i, np.uint32))]
    for s in whole:
        k = 1024 // len(s[0].ids)
        assert len(s) == k and all(1024 // len(p.ids) == k for p in s)
        assert sum(len(p.ids) for p in s) > 1024 * 16 / 17
    left = list(packer.close())
    assert [sum(len(p.ids) for p in s) for s in left[:-11]] == [1024] * len(left[:-11])
    assert sum(len(p.ids) for s in whole + left for p in s) == sum(1 + i * 7 % 1500 for i in range(3000))


@pytest.fixture(scope="module")
def documents(sf_dir):
    return duckdb.execute(f"SELECT doc_id, text FROM read_parquet('{sf_dir}/documents.parquet')").fetchall()


def test_packing_query_on_all_documents(spark, sf_dir, documents, library):
    rows = queries.QUERIES["op13_packing"](spark, sf_dir).collect()
    encoded = dict(zip((i for i, _ in documents), (e.ids + [0] for e in library.encode_batch([t or "" for _, t in documents], add_special_tokens=False)), strict=True))
    cut = lambda r: encoded[r.doc_id][r.start : r.start + r.length]
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(cut(r), "<u4").tobytes()) and r.doc_tokens == len(encoded[r.doc_id])
    share, n = check_packing(library, documents, [(r.doc_id, r.start, tuple(cut(r)), r.doc_tokens, r.sequence_id, r.offset) for r in rows])
    assert share < 0.01 and n < 4 * len(documents) + sum(map(len, encoded.values())) / 1024


def test_sequences_do_not_depend_on_how_often_they_are_made(spark, sf_dir):
    df = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(df.select("sequence_id", "ids").collect()) == sorted(df.select("sequence_id", "ids").collect())
