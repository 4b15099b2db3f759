"""Mixing, top-k search and the pipeline against brute force."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewise.llm import langid, mixing, queries, topk

from .conftest import awkward_rows, words
from .test_dedup import brute_exact
from .test_similar import check


def test_repetition_limit_is_met():
    a = mixing.exponent_for_repetition(10, 1000, 3.0)
    assert (10 / 1000) ** (a - 1) == pytest.approx(3.0)
    assert mixing.exponent_for_repetition(10, 15, 3.0) == 0.0


def test_entropy_target_is_met(spark):
    shares = [0.6, 0.25, 0.1, 0.05]
    df = spark.createDataFrame([(s,) for s in shares], "share double")

    def entropy(a):
        w = np.array(shares) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum()

    target = (entropy(0) + entropy(1)) / 2
    assert entropy(mixing.exponent_for_entropy(df, target)) == pytest.approx(target, abs=1e-9)
    assert mixing.exponent_for_entropy(df, 0.1) == 1.0 and mixing.exponent_for_entropy(df, 5.0) == 0.0


def mixed_docs(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "big" if i < 600 else f"s{i % 3}", 0) for i in range(700)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mix_meets_its_budgets(spark):
    rows, df = mixed_docs(spark)
    tokens = Counter()
    for r in rows:
        tokens[r[3]] += len(r[1].split())
    seen, got = Counter(), Counter()
    for r in mixing.mix(df).select("row.*", "epoch").collect():
        seen[r.doc_id] += 1
        got[r.source] += len(r.text.split())
    assert set(seen) == {r[0] for r in rows}, "each document occurs at least once"
    weights, _ = mixing.source_weights(df)
    for w in weights.collect():
        want = w.tokens * w.passes
        assert want * 0.9 <= got[w.src] <= want + 1e-6, w
    assert max(seen.values()) <= math.ceil(mixing.MAX_REPETITION) and got["big"] == tokens["big"]


def test_a_smaller_budget_samples_blocks(spark):
    rows, df = mixed_docs(spark)
    total = sum(len(r[1].split()) for r in rows)
    taken = mixing.mix(df, budget_tokens=total / 2).select("row.*").collect()
    n = sum(len(r.text.split()) for r in taken)
    assert total * 0.4 < n <= total / 2


@pytest.mark.parametrize("seed", ["mix", "other"])
def test_one_long_document_leaves_the_weights_right(spark, seed):
    rows = [(i, "w " * 5, "en", "even", 0) for i in range(400)] + [(1000 + i, "w " * 5, "en", "skew", 0) for i in range(100)] + [(2000, "w " * 500, "en", "skew", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for targets in ({"max_repetition": 1.3}, {"max_repetition": 1.7}, {"budget_tokens": 1200}):
        got = {r.source: r.n for r in mixing.mix(df, seed, **targets).select("row.source", mixing.token_count("row.text").alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()}
        for w in mixing.source_weights(df, **targets)[0].collect():
            want = w.tokens * w.passes
            assert want - 40 < got[w.src] <= want + 1e-6, (targets, w, got)


def test_mix_of_awkward_rows(docs, clashing, empty):
    made = mixing.mix(clashing).select("row.*")
    assert made.columns == clashing.columns
    assert {(r.doc_id, r.text) for r in made.collect()} == {(r[0], r[1]) for r in awkward_rows()}
    assert mixing.mix(empty).count() == 0
    no_text = docs.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix(no_text).count() == len(awkward_rows())


def brute_top(rows, k):
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in held:
        if i % 5 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in held if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(3, 7), (2048, 8192)])
def test_top_k_is_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", sizes[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", sizes[1])
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(60)]
    rows += [(i, [0.5] * 6) for i in range(60, 110)]  # ties
    rows += [(200, None), (205, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (210, [float("nan")] * 6), (215, [float("inf")] * 6), (None, [1.0] * 6), (220, [1.0, 2.0]), (221, [3.0, -2.0]), (225, []), (10, [0.1] * 6), (10, [0.2] * 6)]
    rows += [(230, [1e5] * 6), (231, [-3e7] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "block", "state")})
    found = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=4).collect())
    assert found == brute_top(rows, 4)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0
    wild = spark.createDataFrame([(5, [1e300, -1e300]), (6, [-1e300, 1e300]), (7, [1e17, 1e17]), (10, [1e300, 1e300]), (11, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(wild, F.col("vec_id") % 5 == 0, k=3).count() == 6


def test_pipeline_stages_on_small_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    df = spark.createDataFrame([*rows, (9001, "12 34", "en", "src1", 5), (9002, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in df.select(columns).collect()]
        after_df = stage(spark, df, sf_dir)
        if name == "bpe":
            assert after_df.count() == len(before) and after_df.where("not round_trip").count() == 0
            break
        assert after_df.columns == columns
        after = [tuple(r) for r in after_df.collect()]
        if name == "language_id":
            assert set(before) - set(after) == {(9001, "12 34", "en", "src1", 5), (9002, None, None, None, None)}
        if name == "exact_dedup":
            assert {r[0] for r in after} == {r[0] for r in brute_exact(before) if r[3]}
        if name == "near_dedup":
            assert len(after) == len({r[0] for r in after}) and check(sorted((r[0], r[1]) for r in before), {r[0] for r in after})[0] == 0
        if name == "mixing":
            assert set(after) == set(before)
        df = spark.createDataFrame(after, df.schema)


def test_pipeline_stages_bear_awkward_and_empty_tables(spark, docs, empty, clashing):
    for start in (docs, empty, clashing):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
            if name != "bpe":
                assert df.columns == start.columns
                df = spark.createDataFrame(df.collect(), start.schema)
        assert df.where("not round_trip").count() == 0


def test_pipeline_stages_keep_unlabelled_texts_and_one_row_of_each_id(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b = words(60, 1), words(60, 2)
    rows = [(1, a, None, "x", 1), (1, a, None, "y", 1), (2, a, None, "x", 1), (1, b, None, "x", 1), (None, "one text", None, "x", 1), (None, "one  text", None, "x", 1), (3, "12 34", None, "x", 1), (4, None, None, "x", 1)]
    named = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, schema), "")
    assert sorted(map(repr, named.collect())) == sorted(map(repr, spark.createDataFrame(rows[:6], schema).collect()))
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        kept = stage(spark, spark.createDataFrame(rows[:6], schema), "")
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((tuple(r)[:4] for r in kept.collect()), key=repr) == sorted([(1, a, None, "x"), (1, b, None, "x"), (None, "one  text", None, "x")], key=repr)


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_held_out_is_a_quarter(spark):
    n = spark.range(4000).select(langid.held_out("id").alias("h")).where("h").count()
    assert 800 < n < 1200


def sql_mix(rows, budget):
    """The query's SQL with a budget, over other rows."""
    engine = duckdb.connect()
    engine.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    engine.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    plain = "pow(tokens / most, a) * most / tokens"
    assert plain in mixing.ORACLE
    scaled = f"{budget} * pow(tokens / most, a) / (SELECT sum(pow(tokens / most, a)) FROM t, e WHERE tokens > 0) / tokens"
    return sorted(engine.execute(mixing.ORACLE.replace(plain, scaled)).fetchall(), key=repr)


@pytest.mark.parametrize("budget", [0, 0.5, 3, 50, 333, 1000, 5000])
def test_budgets_are_those_of_the_sql(spark, budget):
    # A source of one token, starved by small budgets; one with a long document; one without tokens.
    rows = [(i, "w " * (1 + i % 5), "en", "big", 0) for i in range(200)] + [(1000 + i, "w " * 3, "en", "mid", 0) for i in range(30)] + [(1500, "w " * 300, "en", "mid", 0), (2000, "w", "en", "tiny", 0), (3000, " ", "en", "none", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = mixing.mix(df, budget_tokens=budget).select("row.doc_id", "row.source", mixing.token_count("row.text").alias("n"), "epoch", "block", "block_pos").collect()
    assert sorted(map(tuple, found), key=repr) == sql_mix(rows, budget)
    if budget <= 0.5:
        assert {r.source for r in found} == {"none"}


def test_a_pass_of_very_many_blocks_takes_linear_work(spark):
    """The fold over all the blocks a plan may have; four times as many blocks take about four times as long."""

    def seconds(n):
        visits = spark.range(n).select(
            F.lit("a").alias("src"), F.lit(0).alias("epoch"), F.lit(0).alias("whole"), (F.lit(float(n)) * 5).alias("part"), F.col("id").alias("block"), (F.hash("id") % 5 + 10).cast("long").alias("n_tokens"),
            F.lit(n * 10).alias("tokens"), F.col("id").alias("block_pos"),
        )
        began = time.perf_counter()
        rows = mixing._fitting(visits).collect()
        took, room, want = time.perf_counter() - began, n * 5, []
        for r in visits.orderBy("block_pos").collect():
            if r.n_tokens <= room:
                room, want = room - r.n_tokens, [*want[-3:], r.block]
        assert sorted(r.block for r in rows)[-3:] == sorted(want)[-3:]
        return took

    seconds(1024)
    few, many = seconds(16_384), seconds(65_536)
    assert many < 12 * few + 2
