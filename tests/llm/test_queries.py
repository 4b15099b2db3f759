"""The registered queries on whole small tables: against their SQL, or against plain loops where SQL can't say it."""

from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tracewise.llm import langid, mixing, pii, queries, tagger

from .test_dedup import brute_components, brute_exact
from .test_similar import alike_pairs
from .test_text import brute_personal


@pytest.fixture(scope="module")
def engine(sf_dir):
    made = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "benchmark"):
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return made


@pytest.fixture(scope="module")
def documents(engine):
    return engine.execute("SELECT doc_id, text, lang FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, sf_dir, engine, name):
    found, want = queries.QUERIES[name](spark, sf_dir), engine.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)


def test_personal_data_of_all_documents(spark, sf_dir, documents):
    found = {r.doc_id: r for r in queries.QUERIES["op6_pii"](spark, sf_dir).collect()}
    assert len(found) == len(documents)
    reader = pii.Reader(tagger.load())
    spelled = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for doc_id, text, _ in documents:
        base = brute_personal(text or "")
        (more,) = reader.added([text or ""], [base])
        row = found[doc_id]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert row.base_sha256 == hashlib.sha256(spelled(base).encode()).hexdigest()
        assert row.spans == spelled(sorted(base + more, key=lambda s: (s[1], pii.KINDS.index(s[0]))))


def test_fingerprints_of_all_documents(spark, sf_dir, documents):
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in queries.QUERIES["op8_simhash"](spark, sf_dir).collect()), key=repr)
    assert found == brute_components(documents)


def test_languages_of_all_documents(spark, sf_dir, documents):
    """Predictions are those of a plain sum over segmentations, by the same model; and right on held-out rows."""
    rows = {r.doc_id: r for r in queries.QUERIES["op10_language_id"](spark, sf_dir).collect()}
    assert len(rows) == len(documents)
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pieces = {p: i for i, p in enumerate(model.pieces)}
    longest = max(map(len, pieces))
    held: dict[str, list[float]] = {}

    def word(text):
        if text not in held:
            sums = [[1.0] * len(model.languages)]
            for end in range(1, len(text) + 1):
                own = [(sums[a], pieces[text[a:end]]) for a in range(max(0, end - longest), end) if text[a:end] in pieces]
                if text[end - 1] not in pieces:
                    own.append((sums[end - 1], len(pieces)))
                sums.append([sum(s[k] * model.probabilities[i, k] for s, i in own) for k in range(len(model.languages))])
            held[text] = [langid.np.log(x) for x in sums[-1]]
        return held[text]

    right = tested = 0
    for doc_id, text, lang in documents:
        row = rows[doc_id]
        assert row.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            assert row.lang_pred == langid.UND and row.score == 0
            continue
        scores = [sum(x) for x in zip(*(word(langid.MARK + w) for w in words), strict=True)]
        assert row.lang_pred == model.languages[scores.index(max(scores))] and 0 <= row.score <= 1
        if row.held_out and lang is not None:
            right, tested = right + (lang == row.lang_pred), tested + 1
    assert tested > 20 and right / tested > 0.95


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_of_all_documents(spark, sf_dir, documents, library):
    found = {r.doc_id: r for r in queries.QUERIES["op2_bpe"](spark, sf_dir).collect()}
    assert len(found) == len(documents)
    for (doc_id, text, _), coded in zip(documents, library.encode_batch([t or "" for _, t, _ in documents], add_special_tokens=False), strict=True):
        row = found[doc_id]
        assert row.n_tokens == len(coded.ids) and row.ids_sha256 == hashlib.sha256(np.array(coded.ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(coded.ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_from_end_to_end(spark, sf_dir, engine, library):
    """Its rows are those of the stages by plain loops, SQL and the library, one after another over the whole table."""
    told = {r.doc_id: r for r in queries.QUERIES["op10_language_id"](spark, sf_dir).collect()}
    rows = [r for r in engine.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall() if told[r[0]].lang_pred != langid.UND and told[r[0]].score >= corpus_pipeline.SURE]
    stays = {r[0] for r in brute_exact(rows) if r[3]}
    rows = [r for r in rows if r[0] in stays]
    up = list(range(len(rows)))
    for i, j in sorted(alike_pairs([r[1] for r in rows])):
        a, b = sorted((up[i], up[j]))
        up = [a if x == b else x for x in up]
    rows = [r for i, r in enumerate(rows) if up[i] == i]
    held = duckdb.connect()
    held.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    held.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    visits = held.execute(f"SELECT doc_id FROM ({mixing.ORACLE})").fetchall()
    ids = {r[0]: np.array(library.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes() for r in rows}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in found) == sorted((i, ids[i]) for (i,) in visits)
    assert all(r.round_trip and r.n_tokens * 4 == len(r.ids) for r in found)
