"""The driver's contract: names, columns and values against another engine."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tracewise import queries

TABLES = ("events", "embeddings", "documents")


def canonical(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def engine(sf_dir):
    made = duckdb.connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return made


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, sf_dir, engine, name):
    found = queries.QUERIES[name](spark, sf_dir)
    want = engine.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(tuple(canonical(r[c]) for c in sorted(columns)) for r in found.collect())
    others = sorted(tuple(canonical(v) for _, v in sorted(zip(columns, r, strict=True))) for r in want.fetchall())
    assert rows == others


def test_queries_without_sql_have_rows(spark, sf_dir):
    for name in set(queries.QUERIES) - set(queries.ORACLES):
        assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"protocol", "n_modulated", "n_total", "percent"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
