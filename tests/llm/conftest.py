"""Small documents with the awkward cases that every operator must bear."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ("id", "norm", "fp", "sha", "keep_id", "component_id", "row", "src", "block", "epoch", "lang_pred", "score", "ids", "decoded", "spans", "kept", "path", "blob", "k1", "cell", "whole", "prefix", "keep_fp", "made", "__lang", "__score", "__spans", "__fp", "__dropped_keys", "__dropped_id", "__lang_pred", "__lang_score")


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    long_text = "\n".join(words(40, i) for i in range(300)) + "z" * 50_000
    same = "Same line of text here\nSecond line of the text"
    return [
        (1, same, "en", "a", 1), (2, "same   line of text here\n", "en", "a", 1), (3, same, "en", "a", 1), (3, same, "en", "a", 1),
        (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n ", "de", "b", 0), (7, long_text, "en", "a", 1), (8, long_text, "en", None, 1),
        (None, same, None, "b", None), (None, "only here, with no id", "de", "b", 2), (9, "Ünïcödé ﬁ 😀 <|endoftext|> x", "de", "b", 1),
        (10, words(60, 1), "fr", "c", 1), (11, words(60, 1) + " extra", "fr", "c", 1), (12, "12345 67890 !!! ...", "en", "c", 1), (13, "a\x1cb\x85c d", "en", "c", 1),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"x {c}") for c in CLASHING})
