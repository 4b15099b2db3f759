"""The corpus pipeline: from raw documents to encoded training text, one operator a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import bpe, exact_dedup, langid, mixing, similar
from tracewise.llm.common import cut, free_name, table

#: Predictions less sure than this are rejected, as are texts without letters.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without letters and doubtful ones go.

    Defined cases: null, empty and letterless texts go; where no row teaches a language, as in a table without labels, none
    is doubtful, and all texts with letters stay. Whole texts count, however long. Repeated rows, ties in the score and null
    ids are judged row by row; further columns stay as they are; an empty table stays empty.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = (free_name(n, docs.columns) for n in ("__lang_pred", "__lang_score"))
    found = langid.predict(docs, model, lang_out=lang, score_out=score)
    return found.where((F.col(lang) != langid.UND) & (F.col(score) >= SURE)).drop(lang, score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id's.

    Defined cases: null text counts as empty, and all empty texts are one group; null ids come last; of rows that share the
    smallest id, or have none, the first by its JSON text stays. All columns stay; an empty table stays empty.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id's.

    Near are texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more. SimHash finds the candidates,
    and each link is checked by the shingles of both, so texts below that similarity to all others stay.
    Defined cases: texts without words, null ones among them, are near each other; null ids come last; of rows that share
    the smallest id, or have none, one of the least set of shingles stays, the first by its JSON text. All columns stay; an
    empty table stays empty.
    """
    return similar.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice.

    Defined cases: null text has no tokens; sources without tokens pass once; null sources are a source of their own; rows
    with null ids and repeated rows count each. All columns stay; an empty table stays empty.
    """
    return mixing.mix(docs).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of each row, and ``round_trip``, whether the ids decode to its text.

    Defined cases: null text counts as empty, which has no tokens. Rows are independent of each other and of further
    columns, which are left out; an empty table stays empty.
    """
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the language model nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage but the last is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
