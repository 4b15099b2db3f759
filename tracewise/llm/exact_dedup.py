"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

A text's groups are narrowed by its length, then by a hash of its first characters; only rows whose group still
has two members have their whole content hashed. All of it is built from DataFrame functions.

Defined cases: null text counts as empty; empty texts form one group. The row with the smallest id of a group stays;
null ids sort after all others, and ``mark`` marks all rows of a group of null ids only as kept. Rows that repeat both id
and text count each, and ``mark`` marks all that carry the smallest id. ``keep_first`` keeps one row of each group: of
several with the smallest id, or of null ids only, the first by its JSON text. Other columns of the input play no
part else. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm.common import cut, one_spaced, table

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 256
#: Surviving (length, prefix) keys, 16 bytes each, up to which they are broadcast to the scan.
BROADCAST_KEYS = 200_000


def _narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = one_spaced(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("norm")).select(
        "id", "norm", F.length("norm").alias("norm_len"), _prefix()
    )


def _prefix() -> F.Column:
    return F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix")


def _full_hash() -> F.Column:
    return F.unhex(F.sha2("norm", 256)).alias("sha")


def _surviving_keys(rows: DataFrame) -> DataFrame:
    """``norm_len, prefix`` that two rows or more share.

    They are counted before use. Up to ``BROADCAST_KEYS`` they go to the scan; beyond that they are joined like any table.
    """
    sizes = cut(rows.groupBy("norm_len", "prefix").agg(F.count("*").alias("n")), few=True)
    lengths = sizes.groupBy("norm_len").agg(F.sum("n").alias("n")).where("n > 1").select("norm_len")
    keys = cut(sizes.where("n > 1").join(lengths, "norm_len", "left_semi").select("norm_len", "prefix"), few=True)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def repeated_groups(rows: DataFrame, keys: DataFrame, ties: bool = False) -> DataFrame:
    """``norm_len, sha, keep_id, group_size`` of each text that two rows or more hold; with ``ties`` also ``n_keep``, the
    number of its rows with the smallest id.

    Only rows whose length and prefix are among the surviving ``keys`` have their whole text hashed.
    """
    hashed = rows.join(keys, ["norm_len", "prefix"], "left_semi").select("id", "norm_len", _full_hash())
    if ties:
        by_id = hashed.groupBy("norm_len", "sha", "id").agg(F.count("*").alias("n"))
        of_least = F.coalesce(F.min_by("n", "id"), F.sum("n")).alias("n_keep")
        groups = by_id.groupBy("norm_len", "sha").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), of_least)
    else:
        groups = hashed.groupBy("norm_len", "sha").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    # Written apart, so that the later join with all rows has both sides dealt anew and a hot group can be split there.
    return cut(groups.where("group_size > 1"), few=True)


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id, group_size, kept, text_sha256``.

    The digest is part of the result, so that here rows without a partner are hashed too, in the end.
    """
    rows = _narrowed(docs, id_col, text_col)
    groups = repeated_groups(rows, _surviving_keys(rows))
    found = rows.select("id", "norm_len", _full_hash()).join(groups, ["norm_len", "sha"], "left")
    keep = F.coalesce("keep_id", "id")
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    Rows whose length and prefix are their own stay where they are: they are neither hashed nor moved. Of the others each
    carries its hash to the join with the repeated groups; a group that holds a large share of all rows is one row there,
    and adaptive execution splits the other side.
    """
    narrow = _narrowed(docs, id_col, text_col)
    keys = _surviving_keys(narrow)
    groups = repeated_groups(narrow, keys, ties=True)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(whole, F.col(id_col).alias("id"), one_spaced(text_col).alias("norm"))
    rows = rows.select("whole", "id", "norm", F.length("norm").alias("norm_len"), _prefix())
    alone = rows.join(keys, ["norm_len", "prefix"], "left_anti").select("whole")
    hashed = rows.join(keys, ["norm_len", "prefix"], "left_semi").select("whole", "id", "norm_len", _full_hash())
    found = hashed.join(groups, ["norm_len", "sha"], "left").where(F.coalesce("keep_id", "id").eqNullSafe(F.col("id")))
    if groups.where("n_keep > 1").isEmpty():
        return alone.union(found.select("whole")).select("whole.*")
    tied = F.coalesce("n_keep", F.lit(1)) > 1
    one = found.where(tied).groupBy("norm_len", "sha").agg(F.min_by("whole", F.to_json("whole")).alias("whole"))
    return alone.union(found.where(~tied).select("whole")).union(one.select("whole")).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
