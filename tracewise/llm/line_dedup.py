"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without ASCII white space at its ends, with A-Z lower-cased, as a 128-bit hash. The index holds
every (key, document) reference, with a sign, in a table, so that documents can be deleted again and each key's count of
documents and first document are exact. In front of that table, each shard of the key space has a cuckoo filter: a key of
a new batch that its filter has not seen is new, so only keys that the filter may have seen, or that the batch itself
repeats, are looked up in the table. Each key that a document holds has a mark of its own in its filter, also where
another key's mark looks the same. Deletion takes the marks of keys that no document holds any more out of the filters.
When the keys outgrow the shards, their number is doubled and the filters are built anew from the table.

Each change is a version: its references and filters are written first, and a line in ``versions`` last. An index opened
on a folder goes on from the last version there; what a lost driver left half written is written over.

Defined cases: null or empty text is one empty line; keys under ``MIN_CHARS`` code points are never dropped; rows with
the same id are one document (null ids too), whose id sorts last if null; a line repeated in the first document that
holds it stays every time; texts that lose all lines become empty. Other columns pass through, whatever their names, but
for ones named as an output, which give way. An empty table adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.common import cut, free_name, table

#: Code points that a key has at least to be dropped anywhere.
MIN_CHARS = 10
#: Shards of the key space at least, and keys that a shard holds on average at most.
MIN_SHARDS, SHARD_KEYS = 64, 250_000
SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4


def line_key(line: bytes) -> bytes | None:
    """The hash of a line's key; None if the key is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four, in one table or, as keys come, several of growing size."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @staticmethod
    def load(content: bytes | None) -> CuckooFilter:
        tables, at = [], 0
        while content and at < len(content):
            n = int.from_bytes(content[at : at + 8], "little")
            tables.append(np.frombuffer(content, "<u2", n * SLOTS, at + 8).reshape(n, SLOTS).copy())
            at += 8 + n * SLOTS * 2
        return CuckooFilter(tables)

    def dump(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.astype("<u2").tobytes() for t in self.tables)

    @staticmethod
    def _marks(keys: np.ndarray) -> np.ndarray:
        return np.maximum(keys[:, 1].astype(np.uint64) & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)

    @staticmethod
    def _other(at: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
        return at ^ ((marks.astype(np.int64) * 0x5BD1E995) & (n - 1))

    def _places(self, keys: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks, at = self._marks(keys), (keys[:, 0] & np.int64(len(held) - 1)).astype(np.int64)
        return marks, at, self._other(at, marks, len(held))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For each key, (n, 2) integers, whether it may have been added."""
        found = np.zeros(len(keys), bool)
        for held in self.tables:
            marks, a, b = self._places(keys, held)
            found |= (held[a] == marks[:, None]).any(1) | (held[b] == marks[:, None]).any(1)
        return found

    def add(self, keys: np.ndarray) -> None:
        """Add keys that are not yet in; each is to be added once."""
        if not len(keys):
            return
        last = self.tables[-1] if self.tables else None
        if last is not None and np.count_nonzero(last) + len(keys) <= last.size * 7 // 8:
            filled = self._filled(last.copy(), keys)
            if filled is not None:
                self.tables[-1] = filled
                return
        size = 1 << max(4, int(len(keys) / SLOTS / 0.8).bit_length())
        filled = self._filled(np.zeros((size, SLOTS), np.uint16), keys)
        if filled is not None:
            self.tables.append(filled)
            return
        for half in (keys[: len(keys) // 2], keys[len(keys) // 2 :]):
            self.add(half)

    def _filled(self, held: np.ndarray, keys: np.ndarray) -> np.ndarray | None:
        """``held`` with the keys' fingerprints placed; None if some find no place."""
        marks, at, _ = self._places(keys, held)
        for turn in range(500):
            order = np.argsort(at, kind="stable")
            at, marks = at[order], marks[order]
            first = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            room = (held[at] == 0).sum(1)
            fits = rank < room
            # The j-th free slot of a bucket is that with j free slots before it.
            slot = np.argsort(held[at[fits]] != 0, axis=1, kind="stable")
            held[at[fits], slot[np.arange(len(slot)), rank[fits]]] = marks[fits]
            at, marks, rank, room = at[~fits], marks[~fits], rank[~fits], room[~fits]
            if not len(at):
                return held
            # The first of each full bucket takes a slot; what stood there goes on to its other bucket, as do the rest.
            swap = rank == room
            victims = held[at[swap], turn % SLOTS].copy()
            held[at[swap], turn % SLOTS] = marks[swap]
            marks[swap] = victims
            at = self._other(at, marks, len(held))
        return None

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were added.

        Larger tables are searched first. Keys that share a mark and its buckets in a table share them in all smaller ones
        too: if the mark found is another key's, that key is still found by the mark that the removed one leaves behind.
        """
        for held in sorted(self.tables, key=len, reverse=True):
            stay = []
            while len(keys):
                marks, a, b = self._places(keys, held)
                in_a, in_b = held[a] == marks[:, None], held[b] == marks[:, None]
                first = in_a.any(1)
                at, hit = np.where(first, a, b), np.where(first[:, None], in_a, in_b)
                some = hit.any(1)
                stay.append(keys[~some])
                keys, at, slot = keys[some], at[some], hit[some].argmax(1)
                # Of several keys that look alike each takes a slot of its own, one a turn.
                _, take = np.unique(at * SLOTS + slot, return_index=True)
                held[at[take], slot[take]] = 0
                keys = np.delete(keys, take, axis=0)
            keys = np.concatenate(stay) if stay else keys


def _references(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = [], []
            for i, text in enumerate(batch.column(text_col)):
                own = {line_key(x) for x in (text.as_py() or "").encode().split(b"\n")} - {None}
                at += [i] * len(own)
                keys += own
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            ids = batch.column(id_col).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), ids], names=["k1", "k2", "id"])

    return run


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, id``: the keys of each row's lines, once each."""
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("id", kind)]
    return docs.select(id_col, text_col).mapInArrow(_references(id_col, text_col), T.StructType(fields))


def _keys(frame: pd.DataFrame) -> np.ndarray:
    return frame[["k1", "k2"]].to_numpy(np.int64)


def _meet(new: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """One shard: the keys that the filter may have seen, and in a row without a key the filter with the others added."""
    held = CuckooFilter.load(state["content"].iloc[0] if len(state) else None)
    keys = _keys(new)
    seen = held.contains(keys)
    held.add(keys[~seen])
    shard = int((new if len(new) else state)["shard"].iloc[0])
    n = int(seen.sum())
    return pd.DataFrame(
        {
            "shard": np.full(n + 1, shard),
            "k1": pd.array([*keys[seen, 0].tolist(), None], "Int64"),
            "k2": pd.array([*keys[seen, 1].tolist(), None], "Int64"),
            "content": [None] * n + [held.dump()],
        }
    )


def _mend(unmarked: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """One shard: the filter with marks added for keys that it only seemed to have seen."""
    held = CuckooFilter.load(state["content"].iloc[0] if len(state) else None)
    held.add(_keys(unmarked))
    return pd.DataFrame({"shard": [int((unmarked if len(unmarked) else state)["shard"].iloc[0])], "content": [held.dump()]})


def _build(keys: pd.DataFrame) -> pd.DataFrame:
    """One shard: a filter with a mark for each key."""
    held = CuckooFilter()
    held.add(_keys(keys))
    return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "content": [held.dump()]})


def _leave(gone: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    held = CuckooFilter.load(state["content"].iloc[0] if len(state) else None)
    held.remove(_keys(gone))
    return pd.DataFrame({"shard": [int((gone if len(gone) else state)["shard"].iloc[0])], "content": [held.dump()]})


def merged(older: DataFrame, newer: DataFrame) -> DataFrame:
    """What two insertions returned, as of the newer one: it has every key of its batch that was known before."""
    return newer.unionByName(older.join(newer, ["k1", "k2"], "left_anti"))


class LineIndex:
    """References and filters in a folder that all executors share; each change adds a version.

    ``folder`` defaults to a new one in the cluster's checkpoint folder. ``keys`` is an upper bound of the keys held.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        if folder is None:
            cut(spark.range(0))
            folder = f"{spark.sparkContext.getCheckpointDir()}/lines-{uuid.uuid4().hex}"
        self.folder, self.version, self.shards, self.keys = folder, 0, MIN_SHARDS, 0
        try:
            last = spark.read.schema("version int, shards int, keys long").json(f"{folder}/versions").orderBy(F.desc("version")).first()
        except AnalysisException:
            last = None
        if last is not None:
            self.version, self.shards, self.keys = last

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.xxhash64("k1", "k2"), F.lit(self.shards)).cast("int"))

    def _filters(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "shard int, content binary")
        return self.spark.read.parquet(f"{self.folder}/filters/{self.version}")

    def _write(self, filters: DataFrame) -> None:
        """The next version's filters, and that it counts."""
        filters.write.mode("overwrite").parquet(f"{self.folder}/filters/{self.version + 1}")
        self.version += 1
        note = self.spark.createDataFrame([(self.version, self.shards, self.keys)], "version int, shards int, keys long")
        note.coalesce(1).write.mode("append").json(f"{self.folder}/versions")

    def _signed(self, upto: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/references").where(F.col("batch") <= upto)

    def references(self, keys: DataFrame | None = None, upto: int | None = None) -> DataFrame:
        """``k1, k2, id`` of all documents that are in, or were at a version; of the given keys only, if any are given."""
        held = self._signed(self.version if upto is None else upto)
        held = held if keys is None else held.join(keys, ["k1", "k2"], "left_semi")
        return held.groupBy("k1", "k2", "id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        """``k1, k2, n_docs, first_id``, exact, of all keys or of the given ones."""
        return self.references(keys).groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.min("id").alias("first_id"))

    def _grown(self, more: int) -> DataFrame:
        """The filters before ``more`` keys come, built anew with more shards where these would be too large."""
        self.keys += more
        if self.keys <= self.shards * SHARD_KEYS:
            return self._filters()
        live = cut(self.references().select("k1", "k2").distinct(), few=True) if self.version else None
        self.keys = more + (live.count() if live is not None else 0)
        while self.keys > self.shards * SHARD_KEYS:
            self.shards *= 2
        if live is None:
            return self._filters()
        return self._sharded(live).groupBy("shard").applyInPandas(_build, "shard int, content binary")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add documents. Returns ``k1, k2, n_docs, first_id`` of those of their keys that two documents or more hold."""
        path = f"{self.folder}/references/batch={self.version + 1}"
        references(docs, id_col, text_col).distinct().withColumn("sign", F.lit(1)).write.mode("overwrite").parquet(path)
        keys = cut(self.spark.read.parquet(path).groupBy("k1", "k2").agg(F.count("*").alias("n")), few=True)
        filters = self._grown(keys.count())
        met = self._sharded(keys.select("k1", "k2")).groupBy("shard").cogroup(filters.groupBy("shard"))
        met = cut(met.applyInPandas(_meet, "shard int, k1 long, k2 long, content binary"))
        filters, seen = met.where("content is not null").select("shard", "content"), met.where("content is null").select("k1", "k2")
        if self.version:
            unmarked = seen.join(self.references(seen).select("k1", "k2").distinct(), ["k1", "k2"], "left_anti")
            filters = self._sharded(unmarked).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_mend, "shard int, content binary")
        self._write(filters)
        # Written apart, so that a very common line can be split where its holders meet it.
        return cut(self.counts(keys.where("n > 1").select("k1", "k2").union(seen).distinct()).where("n_docs > 1"), few=True)

    def delete(self, ids: DataFrame) -> None:
        """Take out all documents whose id is in the single column of ``ids``."""
        ids = ids.toDF("id").distinct()
        held = self._signed(self.version)
        held = held.join(ids, held.id.eqNullSafe(ids.id), "left_semi").groupBy("k1", "k2", "id").agg(F.sum("sign").cast("int").alias("n")).where("n > 0")
        gone = cut(held.select("k1", "k2", "id", (-F.col("n")).alias("sign")))
        gone.write.mode("overwrite").parquet(f"{self.folder}/references/batch={self.version + 1}")
        keys = cut(gone.select("k1", "k2").distinct())
        dead = keys.join(self.references(keys, upto=self.version + 1), ["k1", "k2"], "left_anti")
        left = self._sharded(dead).groupBy("shard").cogroup(self._filters().groupBy("shard"))
        self._write(left.applyInPandas(_leave, "shard int, content binary"))

    def apply(self, docs: DataFrame, repeated: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs``, which are in the index, plus ``n_lines, n_dropped, kept``: the text without lines that an earlier
        document holds.

        ``repeated`` is what ``insert`` returned for these documents; by default all keys are looked up.
        """
        repeated = cut(self.counts().where("n_docs > 1"), few=True) if repeated is None else repeated
        docs = docs.drop("n_lines", "n_dropped", "kept")
        keys, of = (free_name(n, docs.columns) for n in ("__dropped_keys", "__dropped_id"))
        held = self._signed(self.version).join(repeated, ["k1", "k2"]).where(~F.col("id").eqNullSafe(F.col("first_id")))
        later = held.groupBy("k1", "k2", "id").agg(F.sum("sign").alias("n")).where("n > 0")
        dropped = later.groupBy(F.col("id").alias(of)).agg(F.collect_set(F.struct("k1", "k2")).alias(keys))
        joined = docs.join(dropped, docs[id_col].eqNullSafe(dropped[of]), "left").drop(of)
        fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
        return joined.mapInArrow(_applying(text_col), T.StructType([*docs.schema.fields, *fields]))


def _applying(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(batch.column(text_col), batch.column(batch.num_columns - 1), strict=True):
                lines = (text.as_py() or "").encode().split(b"\n")
                gone = {np.array([x["k1"], x["k2"]], "<i8").tobytes() for x in drop.as_py() or ()}
                left = [x for x in lines if line_key(x) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode())
            new = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            names = [*batch.schema.names[:-1], "n_lines", "n_dropped", "kept"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=names)

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, which come in two batches, by a hash of their id, as they would come one after the other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index, early = LineIndex(spark), F.xxhash64("doc_id") < 0
    older = index.insert(docs.where(early))
    kept = index.apply(docs, cut(merged(older, index.insert(docs.where(~early))), few=True))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), j AS (
  SELECT k.doc_id, k.line, k.pos, r.first_id IS NOT NULL AND r.first_id <> k.doc_id AS dropped
  FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
