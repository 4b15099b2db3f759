"""Importance resampling to a target distribution: hashed features, two Arrow passes, scores with Gumbel noise.

The first pass counts the hashed features of the corpus and of a target: each partition makes one vector of bucket counts
by ``np.bincount``, and ``treeReduce`` merges the vectors on the executors, so that the driver gets a few of fixed length
whatever the corpus. A bucket's gain is the logarithm of its smoothed share in the target over that in the corpus. The
second pass gathers the broadcast gains of each document's features and sums them by ``np.bincount`` with weights. Gumbel
noise from a hash of the id makes the highest scores a draw without replacement, in proportion to the weights; the same
seed draws the same documents.

Features are runs of consecutive words; words are runs of ASCII letters and digits and of all characters beyond ASCII.
Long texts are counted part by part, with the last words of a part going before the next; no text is read in part.

Defined cases: null text counts as empty and has no features, weight 0 and too few words to be drawn; an empty corpus
gives no rows; an empty target makes the frequent rare. A null id counts as empty text in the noise. Of equal scores the
smaller id is drawn first, null ids last; rows that repeat an id have the same noise, are ranked one after another and
count each. Other columns play no part, whatever their names; ``drawn`` passes them through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.batches import slices
from tracewise.llm.common import cut, free_name, table
from tracewise.operators.prefix import numbered

BUCKETS, LENGTHS, SEED = 10_000, (1, 1), "2024"
#: Words that a document must have to be drawn, and the share of these that is drawn, in percent.
MIN_WORDS, PERCENT = 20, 10
#: Factor that makes whole numbers of logarithms.
SCALE = 1000
#: Bytes of text handled at once, bytes of a text that are split at once, and features that a task keeps the buckets of.
SLICE_BYTES, PART_BYTES, KEPT = 1_000_000, 1_000_000, 500_000
#: Vectors that one task merges, about.
FAN_IN = 32
#: Letters and digits stay, A-Z become lower case, other ASCII characters part words.
_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


class Buckets(dict):
    """The bucket of each feature seen."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in parts of bounded size; a part ends where a word does."""
    text, start = text.translate(_WORDS), 0
    while start < len(text):
        end = text.find(b" ", start + PART_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class Features:
    """Buckets of the features of texts."""

    def __init__(self, buckets: int, lengths: tuple[int, int]):
        self.buckets, self.lengths = buckets, lengths
        self.held = Buckets(buckets)

    def of(self, text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
        """Number of words and buckets of the features of each part of a text."""
        low, high = self.lengths
        before: list[bytes] = []
        for words in word_parts(text or b""):
            if len(self.held) > KEPT:
                self.held = Buckets(self.buckets)
            line, found = before + words, []
            for n in range(low, high + 1):
                # A feature belongs to the part that its last word is in.
                first = max(0, len(before) - n + 1)
                runs = islice(line, first, None) if n == 1 else map(b" ".join, zip(*(islice(line, first + i, None) for i in range(n)), strict=False))
                found.append(np.fromiter(map(self.held.__getitem__, runs), np.int64))
            yield len(words), np.concatenate(found)
            before = line[max(0, len(line) - high + 1) :] if high > 1 else []


def _counting(buckets: int, lengths: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(buckets, lengths), np.zeros(buckets, np.int64)
        for _, texts in slices(batches, "text", SLICE_BYTES):
            for text in texts:
                for _, found in features.of(text):
                    sums += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, lengths: tuple[int, int] = LENGTHS) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    A vector a partition, merged in a tree as deep as the number of partitions asks for.
    """
    vectors = texts.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_counting(buckets, lengths), "sums binary").rdd
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(buckets, np.int64)
    depth = max(2, int(np.ceil(np.log(parts) / np.log(FAN_IN))))
    return vectors.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add, depth)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, a whole number: the scaled logarithm of its share in the target over that in the corpus."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighing(gains, buckets: int, lengths: tuple[int, int], text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets, lengths)
        for batch, texts in slices(batches, text_col, SLICE_BYTES):
            words, sizes, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
            waiting, of = [], []

            def add():
                if waiting:
                    doc = np.repeat(of, [len(w) for w in waiting])
                    # Gains and their sums are whole numbers, which doubles hold exactly.
                    sums[:] += np.bincount(doc, gains.value[np.concatenate(waiting)], len(texts))
                    waiting.clear(), of.clear()

            held = 0
            for i, text in enumerate(texts):
                for n, found in features.of(text.encode() if isinstance(text, str) else text):
                    words[i] += n
                    sizes[i] += len(found)
                    waiting.append(found), of.append(i)
                    held += len(found)
                    if held > SLICE_BYTES:
                        add()
                        held = 0
            add()
            made = [pa.array(words), pa.array(sizes), pa.array(sums.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return run


def weigh(
    docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, lengths: tuple[int, int] = LENGTHS,
    corpus: DataFrame | None = None, out: tuple[str, str, str] = ("n_words", "n_features", "weight"),
) -> DataFrame:
    """``docs`` plus the numbers of words and features of each text, and the sum of its features' gains.

    Gains are those of ``target`` over ``corpus``, by default ``docs``, and are broadcast: a vector of fixed length.
    Columns of ``docs`` that are named as an output give way.
    """
    gains = bucket_gains(bucket_counts(docs if corpus is None else corpus, text_col, buckets, lengths), bucket_counts(target, target_col, buckets, lengths))
    rest = docs.drop(*out)
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    fields = [*rest.schema.fields, *[T.StructField(n, T.LongType()) for n in out]]
    return rest.mapInArrow(_weighing(shared, buckets, lengths, text_col, [f.name for f in fields]), T.StructType(fields))


def noise(seed: str, id_col: Column) -> Column:
    """Scaled Gumbel noise of an id: the first 32 bits of a hash as a number between 0 and 1."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, **how) -> DataFrame:
    """``id, n_words, n_features, weight, score`` of each row of ``docs``."""
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return weigh(held, target, **how).select("id", "n_words", "n_features", "weight", (F.col("weight") + noise(seed, F.col("id"))).alias("score"))


def ranked(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` plus ``rank``, from 1: that of the rows drawn; null for others.

    Of N rows with enough words, the floor of that percentage is drawn. Narrow rows are sorted in ranges; a last order by
    row number spreads rows that repeat an id.
    """
    scored = cut(scored)
    able = scored.where(F.col("n_words") >= min_words).withColumn("row", F.monotonically_increasing_id())
    most = able.count() * percent // 100
    placed = numbered(able, [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")], "rank").drop("row")
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).unionByName(rest)


def drawn(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, **how
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns, in no order.

    The last score and id drawn part the rows where they lie, so that texts don't move; only rows that repeat this id are
    numbered, as some of them may be drawn and others not.
    """
    names = [free_name(n, docs.columns) for n in ("__words", "__features", "__weight")]
    weighed = weigh(docs, target, text_col=text_col, out=tuple(names), **how)
    score, id_ = F.col(names[2]) + noise(seed, F.col(id_col)), F.col(id_col)
    placed = cut(ranked(weighed.select(id_.alias("id"), F.col(names[0]).alias("n_words"), score.alias("score")), min_words, percent).where("rank is not null"))
    last = placed.orderBy(F.desc("rank")).first()
    if last is None:
        return docs.limit(0)
    at = F.lit(last["score"]), F.lit(last["id"]).cast(docs.schema[id_col].dataType)
    able = weighed.where(F.col(names[0]) >= min_words)
    same = (score == at[0]) & id_.eqNullSafe(at[1])
    before = (score > at[0]) | (score == at[0]) & (F.lit(last["id"] is None) & id_.isNotNull() | F.coalesce(id_ < at[1], F.lit(False)))
    wanted = placed.where((F.col("score") == at[0]) & F.col("id").eqNullSafe(at[1])).count()
    number, row = (free_name(n, docs.columns) for n in ("__number", "__row"))
    repeated = numbered(cut(able.where(same)).withColumn(row, F.monotonically_increasing_id()), [F.col(row)], number).where(F.col(number) <= wanted)
    return able.where(before).select(*docs.columns).unionAll(repeated.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight and score, and the rank of the tenth that is drawn towards ``benchmark``."""
    found = ranked(scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: A checksum's table by its rule, then the checksum of each distinct word over the bytes of its spelling.
ORACLE = r"""
WITH RECURSIVE b(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM b WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS steps FROM b WHERE k = 8
), all_words AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), distinct_words AS (
  SELECT DISTINCT word, hex(encode(word)) AS spelled FROM all_words
), hashed AS (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(len(spelled) // 2), lambda i: ('0x' || substr(spelled, 2 * i + 1, 2))::BIGINT),
                               lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM distinct_words, crc
), counted AS (
  SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM all_words JOIN hashed USING (word) GROUP BY bucket
), sums AS (
  SELECT sum(s)::DOUBLE AS S_all, sum(t)::DOUBLE AS T_all FROM counted
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (S_all + 10000) / ((s + 1)::DOUBLE * (T_all + 10000))))::BIGINT AS gain FROM counted, sums
), weights AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS w FROM all_words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
         coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON doc_id = id
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
