"""Exact top-k search by distributed histogram selection.

Queries and candidates are dealt into blocks, and every pair of blocks scores all its vectors by one matrix product. A pair
passes on, for each of its queries, the scores that can be among the k best of all: the k best of the pair, ties to smaller
ids. Jobs over these then narrow, for each query, the interval that holds its kth score: each sums a histogram of the
interval and goes on in the bin that the kth score falls into, until the bin is one value wide. A last job keeps what
scores higher, and of the ties at the kth score the smallest ids.

Vectors become integers floor(64 * x), so scores and ties are exact. Defined cases: vectors that are null or hold null or
non-finite components, and rows with a null id, take no part; vectors are compared with those of the same length only;
rows that repeat an id are candidates each, but none for a query of that id; a query id that repeats is one query, with
the smallest of its vectors. Empty vectors score 0. Scores beyond 2^61 wrap or are taken as lying there; there is no crash.
Other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewise.llm.common import cut, table

SCALE = 64
#: Vectors in a block, on average; a pair of blocks is one unit of work.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Queries of a block whose scores are held at once, and bins that an interval of scores is split into.
TILE, BINS = 256, 128


def integers(vector: str) -> Column:
    """The vector's components as integers; null for vectors that take no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(odd, F.lit(True)), F.transform(wide, lambda x: F.floor(x * SCALE).cast("long")))


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = [], []
        for i in range(batch.num_rows):
            rows = batch.column("rows")[i].values
            own = rows.field("id").to_numpy(zero_copy_only=False)
            values = rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            order = np.argsort(own, kind="stable")
            small = not values.size or np.abs(values).max() < 2**31
            ids.append(own[order].astype("<i8").tobytes())
            vectors.append(values[order].astype("<i4" if small else "<i8").tobytes())
        columns = [batch.column("dim"), batch.column("block"), pa.array(ids, pa.binary()), pa.array(vectors, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "block", "ids", "vectors"])


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """``dim, block, ids, vectors``: packed blocks, each sorted by id. Which block a row is in follows from its content."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    held = dealt.groupBy(F.size("v").alias("dim"), "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return cut(held.mapInArrow(_packing, "dim int, block int, ids binary, vectors binary"), few=True)


def _unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    kind = "<i4" if len(vectors) == 4 * dim * len(own) else "<i8"
    return own, np.frombuffer(vectors, kind).reshape(len(own), dim)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products, in the narrowest arithmetic that keeps them exact."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    made = (queries.astype(kind) @ candidates.astype(kind).T).astype(np.int64)
    return np.clip(made, -(2**61), 2**61) if kind is np.int64 else made


def _best(k: int):
    """``query_id, vec_id, score`` of each query's k best in a pair of blocks; a query is no candidate of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("dim", "c_ids", "c_vectors", "q_ids", "q_vectors")}
                c_ids, candidates = _unpack(row["c_ids"], row["c_vectors"], row["dim"])
                q_ids, queries = _unpack(row["q_ids"], row["q_vectors"], row["dim"])
                for at in range(0, len(q_ids), TILE):
                    own_ids = q_ids[at : at + TILE]
                    scores, other = _scores(queries[at : at + TILE], candidates), own_ids[:, None] != c_ids[None, :]
                    low = np.where(other, scores, np.iinfo(np.int64).min)
                    kth = np.partition(low, low.shape[1] - k, axis=1)[:, -k, None] if low.shape[1] > k else low.min(1, initial=0, keepdims=True)
                    above, tie = low > kth, low == kth
                    # Candidates stand in the order of their ids, so the first ties are those to keep.
                    keep = (above | tie & (np.cumsum(tie, axis=1) <= k - above.sum(1, keepdims=True))) & other
                    q, c = np.nonzero(keep)
                    out = [pa.array(own_ids[q]), pa.array(c_ids[c]), pa.array(scores[q, c])]
                    yield pa.RecordBatch.from_arrays(out, names=["query_id", "vec_id", "score"])

    return run


def _pairs(candidates: DataFrame, queries: DataFrame, n_c: int, n_q: int) -> DataFrame:
    """Every pair of a candidate and a query block of one vector length."""
    q = queries.select("dim", F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    c = candidates.select("dim", F.col("block").alias("cb"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    return c.join(q, ["dim", "cb", "qb"])


def _narrower(state: DataFrame, kept: DataFrame) -> DataFrame:
    """The states, with each interval narrowed to the bin of the kth score; to its lower end if there are too few scores."""
    width = F.floor((F.col("high") - F.col("low")) / BINS).cast("long") + 1
    held = kept.join(state.withColumn("width", width), "query_id").where("score >= low and score <= high")
    counts = held.groupBy("query_id", "need", F.expr("(high - score) div width").alias("bin")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("query_id").orderBy("bin")
    counts = counts.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    found = counts.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    found = found.select("query_id", "bin", (F.col("upto") - F.col("n")).alias("above"))
    top = F.col("high") - F.col("bin") * width
    return cut(
        state.join(found, "query_id", "left").select(
            "query_id",
            F.when(F.col("bin").isNull(), F.col("low")).otherwise(F.greatest("low", top - width + 1)).alias("low"),
            F.when(F.col("bin").isNull(), F.col("low")).otherwise(top).alias("high"),
            (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"),
        ),
        few=True,
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of all other vectors for each row for which ``is_query`` holds.

    ``is_query`` is a condition on the columns of ``vectors``. Blocks, scores, intervals and histograms stay on the
    executors; the driver learns counts, and whether all intervals are one value wide.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(vector_col).alias("v"), is_query.alias("asked"))
    rows = rows.where("id is not null and v is not null")
    n, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    n_c, n_q = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    queries = _blocks(rows.where("asked").groupBy("id").agg(F.min("v").alias("v")), n_q)
    pairs = _pairs(_blocks(rows.select("id", "v"), n_c), queries, n_c, n_q)
    # Dealt by number: pairs are few bytes and much work.
    dealt = pairs.repartition(max(1, min(n_c * n_q, 64 * vectors.sparkSession.sparkContext.defaultParallelism)), "dim", "cb", "qb")
    kept = cut(dealt.mapInArrow(_best(k), "query_id long, vec_id long, score long"))
    state = cut(kept.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.lit(k).cast("long").alias("need")), few=True)
    while not state.where("high > low").isEmpty():
        state = _narrower(state, kept)
    chosen = kept.join(state.select("query_id", F.col("low").alias("kth")), "query_id").where("score >= kth")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return chosen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
