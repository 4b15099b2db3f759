"""SimHash near-dedup by tiled exact comparison with exclusive-or and bit counts.

A fingerprint has 64 bits, each the majority of the hashes of a text's shingles. Equal fingerprints are first made one. The
others are compared within cells only, and there in tiles, blocks of fingerprints of near equal bit counts. Pairs of tiles
whose bit counts differ beyond the radius are skipped; the others are compared in full by numpy, and give the edges of a
spanning forest rather than all links. Cells of one block are tiled inside their task; larger ones are blocks of equal bit
counts, and pairs of blocks are dealt to as many tasks as their comparisons ask for. Components come from the edges by
Spark.

``Link`` says what is linked. Where fingerprints may differ in a few bits only, cells are bands of bits: of ``radius + 1``
bands two near fingerprints agree in one, so that no link is lost. For radii at which bands would be too narrow to part
anything, cells are bands of min-hashes of the shingles, of two values each: texts link if they share one and their
fingerprints lie within the radius. With eight bands, texts with a similarity (Jaccard) of 0.8 share one with probability
0.9997.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like others; texts with
fewer words than a shingle are one shingle. Null ids are no smallest id, unless a component has no other. Rows that repeat
an id count each. ``keep_one`` keeps one row of each component: of several with its smallest id, or of null ids only, one
of the smallest fingerprint, the first by its JSON text. Other columns play no part else; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.common import cut, free_name, table
from tracewise.llm.components import components

SEED = 42
#: Fingerprints in a block, on average, and in a tile of it, which numpy compares at a time.
TILE, PART = 2048, 128
#: Comparisons of fingerprints that a task gets, on average: some seconds of work.
TASK_PAIRS = 1 << 30
#: Hashes of a long text whose bits are counted at a time.
PART_HASHES = 1 << 16
_hash = xxhash.xxh64_intdigest


@dataclass(frozen=True)
class Link:
    """Words of a shingle, bits that linked fingerprints may differ in, and bands of min-hashes; none: bands of bits."""

    words: int = 3
    radius: int = 2
    bands: int = 0


#: What links by default; and texts of which about four fifths of the five-word shingles agree.
CLOSE, SIMILAR = Link(), Link(words=5, radius=14, bands=8)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hash of each shingle, repeats included; of a shorter text its whole."""
    held = (text or "").encode().lower().split()
    if len(held) < words:
        return np.array([_hash(b" ".join(held), SEED)] if held else [], np.uint64)
    shingles = zip(*(islice(held, i, None) for i in range(words)), strict=False)
    return np.fromiter((_hash(b" ".join(s), SEED) for s in shingles), np.uint64, len(held) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as an unsigned number."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PART_HASHES):
        bits = np.unpackbits(hashes[at : at + PART_HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        # Sums of up to 255 bits fit a byte.
        counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _odd(n: int) -> np.ndarray:
    return np.random.default_rng(n).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A number for each band: two min-hashes, each the least of the hashes by an order of its own."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.array([((hashes ^ (hashes >> np.uint64(32))) * m).min() for m in _odd(2 * bands)], np.uint64).reshape(bands, 2)
    mixed = (least[:, 0] ^ (least[:, 1] >> np.uint64(29)) ^ (least[:, 1] << np.uint64(35))) * _odd(1)[0]
    return (mixed + np.arange(bands, dtype=np.uint64)).view(np.int64)


def _fingerprinting(link: Link):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, keys = np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(batch.column(1)):
                hashes = shingle_hashes(text.as_py(), link.words)
                made[i] = fingerprint(hashes)
                keys.append(band_keys(hashes, link.bands) if link.bands else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp", "keys"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: Link = CLOSE) -> DataFrame:
    """``id, fp`` of each row, and ``keys``, its bands of min-hashes."""
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return docs.select(id_col, text_col).mapInArrow(_fingerprinting(link), T.StructType(fields))


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places the lowest label among them."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked: between the two tiles or, if ``right`` is empty, within ``left``.

    Both are cut into tiles of ascending bit counts; pairs of tiles too far apart in these are skipped.
    """
    alone = not len(right)
    left, right = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (left, left if alone else right))
    values = left if alone else np.concatenate([left, right])
    labels, shift = np.arange(len(values)), 0 if alone else len(left)
    ones = np.bitwise_count(right).astype(np.int64)
    firsts, lasts = ones[::PART], np.r_[ones[PART - 1 :: PART], ones[-1:]][: -(-len(ones) // PART)]
    for i in range(0, len(left), PART):
        a = left[i : i + PART]
        low, high = int(np.bitwise_count(a[0])) - radius, int(np.bitwise_count(a[-1])) + radius
        near = np.flatnonzero((lasts >= low) & (firsts <= high)) * PART
        for j in near[near >= i].tolist() if alone else near.tolist():
            b = right[j : j + PART]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if alone and i == j:
                x, y = x[x < y], y[x < y]
            _join(labels, x + i, y + j + shift)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return values[moved], values[labels[moved]]


def _comparing(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                left, right = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) if len(x) else np.zeros(0, np.uint64) for x in (a, b))
                u, v = forest(left, right, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return run


def cells(rows: DataFrame, link: Link = CLOSE) -> DataFrame:
    """``cell, fp``, once each: the cells of each fingerprint of ``rows`` (fp, and keys where there are bands of them)."""
    if link.bands:
        return rows.select("fp", F.explode("keys").alias("cell")).distinct()
    edges = [64 * i // (link.radius + 1) for i in range(link.radius + 2)]
    bands = [F.lit(i << 40) + F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return rows.select("fp").distinct().select("fp", F.explode(F.array(*bands)).alias("cell"))


def tiles(held: DataFrame) -> DataFrame:
    """``cell, tile, fps, low, high``: the blocks of each cell that has two fingerprints or more, and their bit counts.

    A cell that fits is one block, numbered -1; others have blocks of equal bit counts, in their order.
    """
    rows = cut(held.select("cell", "fp", F.bit_count("fp").alias("ones")))
    sizes = cut(rows.groupBy("cell", "ones").agg(F.count("*").alias("n")), few=True)
    whole = sizes.groupBy("cell").agg(F.sum("n").alias("of")).where("of > 1")
    sizes = sizes.join(whole, "cell")
    part = F.col("ones").cast("long") * (1 << 32) + F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / TILE))
    dealt = rows.join(sizes, ["cell", "ones"]).withColumn("tile", F.when(F.col("of") <= TILE, F.lit(-1)).otherwise(part))
    return cut(dealt.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps"), F.min("ones").alias("low"), F.max("ones").alias("high")), few=True)


def links(rows: DataFrame, link: Link = CLOSE) -> DataFrame:
    """``u, v``: edges that join all fingerprints of ``rows`` that share a cell and lie within the radius."""
    held = tiles(cells(rows, link))
    within = held.select("cell", "tile", F.lit(-2).cast("long").alias("other"), F.col("fps").alias("a"), F.array().cast("array<bigint>").alias("b"))
    several = held.where("tile >= 0")
    other = several.select(F.col("cell").alias("of"), F.col("tile").alias("other"), F.col("fps").alias("b"), F.col("low").alias("from"))
    near = (F.col("cell") == F.col("of")) & (F.col("tile") < F.col("other")) & (F.col("from") - F.col("high") <= link.radius)
    between = several.withColumnRenamed("fps", "a").join(other, near).select("cell", "tile", "other", "a", "b")
    pairs = cut(within.union(between))
    work = pairs.agg(F.sum(F.size("a") * F.greatest(F.size("a"), F.size("b")).cast("long"))).first()[0] or 0
    # Asked for by number, so that adaptive execution does not put small but long tasks together.
    least = rows.sparkSession.sparkContext.defaultParallelism
    pairs = pairs.repartition(max(least, -(-work // TASK_PAIRS)), "cell", "tile", "other")
    return pairs.select("a", "b").mapInArrow(_comparing(link.radius), "u long, v long")


def _grouped(rows: DataFrame, link: Link) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the rows' fingerprints: ``fp, first_id``; of the linked ones ``node, root``; and ``of, lowest``, the smallest id of each root."""
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("first_id")), few=True)
    stars = cut(components(links(rows, link)), few=True)
    named = stars.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "first_id")
    return distinct, stars, named.groupBy("root").agg(F.min("first_id").alias("lowest")).withColumnRenamed("root", "of")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: Link = CLOSE) -> DataFrame:
    """``id, fp, component_id`` of each row: the smallest id that links lead to."""
    rows = cut(fingerprints(docs, id_col, text_col, link))
    distinct, stars, lowest = _grouped(rows, link)
    linked = stars.join(lowest, F.col("root") == F.col("of")).select("node", "lowest")
    by_fp = distinct.join(linked, F.col("fp") == F.col("node"), "left")
    # Written apart, so that a hot fingerprint can be split where its documents meet it.
    by_fp = cut(by_fp.select(F.col("fp").alias("held"), F.coalesce("lowest", "first_id").alias("component_id")), few=True)
    return rows.join(by_fp, F.col("fp") == F.col("held")).select("id", "fp", "component_id")


def _marking(text_col: str, out_col: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, out_col])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: Link = CLOSE) -> DataFrame:
    """One row of ``docs`` of each component, of its smallest id, with all their columns.

    Where the ids of the rows that stay occur once each, ids alone find them; else fingerprints are made again beside
    whole rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, link))
    distinct, stars, _ = _grouped(rows, link)
    rooted = distinct.join(stars, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("of"))
    first = rooted.agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), "fp")).alias("x"))
    keep = cut(first.select(F.col("x.id").alias("keep_id"), F.col("x.fp").alias("keep_fp")), few=True)
    ids = keep.select("keep_id").distinct()
    if rows.join(ids, rows["id"].eqNullSafe(ids["keep_id"]), "left_semi").count() == keep.count():
        return docs.join(ids, docs[id_col].eqNullSafe(ids["keep_id"]), "left_semi")
    made = free_name("__fp", docs.columns)
    marked = docs.mapInArrow(_marking(text_col, made, link.words), T.StructType([*docs.schema.fields, T.StructField(made, T.LongType())]))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    held = marked.select(whole, F.col(id_col).alias("id"), F.col(made).alias("fp"))
    found = held.join(keep, (F.col("fp") == F.col("keep_fp")) & F.col("id").eqNullSafe(F.col("keep_id")))
    return found.groupBy("fp").agg(F.min_by("whole", F.to_json("whole")).alias("whole")).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
