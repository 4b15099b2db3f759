"""Near-dedup of similar texts: SimHash finds candidates, and a link counts only if the shingles themselves agree.

Texts are alike if their sets of shingles have a similarity (Jaccard) of ``Link.similarity`` or more. Candidates share a
cell, a band of two min-hashes of their shingles, and have fingerprints within the radius; these are compared in tiles by
exclusive-or and bit counts, tiles whose bit counts differ beyond the radius being skipped. What passes is checked against
the shingles of both texts, so no link is below the similarity. Texts with equal shingles are one node.

A cell's nodes are taken in order of their ids. A node is compared with the cell's leaders so far; it hangs on the first
that it is alike to, else it is a leader itself. So of two alike texts in one cell at most one leads, and one at least
hangs on a leader before it: work is linear in a group of near copies. A cell of any size is dealt to blocks of bounded
bytes; only their leaders meet again, in fewer blocks, and in pairs of blocks where hardly any hangs on another.

Cells miss few links, but some: of texts that share no cell, with fingerprints beyond the radius, or of a text that hangs on
one leader and is alike to another. So components of the stars are completed by an exact join. Of two alike sets, the first
elements in any common order share one (``front``); elements seen often in a sixteenth of the nodes come last in it, which
bears on work alone. Nodes of different components that share one are compared by size and by parities of their elements,
which give a least difference and drop no link: first by 256, which say little of large sets, then by about as many as the
sets have elements. Only what passes both is checked by the shingles, so that few of these move. Links within a component
are not sought, as they join nothing. The groups are the components of all links.

Hashes of shingles have 32 bits:
two sets of a thousand agree by chance in one element in some thousand pairs. Defined cases: null text counts as empty;
texts without words have one empty set and are one group; texts with fewer words than a shingle are one shingle. Null ids
are no smallest id, unless a group has no other; rows that repeat an id count each. One row of each group stays: of
several with its smallest id, or of null ids only, one of the least node, the first by its JSON text. Other columns play no
part else, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm import common
from tracewise.llm.batches import slices
from tracewise.llm.common import free_name
from tracewise.llm.components import components
from tracewise.llm.simhash import PART, band_keys, fingerprint, shingle_hashes


@dataclass(frozen=True)
class Link:
    """Words of a shingle, least similarity of linked texts, bits that their fingerprints may differ in, and bands of min-hashes."""

    words: int = 5
    similarity: float = 0.8
    radius: int = 20
    bands: int = 8


SIMILAR = Link()
#: Bytes of text handled at once; bytes of shingles in a block, about, and in a task.
SLICE_BYTES, BLOCK_BYTES, TASK_BYTES = 1_000_000, 32_000_000, 64_000_000
#: Blocks meet in pairs once more than this share of their nodes lead.
STALLED = 0.9
#: Bits of parities, nodes of a block that share an element, times an element is seen in the sample to come last, and how many do.
PARITIES, LIST_NODES, OFTEN, MOST_LAST = 256, 8192, 8, 1_000_000
#: Lists up to this length are paired many at once.
SHORT_LIST = 64
#: Shingles are moved by several joins, whose files must not add up.
cut = partial(common.cut, tidy=True)


def described(text: str | None, link: Link) -> tuple[bytes, int, np.ndarray, bytes]:
    """A text's node, fingerprint, cells and sorted set of shingles."""
    hashes = shingle_hashes(text, link.words)
    held = np.unique(hashes.astype(np.uint32)).astype("<u4").tobytes()
    return xxhash.xxh3_128_digest(held), fingerprint(hashes), band_keys(hashes, link.bands), held


def _describing(link: Link):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE_BYTES):
            node, fp, keys, held = zip(*(described(t, link) for t in texts), strict=True)
            columns = [pa.array(node, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "node", "fp", "keys", "shingles"])

    return run


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    # By whole numbers but for the bound, so that a similarity of just the bound counts.
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def stars(fps: np.ndarray, sets: list[np.ndarray], link: Link) -> np.ndarray:
    """Each place's leader: the first leader before it that it is alike to, or itself."""
    leader, ones = np.arange(len(fps)), np.bitwise_count(fps).astype(np.int64)
    leads = np.zeros(0, np.int64)
    for start in range(0, len(fps), PART):
        part = np.arange(start, min(start + PART, len(fps)))
        low, high = ones[part].min() - link.radius, ones[part].max() + link.radius
        near: list[list[int]] = [[] for _ in part]
        for at in range(0, len(leads), PART):
            tile = leads[at : at + PART]
            if ones[tile].max() < low or ones[tile].min() > high:
                continue
            for x, y in zip(*np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[tile][None, :]) <= link.radius), strict=True):
                near[x].append(int(tile[y]))
        new: list[int] = []
        own = np.bitwise_count(fps[part][:, None] ^ fps[part][None, :]) <= link.radius
        for x, i in enumerate(part.tolist()):
            found = next((j for j in (*near[x], *(j for j in new if own[x, j - start])) if alike(sets[j], sets[i], link.similarity)), i)
            leader[i] = found
            if found == i:
                new.append(i)
        leads = np.r_[leads, new].astype(np.int64)
    return leader


def _settling(link: Link):
    def settled(key, nodes: list[bytes], fps: list[int], sets: list[bytes]) -> pa.RecordBatch:
        leader = stars(np.array(fps, np.int64).view(np.uint64), [np.frombuffer(s, "<u4") for s in sets], link)
        columns = [pa.array([key[0]] * len(nodes), pa.int64()), pa.array(nodes, pa.binary()), pa.array([nodes[i] for i in leader], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["cell", "node", "leader"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("cell", "block", "node", "fp", "shingles"))
            for cell, block, *x in zip(*columns, strict=True):
                if key != (cell, block):
                    if held[0]:
                        yield settled(key, *held)
                    key, held = (cell, block), ([], [], [])
                for to, value in zip(held, x, strict=True):
                    to.append(value)
        if held[0]:
            yield settled(key, *held)

    return run


def _settle(dealt: DataFrame, held: DataFrame, link: Link) -> DataFrame:
    """``cell, node, leader`` of nodes dealt to blocks (cell, block, node, bytes); a task goes through its blocks one by one."""
    least = dealt.sparkSession.sparkContext.defaultParallelism
    work = dealt.agg(F.sum("bytes")).first()[0] or 0
    rows = dealt.drop("bytes").join(held, "node").repartition(max(least, -(-work // TASK_BYTES)), "cell", "block")
    rows = rows.sortWithinPartitions("cell", "block", F.asc_nulls_last("first_id"), "node").select("cell", "block", "node", "fp", "shingles")
    return cut(rows.mapInArrow(_settling(link), "cell long, node binary, leader binary"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """``cell, node, bytes`` plus ``blocks``, the number of blocks of the cell, and ``block``."""
    sizes = nodes.groupBy("cell").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks"))
    return nodes.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("string"))


def edges(rows: DataFrame, link: Link = SIMILAR) -> DataFrame:
    """``u, v``: links of nodes of ``rows`` (id, node, fp, keys, shingles) to leaders that they are alike to."""
    each = rows.select("node", F.explode("keys").alias("cell")).distinct()
    shared = each.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    each = cut(each.join(shared, "cell", "left_semi"), few=True)
    wanted = each.select("node").distinct()
    # Shingles of nodes that share a cell, once each.
    held = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("first_id"), F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))
    held = cut(held)
    nodes, found = each.join(held.select("node", F.octet_length("shingles").cast("long").alias("bytes")), "node").select("cell", "node", "bytes"), []
    while True:
        dealt = cut(_blocks(nodes), few=True)
        made = _settle(dealt.select("cell", "block", "node", "bytes"), held, link)
        found.append(made.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")))
        several = dealt.where("blocks > 1").select("cell", "node", "bytes")
        before = several.count()
        if not before:
            break
        nodes = cut(several.join(made.where("node = leader").select("cell", "node"), ["cell", "node"], "left_semi"), few=True)
        if nodes.count() > STALLED * before:
            # Leaders of a block are not alike; each block meets each other.
            # A cell that fits one block now, as its leaders came from several, meets itself.
            others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i.cast("string"))
            dealt = _blocks(nodes).withColumn("other", F.explode(others)).where("other <> block or blocks = 1")
            pair = F.concat_ws(":", F.least("block", "other"), F.greatest("block", "other"))
            made = _settle(cut(dealt.select("cell", pair.alias("block"), "node", "bytes"), few=True), held, link)
            found.append(made.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")))
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def front(held: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements of a sorted set, those of ``last`` (sorted) after the others; two alike sets share one of them."""
    if len(last):
        late = last[np.minimum(np.searchsorted(last, held), len(last) - 1)] == held
        held_in_order = np.r_[held[~late], held[late]]
    else:
        held_in_order = held
    return held_in_order[: len(held) - math.ceil(similarity * len(held) - 1e-9) + 1]


def parities(held: np.ndarray) -> bytes:
    """A bit for each class of elements: whether the set has an odd number of them. Two sets differ in as many at least as their bits do."""
    return np.packbits(np.bincount(held % PARITIES, minlength=PARITIES).astype(np.uint8) & 1).tobytes()


def sketch(held: np.ndarray) -> bytes:
    """Parities by as many classes as the set has elements, or up to twice as many: a power of two."""
    classes = max(8, 1 << (len(held) - 1).bit_length()) if len(held) else 8
    return np.packbits(np.bincount(held & np.uint32(classes - 1), minlength=classes).astype(np.uint8) & 1).tobytes()


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """In how many elements two sets differ at least, by the bytes of their sketches; the finer one is folded to the other's classes."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _fronts(link: Link, last):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s, "<u4") for s in batch.column("shingles").to_pylist()]
            fronts = pa.array([front(s, last.value, link.similarity).view(np.int32) for s in sets], pa.list_(pa.int32()))
            columns = [batch.column("node"), fronts, pa.array([len(s) for s in sets], pa.int32()), *(pa.array([f(s) for s in sets], pa.binary()) for f in (parities, sketch))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "front", "size", "bits", "sketch"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [np.frombuffer(s, "<i4") for s in batch.column("shingles").to_pylist()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held), pa.int32())], names=["element"])


def near_pairs(size: np.ndarray, bits: np.ndarray, group: np.ndarray, other: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different groups whose sizes and parities allow the similarity; where others matter, of different ones of these.

    Places stand in the order of their sizes.
    """
    ratio, across = (1 - similarity) / (1 + similarity), len(np.unique(other)) > 1
    for start in range(0, len(size), PART):
        part = np.arange(start, min(start + PART, len(size)))
        most = np.searchsorted(size, size[part[-1]] / max(similarity, 1e-9) + 1e-6, side="right")
        for at in range(start, int(most), PART):
            tile = np.arange(at, min(at + PART, int(most)))
            wanted = (group[part][:, None] != group[tile][None, :]) & (part[:, None] < tile[None, :])
            if across:
                wanted &= other[part][:, None] != other[tile][None, :]
            x, y = np.nonzero(wanted & (size[part][:, None] >= similarity * size[tile][None, :] - 1e-6))
            for few in range(0, len(x), 1 << 16):
                a, b = part[x[few : few + (1 << 16)]], tile[y[few : few + (1 << 16)]]
                differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
                good = differ <= ratio * (size[a].astype(np.int64) + size[b]) + 1e-6
                yield a[good], b[good]


def _short_pairs(ends: np.ndarray, size: np.ndarray, bits: np.ndarray, group: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of many short lists, one after another; ``ends`` has each place's end of its list."""
    ratio, left = (1 - similarity) / (1 + similarity), np.arange(len(size))
    for step in range(1, SHORT_LIST):
        left = left[left + step < ends[left]]
        if not len(left):
            return
        a, b = left, left + step
        fit = (group[a] != group[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6)
        a, b = a[fit], b[fit]
        good = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64) <= ratio * (size[a] + size[b]) + 1e-6
        yield a[good], b[good]


def _pairing(link: Link):
    def paired(element, block, node, size, bits, group) -> Iterator[pa.RecordBatch]:
        size, firsts = size.astype(np.int64), np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
        lasts = np.r_[firsts[1:], len(element)]
        ends, found = np.repeat(lasts, lasts - firsts), []
        short = np.repeat(lasts - firsts <= SHORT_LIST, lasts - firsts)
        at = np.flatnonzero(short)
        # Places among short lists only, and where their lists end there.
        found += [(at[a], at[b]) for a, b in _short_pairs(np.cumsum(short)[ends - 1][at], size[at], bits[at], group[at], link.similarity)]
        for first, last in zip(firsts, lasts, strict=True):
            if last - first > SHORT_LIST:
                order = first + np.argsort(size[first:last], kind="stable")
                found += [(order[a], order[b]) for a, b in near_pairs(size[order], bits[order], group[order], block[order], link.similarity)]
        if found:
            u, v = (node[np.concatenate([pair[i] for pair in found])] for i in range(2))
            seen = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(seen[0], pa.int64()), pa.array(seen[1], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of a batch at once; the last one waits for what follows, as it may go on."""
        held = None
        for batch in batches:
            if not len(batch):
                continue
            element = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("element", "low", "high")])
            own = [batch.column(c).to_numpy() for c in ("block", "node", "size")]
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(len(batch), -1)
            now = [element.T, *own, bits, batch.column("group").to_numpy()]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            done = int(np.flatnonzero((held[0] != held[0][-1]).any(1)).max(initial=-1)) + 1
            if done:
                yield from paired(_numbered(held[0][:done]), *(x[:done] for x in held[1:]))
                held = [x[done:] for x in held]
        if held is not None:
            yield from paired(_numbered(held[0]), *held[1:])

    return run


def _numbered(keys: np.ndarray) -> np.ndarray:
    """A number of each run of equal rows."""
    return np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(1)])


def _sifting(link: Link):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of nodes whose sketches allow the similarity."""
        ratio = (1 - link.similarity) / (1 + link.similarity)
        for batch in batches:
            most = ratio * (batch.column("size_u").to_numpy().astype(np.int64) + batch.column("size_v").to_numpy()) + 1e-6
            sketches = ([np.frombuffer(s, np.uint8) for s in batch.column(c).to_pylist()] for c in ("sketch_u", "sketch_v"))
            good = [least_difference(a, b) <= x for a, b, x in zip(*sketches, most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("of_u"), batch.column("of_v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _checking(link: Link):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(s, "<u4") for s in batch.column(c).to_pylist()] for c in ("of_u", "of_v"))
            good = pa.array([alike(a, b, link.similarity) for a, b in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(good)

    return run


def missing(rows: DataFrame, groups: DataFrame, link: Link = SIMILAR) -> DataFrame:
    """``u, v``: all links of nodes of ``rows`` (node, shingles) between different ``groups`` (of, root) of them.

    Nodes that are in no row of ``groups`` are groups of their own. Only the elements that come last go to the driver.
    """
    context = rows.sparkSession.sparkContext
    sample = rows.where(F.substring("node", 1, 1) < F.unhex(F.lit("10"))).dropDuplicates(["node"]).select("shingles")
    often = sample.mapInArrow(_elements, "element int").groupBy("element").count().where(F.col("count") >= OFTEN)
    last = context.broadcast(np.sort(np.array([r.element for r in often.orderBy(F.desc("count"), "element").limit(MOST_LAST).collect()], np.int32).view(np.uint32)))
    fronts = cut(rows.select("node", "shingles").mapInArrow(_fronts(link, last), "node binary, front array<int>, size int, bits binary, sketch binary"))
    # Elements of one node only are most of them: they go before anything else is looked up. Keys of nodes and groups are hashes of 64 bits.
    each, own = fronts.select(F.explode("front").alias("element"), F.xxhash64("node").alias("key")), Window.partitionBy("element")
    shared = each.withColumns({"first": F.min("key").over(own), "last": F.max("key").over(own)}).where("first <> last").select("element", "key").distinct()
    nodes = fronts.dropDuplicates(["node"]).join(groups, F.col("node") == F.col("of"), "left")
    held = cut(nodes.select(F.xxhash64("node").alias("key"), "node", "size", "bits", "sketch", F.xxhash64(F.coalesce("root", "node")).alias("group")), few=True)
    lists = shared.join(held.select("key", "size", "bits", "group"), "key").select("element", F.col("key").alias("node"), "size", "bits", "group")
    lists = lists.withColumns({"first": F.min("group").over(own), "last": F.max("group").over(own), "blocks": F.ceil(F.count("*").over(own) / LIST_NODES).cast("int")})
    lists = cut(lists.where("first <> last").drop("first", "last"))
    zero, columns = F.lit(0), ["element", "low", "high", "block", "node", "size", "bits", "group"]
    one = lists.where("blocks = 1").withColumns({"low": zero, "high": zero, "block": zero}).sortWithinPartitions("element").select(*columns)
    # Each block of a longer list meets each other and itself.
    dealt = lists.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).select(*columns)
    dealt = dealt.repartition("element", "low", "high").sortWithinPartitions("element", "low", "high")
    found = one.mapInArrow(_pairing(link), "u long, v long").union(dealt.mapInArrow(_pairing(link), "u long, v long"))
    found, pairs = cut(found.distinct(), few=True), None
    for end in "uv":
        named = held.select(F.col("key").alias(end), F.col("node").alias(f"of_{end}"), F.col("size").alias(f"size_{end}"), F.col("sketch").alias(f"sketch_{end}"))
        pairs = (found if pairs is None else pairs).join(named, end)
    pairs = cut(pairs.drop("u", "v").mapInArrow(_sifting(link), "u binary, v binary"), few=True)
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = cut(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("of_u")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("of_v")), "v")
    return cut(both.mapInArrow(_checking(link), "u binary, v binary"), few=True)


def _marking(text_col: str, out_col: str, link: Link):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col, SLICE_BYTES):
            made = pa.array([described(t, link)[0] for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out_col])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: Link = SIMILAR) -> DataFrame:
    """One row of ``docs`` of each group of alike texts, of its smallest id, with all their columns.

    Where the ids of the rows that stay occur once each, ids alone find them; else nodes are made again beside whole rows.
    """
    long = lambda n: T.StructField(n, T.LongType())
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("node", T.BinaryType()), long("fp"), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("shingles", T.BinaryType())]
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_describing(link), T.StructType(fields)))
    firsts = cut(rows.groupBy("node").agg(F.min("id").alias("first_id")), few=True)
    found = cut(edges(rows, link), few=True)
    groups = cut(components(found).withColumnRenamed("node", "of"), few=True)
    more = missing(rows, groups, link)
    if not more.isEmpty():
        groups = cut(components(found.union(more)).withColumnRenamed("node", "of"), few=True)
    rooted = firsts.join(groups, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node").alias("of"))
    first = rooted.agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), "node")).alias("x"))
    keep = cut(first.select(F.col("x.id").alias("keep_id"), F.col("x.node").alias("keep_node")), few=True)
    ids = keep.select("keep_id").distinct()
    if rows.join(ids, rows["id"].eqNullSafe(ids["keep_id"]), "left_semi").count() == keep.count():
        return docs.join(ids, docs[id_col].eqNullSafe(ids["keep_id"]), "left_semi")
    made = free_name("__node", docs.columns)
    marked = docs.mapInArrow(_marking(text_col, made, link), T.StructType([*docs.schema.fields, T.StructField(made, T.BinaryType())]))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    held = marked.select(whole, F.col(id_col).alias("id"), F.col(made).alias("node"))
    stays = held.join(keep, (F.col("node") == F.col("keep_node")) & F.col("id").eqNullSafe(F.col("keep_id")))
    return stays.groupBy("node").agg(F.min_by("whole", F.to_json("whole")).alias("whole")).select("whole.*")
