"""Harmonic packing of documents into training sequences, each worker on its own.

A document is its token ids and an end. Lengths are parted into classes by reciprocals of the capacity: class k holds
lengths above capacity / (k + 1), up to capacity / k, and a sequence of class k takes k pieces, a fixed number. Documents
may be cut, so that few classes leave room: a document gives whole sequences first; of what is left, as long as it is above
``capacity / FREE``, a piece of just the length of its class is cut off, capacity // k; the rest, short by then, lies in a
class of many pieces, which leave less than one part in ``FREE`` of a sequence empty. A document of any length has a few
pieces more than its length over the capacity.

Workers fill the sequences of their own partitions, without a shuffle and whatever the other rows hold, so no key can be
hot. The pieces left in open sequences at the end, fewer than k for each class k, are laid end to end and cut at the
capacity; the last of these sequences, if not full, is cut into ones whose lengths are powers of two, which need no
padding. A sequence's number has its partition's above 33 bits; a partition that is done again numbers it alike.

Ids are those of the tokenizers library, made by tiktoken from the same vocabulary file, which is several times as fast:
the file's ids ascend with the ranks of its merges, so they are what tiktoken merges by. Defined cases: null text counts
as empty, which is the end alone; repeated rows, null ids and ids of any type are packed row by row; other columns play no
part, whatever their names; an empty table gives no sequence. Texts are encoded whole; a task holds one text's ids, or
those of ``SLICE_BYTES`` of texts, and one open sequence for each class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.batches import slices
from tracewise.llm.bpe import Vocabulary
from tracewise.llm.common import table

CAPACITY, END, PAD = 1024, 0, 0
#: Rests of up to capacity / FREE are not cut further: their classes waste less than this part.
FREE = 16
#: Bytes of text encoded at once, and sequences sent on at once.
SLICE_BYTES, SEQUENCES = 1_000_000, 256


def encoding(vocab: Vocabulary) -> tiktoken.Encoding:
    """An encoder for the vocabulary; its special tokens stand for their strings."""
    if (np.diff(vocab.pair_ids[np.argsort(vocab.pair_ranks)]) <= 0).any() or vocab.byte_ids.max() > vocab.pair_ids.min():
        raise ValueError("the vocabulary's ids do not ascend with the ranks of its merges")
    content, special = vocab.token_bytes.tobytes(), set(vocab.special.values())
    ranks = {content[a:b]: i for i, (a, b) in enumerate(zip(vocab.token_starts, vocab.token_starts[1:], strict=False)) if i not in special and a < b}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=vocab.special)


def cuts(length: int, capacity: int = CAPACITY, free: int = FREE) -> list[int]:
    """Lengths of the pieces that a document of ``length`` ids is cut into, longest first."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest * free > capacity:
        # The largest of the lengths capacity // k that fits.
        piece = capacity // (capacity // (rest + 1) + 1)
        out.append(piece)
        rest -= piece
    return [*out, rest] if rest else out


def powers(n: int) -> list[int]:
    """The powers of two that add up to ``n``, the largest first."""
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


@dataclass
class Piece:
    """Ids of a document from a place on."""

    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int


class Packer:
    """Fills sequences with pieces."""

    def __init__(self, capacity: int, free: int):
        self.capacity, self.free = capacity, free
        self.open: dict[int, list[Piece]] = {}
        #: How rests shorter than the capacity are cut, as they come up.
        self.rests: dict[int, list[int]] = {}

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        """The sequences that a document's pieces complete."""
        whole, rest = divmod(len(ids), self.capacity)
        if rest not in self.rests:
            self.rests[rest] = cuts(rest, self.capacity, self.free)
        at = 0
        for size in [self.capacity] * whole + self.rests[rest]:
            # A copy, so that a long document's ids do not stay for one piece.
            piece, at = Piece(doc, at, ids[at : at + size].copy(), len(ids)), at + size
            k = self.capacity // size
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                yield self.open.pop(k)

    def close(self) -> Iterator[list[Piece]]:
        """Sequences of the pieces that are left, cut where a sequence ends."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        whole, rest = divmod(sum(len(p.ids) for p in left), self.capacity)
        sizes = [self.capacity] * whole + powers(rest)
        i = at = 0
        for size in sizes:
            sequence, room = [], size
            while room:
                p = left[i]
                taken = p.ids[at : at + room]
                sequence.append(Piece(p.doc, p.start + at, taken, p.doc_tokens))
                room, at = room - len(taken), at + len(taken)
                if at == len(p.ids):
                    i, at = i + 1, 0
            yield sequence


def padded(n: int, capacity: int) -> int:
    """Length of a sequence with ``n`` ids: a power of two stays, others are padded to the capacity."""
    return n if n & (n - 1) == 0 else capacity


def _batch(sequences: list[list[Piece]], first: int, capacity: int, pad: int, schema: pa.Schema) -> pa.RecordBatch:
    ids, sizes, flat = [], [], [p for s in sequences for p in s]
    for s in sequences:
        held = np.concatenate([p.ids for p in s])
        sizes.append(len(held))
        ids.append(np.pad(held, (0, padded(len(held), capacity) - len(held)), constant_values=pad).astype("<u4").tobytes())
    counts = np.fromiter(map(len, sequences), np.int64, len(sequences))
    lengths = np.fromiter((len(p.ids) for p in flat), np.int64, len(flat))
    # A piece begins where those before it in its sequence end.
    ends, firsts = np.cumsum(lengths), np.cumsum(counts) - counts
    offsets = ends - lengths - np.repeat((ends - lengths)[firsts], counts)
    of = schema.field("pieces").type.value_type
    column = lambda name, values: pa.array(values, of.field(name).type)
    struct = pa.StructArray.from_arrays(
        [column("doc", [p.doc for p in flat]), column("start", [p.start for p in flat]), column("length", lengths), column("offset", offsets), column("doc_tokens", [p.doc_tokens for p in flat])], fields=list(of)
    )
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), struct)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(sequences)), pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), lists.cast(schema.field("pieces").type)], schema=schema)


def _packing(vocab, capacity: int, free: int, end: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, number = encoding(vocab.value), Packer(capacity, free), TaskContext.get().partitionId() << 33
        waiting: list[list[Piece]] = []
        id_type = None
        for batch, texts in slices(batches, "text", SLICE_BYTES):
            id_type = batch.schema.field("doc").type
            for doc, text in zip(batch.column("doc").to_pylist(), texts, strict=True):
                ids = np.r_[encoder.encode_to_numpy(text or "", allowed_special="all"), np.uint32(end)]
                for sequence in packer.add(doc, ids):
                    waiting.append(sequence)
                    if len(waiting) == SEQUENCES:
                        yield _batch(waiting, number, capacity, pad, _schema(id_type))
                        number, waiting = number + len(waiting), []
        waiting += packer.close()
        for i in range(0, len(waiting), SEQUENCES):
            yield _batch(waiting[i : i + SEQUENCES], number + i, capacity, pad, _schema(id_type))

    return run


def _schema(id_type: pa.DataType) -> pa.Schema:
    piece = pa.struct([("doc", id_type), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())])
    return pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("pieces", pa.list_(piece))])


def pack(
    docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, free: int = FREE, end: int = END, pad: int = PAD
) -> DataFrame:
    """One row per sequence: ``sequence_id, ids, n_tokens, pieces``.

    ``ids`` are packed as little-endian unsigned 32-bit integers, padded; ``n_tokens`` of them are not padding. ``pieces``
    says what they are, in order: ``doc, start, length, offset, doc_tokens``.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab_path or public_tokenizers.path("byte_bpe_50k.json")))
    long = lambda n: T.StructField(n, T.LongType())
    piece = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), long("start"), long("length"), long("offset"), long("doc_tokens")])
    fields = [long("sequence_id"), T.StructField("ids", T.BinaryType()), long("n_tokens"), T.StructField("pieces", T.ArrayType(piece))]
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packing(vocab, capacity, free, end, pad), T.StructType(fields))


def pieces(packed: DataFrame) -> DataFrame:
    """One row per piece: ``doc, start, length, ids, doc_tokens, sequence_id, offset``."""
    each = packed.select("sequence_id", F.col("ids").alias("all"), F.inline("pieces"))
    own = F.substring("all", (F.col("offset") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return each.select("doc", "start", "length", own.alias("ids"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(pack(table(spark, sf_dir, "documents")))
    return found.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
