"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch's distinct new words lie in one flat symbol array. Each round looks up the rank of changed neighbour pairs by
binary search over the sorted pair keys, takes the lowest rank of each word, and merges that pair wherever the word has
it; words without a known pair are done. Encoded words are kept, up to a bound, for later batches of the task.

Defined cases: null text counts as empty; empty text has no tokens. The special token's string in a text becomes the
special token, as in the tokenizers library. Other columns pass through, but for ones named as an output, which gives way; rows are independent, so repeated rows, null
ids and empty tables need no care. Texts are encoded whole, whatever their length; what is held at once is one text or
``SLICE_BYTES`` of several, and their words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.batches import slices
from tracewise.llm.common import table

#: Bytes of text that are encoded together.
SLICE_BYTES = 1_000_000
#: Distinct words kept by a task before it starts its store afresh.
KEPT_WORDS = 300_000
NO_RANK = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Tables of a byte-level BPE file; their size is that of the vocabulary."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    token_bytes: np.ndarray
    token_starts: np.ndarray
    special: dict[str, int]
    base: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        base = max([*ids.values(), *special.values()]) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([ids[a] * base + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        of_letter = {letter: byte for byte, letter in enumerate(byte_letters())}
        content = [b""] * base
        for token, i in ids.items():
            content[i] = bytes(of_letter[c] for c in token)
        for token, i in special.items():
            content[i] = token.encode()
        return Vocabulary(
            byte_ids=np.array([ids[c] for c in byte_letters()], np.int64),
            pair_keys=keys[order],
            pair_ranks=order.astype(np.int64),
            pair_ids=np.array([ids[a + b] for a, b in pairs], np.int64)[order],
            token_bytes=np.frombuffer(b"".join(content), np.uint8),
            token_starts=np.cumsum([0, *map(len, content)]),
            special=special,
            base=base,
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; ``NO_RANK`` where the pair is not in the table."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK), self.pair_ids[at]


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after the other, and each word's number of ids."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbol = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    rank, merged = np.full(len(symbol), NO_RANK), np.zeros(len(symbol), np.int64)
    fresh = np.flatnonzero(word[:-1] == word[1:])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        rank[fresh], merged[fresh] = vocab.ranks(symbol[fresh], symbol[fresh + 1])
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
        going = lowest < NO_RANK
        if not going.all():
            done.append((word[~going], symbol[~going]))
            symbol, word, rank, merged, lowest = (x[going] for x in (symbol, word, rank, merged, lowest))
            if not len(symbol):
                break
        hit = rank == lowest
        # Equal symbols in a row overlap: of a run of hits every second one is merged.
        place = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
        hit &= (place - run) % 2 == 0
        stays = ~np.r_[False, hit[:-1]]
        symbol[hit] = merged[hit]
        rank[hit] = NO_RANK
        changed = hit | np.r_[hit[1:], False]
        symbol, word, rank, merged, changed = (x[stays] for x in (symbol, word, rank, merged, changed))
        # A pair is looked up anew if either of its symbols was merged just now.
        near = changed[:-1] | changed[1:]
        inside = word[:-1] == word[1:]
        rank[:-1][near & ~inside] = NO_RANK
        fresh = np.flatnonzero(near & inside)
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return symbol[order], np.bincount(word, minlength=len(words))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + sizes[i] - 1`` of all i, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class WordStore(dict):
    """Numbers words as they first come and holds the ids of those that are encoded."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.waiting: list[str] = []
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        special = sorted(vocab.special.values())
        for i in special:
            self[i] = len(self)
        self._add(np.array(special, np.int64), np.ones(len(special), np.int64))

    def __missing__(self, word: str) -> int:
        self.waiting.append(word)
        self[word] = number = len(self)
        return number

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, ids.astype(np.int32)]

    def encode(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and each piece's number of ids."""
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.waiting:
            self._add(*merge_words([w.encode() for w in self.waiting], self.vocab))
            self.waiting = []
        sizes = self.sizes[numbers]
        return self.flat[ragged(self.starts[numbers], sizes)], sizes


class Encoder:
    """Texts to ids, keeping encoded words between calls."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.store = vocab, WordStore(vocab)
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")") if vocab.special else None

    def pieces(self, text: str) -> list:
        """The words of a text; a special token comes as its id."""
        if not any(s in text for s in self.vocab.special):
            return self.words(text)
        out: list = []
        for part in self.specials.split(text):
            out += [self.vocab.special[part]] if part in self.vocab.special else self.words(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and each text's number of ids."""
        if len(self.store) > KEPT_WORDS:
            self.store = WordStore(self.vocab)
        split = [self.pieces(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        ids, sizes = self.store.encode([p for s in split for p in s])
        before = np.r_[0, np.cumsum(sizes)]
        ends = np.cumsum(counts)
        return ids, before[ends] - before[ends - counts]


def decode_ids(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> list[str]:
    """The texts of runs of ids; bytes that are not UTF-8 become U+FFFD."""
    sizes = vocab.token_starts[ids + 1] - vocab.token_starts[ids]
    content = vocab.token_bytes[ragged(vocab.token_starts[ids], sizes)].tobytes()
    at = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
    return [content[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.r_[0, np.cumsum(counts) * 4].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])


def _encoding(vocab, text_col: str, out_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        for batch, texts in slices(batches, text_col, SLICE_BYTES):
            yield _with(batch, out_col, _packed(*encoder.encode([t or "" for t in texts])))

    return run


def _decoding(vocab, ids_col: str, out_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x or b"" for x in batch.column(ids_col).to_pylist()]
            counts = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
            yield _with(batch, out_col, pa.array(decode_ids(ids, counts, vocab.value), pa.string()))

    return run


def _plus(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` plus the ids of each text, packed as little-endian unsigned 32-bit integers.

    The vocabulary's tables, of fixed size, are read on the driver and broadcast.
    """
    vocab, docs = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab_path)), docs.drop(out_col)
    return docs.mapInArrow(_encoding(vocab, text_col, out_col), _plus(docs, T.StructField(out_col, T.BinaryType())))


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` plus the text of each row's packed ids; null ids give empty text."""
    vocab, encoded = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab_path)), encoded.drop(out_col)
    return encoded.mapInArrow(_decoding(vocab, ids_col, out_col), _plus(encoded, T.StructField(out_col, T.StringType())))


def round_trip(docs: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``ids`` and ``decoded``, encoded and decoded in one worker."""
    vocab, docs = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocab_path)), docs.drop("ids", "decoded")
    encoding, decoding = _encoding(vocab, text_col, "ids"), _decoding(vocab, "ids", "decoded")
    fields = T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())
    return docs.mapInArrow(lambda batches: decoding(encoding(batches)), _plus(docs, *fields))


def digests(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    coded = round_trip(docs.select("doc_id", "text"), vocab_path or public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
