"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for each piece of the vocabulary. A word's probability is the sum over all ways to cut it
into pieces, by the forward algorithm; a text's is the product over its words. The piece probabilities are learned by
expectation maximisation, where a backward pass gives each piece's expected count. Words are lower-cased runs of letters
of any length with a mark at the front. A pass over a word holds the sums of as many places as the longest piece has
characters, scaled up whenever they grow small. Tasks keep the scores of words they have seen, up to a bound.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned;
ties go to the first language by name; characters outside the vocabulary count alike for all languages. Rows with a null
language don't teach; rows that repeat id, text and language teach once, and are scored each; other columns pass through,
whatever their names, but for ones named as an output, which give way. A null id counts as empty text in the choice of
rows, where the text parts rows of one id; of each language at least one row teaches. Whole texts are scored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.batches import slices
from tracewise.llm.common import cut, free_name, table

UND = "und"
#: Labelled documents per language that teach, about: those whose id and text hash lowest. A bound on training, not on scoring.
TEACHERS = 1000
ROUNDS, SMOOTHING, UNKNOWN = 2, 0.05, 1e-7
#: Sums below ``SMALL`` are multiplied by its inverse; far from both ends of what a double holds.
SMALL = 1e-100
#: Words that a task keeps, bytes of text that it handles at once, and letters times languages of the words that one pass goes over.
KEPT_WORDS, SLICE_BYTES, PASS_SUMS = 400_000, 1_000_000, 1_000_000
MARK = "▁"
_WORDS = re.compile(r"[^\W\d_]+").findall
_GAP = re.compile(r"\s").search
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The file's pieces that are lower-case letters, with or without the mark of a word's front."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in pieces if p == MARK or (b := p.removeprefix(MARK)).isalpha() and b == b.lower()]


def _hashes(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        h = 0
        for c in text:
            h = (h * int(_FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


class Pieces:
    """Finds pieces in words by rolling hashes; a small table of bits turns most other substrings away."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        hashes = _hashes(pieces)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.count = hashes[order], order, len(pieces)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self._short(hashes)] = True

    @staticmethod
    def _short(hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and piece of each occurrence, by end and length; and the words' sizes. Unknown characters have piece ``count``."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        word = np.repeat(np.arange(len(words)), sizes)
        start = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - start
        at, rolled, out = np.arange(len(points)), np.zeros(len(points), np.uint64), []
        for size in range(1, self.longest + 1):
            inside = left[at] >= size
            at, rolled = at[inside], rolled[inside]
            if not len(at):
                break
            rolled = rolled * _FACTOR + points[at + size - 1] + np.uint64(1)
            near = self.bits[self._short(rolled)]
            some, held = at[near], rolled[near]
            place = np.minimum(np.searchsorted(self.hashes, held), self.count - 1)
            good = self.hashes[place] == held
            known, ids = some[good], self.ids[place[good]]
            out.append((word[known], start[known], start[known] + size, ids))
            if size == 1:
                other = np.ones(len(points), bool)
                other[known] = False
                other = np.flatnonzero(other)
                out.append((word[other], start[other], start[other] + 1, np.full(len(other), self.count)))
        word, start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else [[]] * 4))
        order = np.lexsort((end - start, end))
        return word[order], start[order], end[order], piece[order], sizes


@dataclass
class Model:
    """Piece probabilities, one column per language, and one more row for characters outside the vocabulary."""

    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Fronts of the runs of equal keys, and the end of the last."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]), True])


def _sweep(word: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, count: int, probabilities: np.ndarray, visit=None) -> np.ndarray:
    """The log of the sum over all segmentations of each word and language, (word, language).

    Pieces come by end, then word. ``visit(word, place, sums, logs)`` is shown the sums at every place: their logs are
    ``log(sums) + logs``.
    """
    ring = int((end - start).max(initial=1)) + 1
    sums = np.zeros((ring, count, probabilities.shape[1]))
    sums[0] = 1.0
    logs, last = np.zeros(sums.shape[1:]), np.zeros(count, np.int64)
    part = _groups(end, word)
    steps = _groups(end[part[:-1]])
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
        held, x, y = part[a:b], part[a], part[b]
        own, place = word[held], int(end[x])
        new = np.add.reduceat(sums[start[x:y] % ring, word[x:y]] * probabilities[piece[x:y]], held - x, axis=0)
        sums[place % ring, own] = new
        last[own] = place
        if new.min() < SMALL:
            w, k = np.nonzero(new < SMALL)
            sums[:, own[w], k] /= SMALL
            logs[own[w], k] += np.log(SMALL)
        if visit is not None:
            visit(own, place, sums[place % ring, own], logs[own])
    return np.log(sums[last % ring, np.arange(count)]) + logs


def forward(found: tuple, probabilities: np.ndarray) -> np.ndarray:
    """The log-probability of each word in each language, summed over all its segmentations."""
    word, start, end, piece, sizes = found
    order = np.lexsort((word, end))
    return _sweep(word[order], start[order], end[order], piece[order], len(sizes), probabilities)


def expected(found: tuple, probabilities: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each piece's expected count over the words, for one language, weighted by the words' numbers."""
    word, start, end, piece, sizes = found
    offset = np.cumsum(sizes + 1) - sizes - 1
    before, after = np.zeros(int((sizes + 1).sum())), np.zeros(int((sizes + 1).sum()))
    p = probabilities[:, None]

    def ahead(own, place, sums, logs):
        before[offset[own] + place] = np.log(sums[:, 0]) + logs[:, 0]

    def back(own, place, sums, logs):
        after[offset[own] + sizes[own] - place] = np.log(sums[:, 0]) + logs[:, 0]

    order = np.lexsort((word, end))
    whole = _sweep(word[order], start[order], end[order], piece[order], len(sizes), p, ahead)[:, 0]
    # The same from behind: places count from the word's end.
    left, right = sizes[word] - end, sizes[word] - start
    order = np.lexsort((word, right))
    _sweep(word[order], left[order], right[order], piece[order], len(sizes), p, back)
    share = np.exp(before[offset[word] + start] + np.log(probabilities[piece]) + after[offset[word] + end] - whole[word]) * weights[word]
    return np.bincount(piece, share, len(probabilities))


def passes(words: list[str], languages: int) -> Iterator[tuple[int, int]]:
    """Ranges of words that hold one word, or several within the bound of a pass."""
    most = PASS_SUMS // max(4, languages)
    ends, first = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), 0
    while first < len(words):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, last
        first = last


def parts(text: str) -> Iterator[str]:
    """The text in parts of ``SLICE_BYTES`` characters or a little more, cut before white space, which is in no word."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut_at = _GAP(text, at + SLICE_BYTES)
        if not cut_at:
            break
        yield text[at : cut_at.start()]
        at = cut_at.start()
    yield text[at:]


def words_of(text: str) -> list[str]:
    """The text's words as they are scored."""
    return [MARK + w for w in _WORDS(text.lower())]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text", SLICE_BYTES):
        seen: Counter = Counter()
        for language, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            for part in parts(text or ""):
                seen.update((language, w) for w in words_of(part))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "word", "n"])


def _expecting(pieces: list[str], languages: list[str], probabilities):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, number = Pieces(pieces), {x: i for i, x in enumerate(languages)}
        for batch in batches:
            of = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for i in np.unique(of):
                own = np.array(sorted(np.flatnonzero(of == i), key=lambda j: len(words[j])), np.int64)
                for a, b in passes([words[j] for j in own], 1):
                    part = own[a:b]
                    found = finder.hits([words[j] for j in part])
                    if probabilities is None:
                        counts = np.bincount(found[3], n[part][found[0]], len(pieces) + 1)
                    else:
                        counts = expected(found, probabilities.value[:, i], n[part])
                    held = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), i, np.int32)), pa.array(held.astype(np.int32)), pa.array(counts[held])], names=["lang", "piece", "n"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(
    docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", teachers: int = TEACHERS, most_languages: int | None = None
) -> Model:
    """A model learned from rows that are not held out and have a language and a text.

    Word counts and expected counts are made on the executors; the driver gets a number per language and piece, and so do
    the tasks that score: about 0.2 MB a language. All languages are learned, unless ``most_languages`` bounds them to
    those with the most rows.
    """
    pieces = vocabulary(vocab_path or public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
    # Hashes are spread evenly, so a share of their range holds about so many distinct rows of each language.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("h").alias("different"), F.min("h").alias("least"))
    sizes = sizes.orderBy(F.desc("count"), "lang")
    sizes = (sizes if most_languages is None else sizes.limit(most_languages)).collect()
    if not sizes:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)))
    share = {r["lang"]: int(-(2**63) + 2**64 * min(1.0, teachers / max(r["different"], 1))) - 1 for r in sizes}
    limits = [(r["lang"], max(share[r["lang"]], r["least"])) for r in sizes]
    # One number per language; with it the scan itself picks the teachers.
    limit = F.create_map(*[F.lit(x) for pair in limits for x in pair])
    chosen = rows.where(F.col("h") <= limit[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
    counts = cut(chosen.mapInArrow(_counting, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), few=True)
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    probabilities = None
    for _ in range(ROUNDS + 1):
        shared = probabilities if probabilities is None else docs.sparkSession.sparkContext.broadcast(probabilities)
        sums = counts.mapInArrow(_expecting(pieces, languages, shared), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        table_ = np.full((len(pieces) + 1, len(languages)), SMOOTHING)
        table_[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
        table_[-1] = 0.0
        probabilities = table_ / np.maximum(table_.sum(0), 1e-300)
        probabilities[-1] = UNKNOWN
    return Model(languages, pieces, probabilities)


class Scorer:
    """Scores texts by a model, keeping the scores of words."""

    def __init__(self, model: Model):
        self.model, self.finder = model, Pieces(model.pieces)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, bool)

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.model.languages)))
        for a, b in passes(words, len(self.model.languages)):
            out[a:b] = forward(self.finder.hits(words[a:b]), self.model.probabilities)
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and the language's probability. Of long texts a part is split into words at a time."""
        if not self.model.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        total, lettered = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), bool)
        waiting, size = [], 0
        for i, text in enumerate(texts):
            for part in parts(text or ""):
                waiting.append((i, part))
                size += len(part)
                if size > SLICE_BYTES:
                    self._add(waiting, total, lettered)
                    waiting, size = [], 0
        self._add(waiting, total, lettered)
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        names = [self.model.languages[b] if ok else UND for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, share, 0.0)

    def _add(self, pieces: list[tuple[int, str]], total: np.ndarray, lettered: np.ndarray) -> None:
        """Add the words of parts of texts to their texts' scores."""
        if len(self.numbers) > KEPT_WORDS:
            self._clear()
        split = [_WORDS(t.lower()) for _, t in pieces]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = [w for s in split for w in s]
        new = list(set(flat).difference(self.numbers))
        if new:
            new.sort(key=len)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.words([MARK + w for w in new])])
            self.letters = np.r_[self.letters, np.array([any(map(str.isalpha, w)) for w in new])]
        some = np.flatnonzero(counts)
        if len(some):
            numbers = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
            first = (np.cumsum(counts) - counts)[some]
            of = np.array([i for i, _ in pieces], np.int64)[some]
            np.add.at(total, of, np.add.reduceat(self.scores[numbers], first, axis=0))
            np.logical_or.at(lettered, of, np.logical_or.reduceat(self.letters[numbers], first))


#: The scorer of the last model that this worker met.
_HELD: dict[str, Scorer] = {}


def _predicting(model, text_col: str, lang_out: str, score_out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = model.value.key
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Scorer(model.value)
        for batch, texts in slices(batches, text_col, SLICE_BYTES):
            names, shares = _HELD[key].texts(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=[*batch.schema.names, lang_out, score_out])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` plus each text's language and score. The model's size is that of the vocabulary; it is broadcast."""
    shared, docs = docs.sparkSession.sparkContext.broadcast(model), docs.drop(lang_out, score_out)
    fields = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]
    return docs.mapInArrow(_predicting(shared, text_col, lang_out, score_out), T.StructType([*docs.schema.fields, *fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
