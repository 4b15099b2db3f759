"""Fill-in-middle transformation: texts cut at two units into prefix, middle and suffix, the middle told last.

Units come from the tokenizers library's ``Split`` pre-tokenizer, which isolates the matches of a pattern and gives their
offsets in code points; nothing is trained. The number of offsets is n, the two cuts are hashes of the id modulo n + 1,
ranked, and the offsets at their ranks give the slices. The default unit is one code point. Its offsets within a run of
characters do not depend on what stands around it, so each distinct run is split once by a task, and its offsets are moved
to where the run occurs; a text of any length is cut from runs of bounded length. Other patterns see whole texts.

A text stays plain if it is empty, holds a mark, or its id's hash says so. Marks must be such that no end of one is the
start of another; then none can arise where a mark meets a text without marks, and the output alone, with its form, gives
the text again: ``restore`` reads it back.

Defined cases: null text counts as empty, and is plain with n 0; a null id counts as empty text in the hashes. Rows are
independent: repeated rows come out alike, an empty table stays empty. Other columns pass through, but for ones named as
an output, which give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from tracewise.llm.batches import slices
from tracewise.llm.bpe import ragged
from tracewise.llm.common import free_name, table

#: One code point, line ends included.
CODE_POINT = r"[\s\S]"
#: Bytes of text handled at once, and distinct runs that a task keeps the offsets of.
SLICE_BYTES, KEPT_RUNS = 1_000_000, 150_000
#: Runs of up to 64 characters, which words with the gaps before them mostly are.
_RUNS = re.compile(r"[^\S\r\n]{0,32}\S{1,32}|\s{1,32}").findall
PLAIN, PSM, SPM = "plain", "psm", "spm"
OUT = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Rule:
    """Percent of texts that are transformed, percent of these with the suffix first, marks, unit, and the seed of the hashes."""

    rate: int = 90
    suffix_first: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = CODE_POINT
    seed: str = "1"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3:
            raise ValueError("marks must be three different texts")
        for a, b in product(marks, marks):
            if a != b and a in b or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)))):
                raise ValueError(f"an end of the mark {a!r} is a start of {b!r}, or one holds the other")


class Splitter:
    """Offsets of the units of texts."""

    def __init__(self, unit: str):
        self.whole = unit != CODE_POINT
        self.split = pre_tokenizers.Split(Regex(unit), behavior="isolated").pre_tokenize_str
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint8)
        self.starts, self.sizes, self.lengths = (np.zeros(0, np.int64) for _ in range(3))

    def _add(self, runs: list[str]) -> None:
        """Split runs that were not seen before."""
        found = [[a for _, (a, _) in self.split(r)] for r in runs]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.lengths = np.r_[self.lengths, np.fromiter(map(len, runs), np.int64, len(runs))]
        self.flat = np.r_[self.flat, np.fromiter((a for f in found for a in f), np.uint8, int(sizes.sum()))]

    def offsets(self, texts: list[str]) -> list[np.ndarray]:
        """Where each unit of each text begins, in code points."""
        if self.whole:
            return [np.fromiter((a for _, (a, _) in self.split(t)), np.int64) for t in texts]
        if len(self.numbers) > KEPT_RUNS:
            self._clear()
        split = list(map(_RUNS, texts))
        # Runs that are new to the task are split together, so that its arrays grow once.
        new = [r for r in dict.fromkeys(r for s in split for r in s) if r not in self.numbers]
        if new:
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            self._add(new)
        return list(map(self._placed, split))

    def _placed(self, runs: list[str]) -> np.ndarray:
        of = np.fromiter(map(self.numbers.__getitem__, runs), np.int64, len(runs))
        sizes, lengths = self.sizes[of], self.lengths[of]
        return self.flat[ragged(self.starts[of], sizes)] + np.repeat(np.cumsum(lengths) - lengths, sizes)


def transform(text: str, offsets: np.ndarray, hashes: list[int], rule: Rule) -> tuple[str, int | None, int | None, str]:
    """Form, lengths of prefix and middle in code points, and output of a text with these units."""
    n = len(offsets)
    if not text or any(m in text for m in (rule.prefix, rule.suffix, rule.middle)) or hashes[2] % 100 >= rule.rate:
        return PLAIN, None, None, text
    ends = np.r_[offsets, len(text)]
    a, b = (int(ends[i]) for i in sorted((hashes[0] % (n + 1), hashes[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if hashes[3] % 100 < rule.suffix_first:
        return SPM, a, b - a, f"{rule.suffix}{suffix}{rule.prefix}{prefix}{rule.middle}{middle}"
    return PSM, a, b - a, f"{rule.prefix}{prefix}{rule.suffix}{suffix}{rule.middle}{middle}"


def restored(output: str, form: str, rule: Rule) -> str:
    """The text that an output of this form was made from."""
    if form == PLAIN:
        return output
    first, second = (rule.suffix, rule.prefix) if form == SPM else (rule.prefix, rule.suffix)
    if not output.startswith(first):
        raise ValueError(f"an output of the form {form} does not begin with {first!r}")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(rule.middle)
    return two + middle + one if form == SPM else one + middle + two


def _transforming(rule: Rule, text_col: str, hash_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(rule.unit)
        for batch, texts in slices(batches, text_col, SLICE_BYTES):
            texts = [t or "" for t in texts]
            sizes, made = [], []
            for text, offsets, digest in zip(texts, splitter.offsets(texts), batch.column(hash_col).to_pylist(), strict=True):
                sizes.append(len(offsets))
                made.append(transform(text, offsets, [int(digest[i : i + 8], 16) for i in range(0, 32, 8)], rule))
            form, prefix, middle, output = zip(*made, strict=True)
            held = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != hash_col]
            new = [pa.array(sizes, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*held, *new], names=names)

    return run


def _restoring(rule: Rule, form_col: str, output_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, outputs in slices(batches, output_col, SLICE_BYTES):
            texts = [restored(o, f, rule) for o, f in zip(outputs, batch.column(form_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return run


def hashes(seed: str, id_col: Column) -> Column:
    """The hash of an id in hexadecimal digits."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), out: tuple[str, ...] = OUT) -> DataFrame:
    """``docs`` plus each text's number of units, form, code points of prefix and middle, and output.

    ``form`` is plain, psm or spm; lengths are null for plain texts, whose output is the text.
    """
    rest = docs.drop(*[o for o in out if o not in (id_col, text_col)])
    made = free_name("__hashes", rest.columns)
    types = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    fields = [*rest.schema.fields, *[T.StructField(n, t) for n, t in zip(out, types, strict=True)]]
    held = rest.withColumn(made, hashes(rule.seed, F.col(f"`{id_col}`")))
    return held.mapInArrow(_transforming(rule, text_col, made, [f.name for f in fields]), T.StructType(fields))


def restore(made: DataFrame, rule: Rule = Rule(), form_col: str = "form", output_col: str = "output", out_col: str = "restored") -> DataFrame:
    """``made`` plus the text that each output was made from."""
    rest = made.drop(out_col)
    fields = [*rest.schema.fields, T.StructField(out_col, T.StringType())]
    return rest.mapInArrow(_restoring(rule, form_col, output_col, [f.name for f in fields]), T.StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, with digests of its output and of the text read back from that."""
    made = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents
), c AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, substr(text, 1, least(c1, c2)) AS head, substr(text, least(c1, c2) + 1, abs(c1 - c2)) AS mid, substr(text, greatest(c1, c2) + 1) AS tail FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(c1 - c2) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
