"""Personal data by fixed patterns and by a character-level tagger.

The patterns give the base spans. The tagger, a bidirectional LSTM with CRF transitions, reads every whole text in
overlapping windows. The windows of a text are reconciled globally: a span is taken from the window in which its middle
lies deepest, spans that windows cut are put together, and of spans that overlap the longest stays. What is at most as long
as windows overlap lies whole in the window it is taken from. A tagged span is added if it meets the kind's own rule and no
base span overlaps it; base spans always stay.

Defined cases: null text counts as empty and has no spans. Positions are in code points, ends exclusive. Rows are
independent, so repeated rows, null ids, ties and empty tables need no care; other columns pass through, whatever their
names, but for one named as the output, which gives way. Texts are read whole, whatever their length; a task holds one
text or ``SLICE_BYTES`` of several, and the scores of ``SLICE_WINDOWS`` windows. Windows that a task has read before, as
in copies, are not read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm import tagger
from tracewise.llm.batches import slices
from tracewise.llm.common import free_name, table

KINDS = tagger.KINDS
#: Characters of a window, between the fronts of two, and by which two may differ on where the middle of a span is.
WINDOW, STRIDE, SLACK = 640, 512, 8
#: Windows that are decoded together, bytes of text handled at once, and windows that a task remembers.
SLICE_WINDOWS, SLICE_BYTES, KEPT_WINDOWS = 768, 1_000_000, 20_000

# Runs are possessive and begin where a run begins: a run that fails as a whole fails from any later digit too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
_SPELLED = re.compile(
    rf"{_NAME}(?:@|\s?[\[(]at[\])]\s?){_LABEL}(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s){_LABEL})+|{_NAME}\sat\s{_LABEL}(?:\sdot\s{_LABEL})+", re.I
)
_BETWEEN = r"(?:\s?\.\s?|[\[(]\.[\])]|\s?[\[(]?dot[\])]?\s?|-dot-)"
_SPELLED_IP = re.compile(rf"([0-9]{{1,3}}){_BETWEEN}([0-9]{{1,3}}){_BETWEEN}([0-9]{{1,3}}){_BETWEEN}([0-9]{{1,3}})", re.I)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest name before an at-sign that a host follows. Looked for from the at-signs."""
    begin, at = 0, text.find("@")
    while at >= 0:
        front = at
        while front > begin and text[front - 1] in _LOCAL:
            front -= 1
        if front < at and (host := _HOST.match(text, at + 1)):
            yield front, host.end()
            begin = host.end()
        at = text.find("@", max(at + 1, begin))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= len(digits := _digits(m[0])) <= 19 and tagger.luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def fits(kind: str, text: str) -> bool:
    """Whether a tagged text can be of the kind."""
    digits = _digits(text)
    if kind == "email":
        return bool(_SPELLED.fullmatch(text))
    if kind == "ip":
        m = _SPELLED_IP.fullmatch(text)
        return bool(m) and all(int(p) <= 255 for p in m.groups())
    if kind == "card":
        return 12 <= len(digits) <= 19 and tagger.luhn(digits) and not re.search(r"[^0-9\s./_-]", text)
    return 9 <= len(digits) <= 15 and bool(re.search(r"[() ./+-]", text)) and not re.search(r"[^0-9() ./+-]", text)


def windows(size: int) -> list[tuple[int, int]]:
    """Fronts and ends of the overlapping windows over a text of ``size`` characters."""
    return [(a, min(a + WINDOW, size)) for a in range(0, max(1, size - WINDOW + STRIDE), STRIDE)] if size else []


def reconciled(held: list[tuple[int, int]], tags: list[np.ndarray | None]) -> list[tuple[str, int, int]]:
    """Spans of a whole text from its windows' tags, in order.

    Two windows change over in the middle of what both hold.
    """
    whole: list[tuple[int, int, int]] = []
    cut: list[list] = []  # kind, start, end, whether cut at the end, whether the middle is the window's own
    for i, (a, b) in enumerate(held):
        if tags[i] is None:
            continue
        low = a if not i else (a + held[i - 1][1]) / 2
        high = b if i + 1 == len(held) else (held[i + 1][0] + b) / 2
        for kind, x, y in tagger.tagged_spans(tags[i]):
            front, back, own = x == 0 and i > 0, y == b - a and i + 1 < len(held), low - SLACK <= a + (x + y) / 2 < high + SLACK
            if front and cut and cut[-1][3] and cut[-1][0] == kind and cut[-1][2] > a:
                cut[-1][2:] = [max(cut[-1][2], a + y), back, True]
            elif front or back:
                cut.append([kind, a + x, a + y, back, own])
            elif own:
                whole.append((kind, a + x, a + y))
    out: list[tuple[int, int, int]] = []
    for at, (kind, a, b) in enumerate(found := sorted(whole + [tuple(c[:3]) for c in cut if c[4]], key=lambda s: (s[1], -s[2]))):
        # Runs of spans that overlap are short: they come from neighbouring windows.
        if not at or a >= reach:
            first, reach = at, b
        reach = max(reach, b)
        if at + 1 == len(found) or found[at + 1][1] >= reach:
            kept: list[tuple[int, int, int]] = []
            for s in sorted(found[first : at + 1], key=lambda s: (s[1] - s[2], s[1])):
                if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
                    kept.append(s)
            out += sorted(kept, key=lambda s: s[1])
    return [(KINDS[k], a, b) for k, a, b in out]


def _added(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The tagged spans that count. Both lists are in the order of their starts."""
    good, at, reach = [], 0, 0
    for kind, a, b in found:
        own = text[a:b]
        a, b = a + len(own) - len(own.lstrip()), b - len(own) + len(own.rstrip())
        # Base spans that start before this one's end: it is free if none of them reaches into it.
        while at < len(base) and base[at][1] < b:
            reach, at = max(reach, base[at][2]), at + 1
        if kind == "email" and (m := max(_SPELLED.finditer(text, a, b), key=lambda m: m.end() - m.start(), default=None)):
            # Words in front of a name are tagged at times.
            a, b = m.span()
        # A part of a longer number or word is nothing of its own.
        alone = not text[max(0, a - 1) : a].isalnum() and not text[b : b + 1].isalnum()
        if b > a >= reach and alone and fits(kind, text[a:b]):
            good.append((kind, a, b))
    return good


class Reader:
    """The tagger over texts, with the tags of the windows it read last."""

    def __init__(self, weights: tagger.Weights):
        self.weights, self.seen = weights, {}

    def tags(self, wanted: list[str]) -> list[np.ndarray | None]:
        """The tags of each window; None where it has none."""
        new = sorted(set(wanted).difference(self.seen), key=len)
        if len(self.seen) + len(new) > KEPT_WINDOWS:
            self.seen, new = {}, sorted(set(wanted), key=len)
        for at in range(0, len(new), SLICE_WINDOWS):
            part = new[at : at + SLICE_WINDOWS]
            self.seen.update(zip(part, tagger.decode(self.weights, part), strict=True))
        return [self.seen[w] for w in wanted]

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """What the tagger adds to each text's base spans."""
        held = [windows(len(t)) for t in texts]
        tags, at, out = self.tags([t[a:b] for t, own in zip(texts, held, strict=True) for a, b in own]), 0, []
        for text, spans, own in zip(texts, base, held, strict=True):
            part = tags[at : at + len(own)]
            at += len(own)
            out.append(_added(text, spans, reconciled(own, part)) if any(x is not None for x in part) else [])
        return out


_ROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def _finding(weights, text_col: str, out_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(weights.value)
        for batch, texts in slices(batches, text_col, SLICE_BYTES):
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            rows = []
            for own, more in zip(base, reader.added(texts, base), strict=True):
                spans = sorted([(*s, True) for s in own] + [(*s, False) for s in more], key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(_ROW))], names=[*batch.schema.names, out_col])

    return run


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def find(docs: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` plus each text's spans, by start, then kind: ``kind, start, end`` and whether a pattern found it.

    The tagger's weights, a few thousand numbers, are read on the driver and broadcast.
    """
    weights, docs = docs.sparkSession.sparkContext.broadcast(tagger.load()), docs.drop(out_col)
    made = free_name("__spans", docs.columns)
    found = docs.mapInArrow(_finding(weights, text_col, made), T.StructType([*docs.schema.fields, T.StructField(made, SPANS)]))
    return found.withColumnRenamed(made, out_col)


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", out_col: str = "redacted") -> DataFrame:
    """``docs`` plus the text with each span replaced by its kind in brackets; of spans that overlap, the first counts."""

    def step(state, s):
        gap = F.substring(F.coalesce(F.col(text_col), F.lit("")), state["at"] + 1, s["start"] - state["at"])
        return F.when(s["start"] < state["at"], state).otherwise(
            F.struct(F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(spans_col, start, step, lambda x: F.concat(x["out"], F.substring(F.coalesce(F.col(text_col), F.lit("")), x["at"] + 1, F.lit(2**31 - 1))))
    return docs.withColumn(out_col, whole)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[_count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
