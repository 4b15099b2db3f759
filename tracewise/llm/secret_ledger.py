"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is a blob, addressed by the SHA-256 of its text. The ledger has a row for each pair of blob
and rule version that was scanned, with the spans found. A scan takes one row for each blob that lacks a pair, runs the
rules that it lacks, adds the pairs to the ledger, and joins all findings back to every path that holds the blob.

Defined cases: null text counts as empty; paths may be null or repeat, with the same or other texts (versions); each
row gets its findings. Positions are in code points, ends exclusive. Other columns play no part. An empty table adds
nothing. Whole texts are scanned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewise.llm.common import cut, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if ``group`` has ``least`` characters; failing ones are passed over, not retried."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: str = "1"

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: In this order kinds stand where spans start together. The last one is ours: key blocks and tokens of known form.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # The same as runs of any length of which those under 24 are dropped.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule(
        "vendor",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
        r"|eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}",
    ),
)
BASE_KINDS = ("assign", "access", "hex")
PIECES = "array<struct<b:int,m:string>>"


def pieces(text: Column, rule: Rule) -> Column:
    """``b, m`` of each match, in order: the length of the text before it, since the last match, and the match."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    each = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(b.alias("b"), m.alias("m")))
    return F.when(text.rlike(rule.pattern), each).otherwise(F.array().cast(PIECES))


def _placed(scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, rule, spans`` from the matches of each pair: places are running sums over a pair's matches.

    Matches are rows of a few numbers here, ordered within their pair; work grows with their number.
    """
    held = F.lit(None).cast("int")
    for r in rules:
        group = F.regexp_extract("x.m", r.pattern, r.group) if r.group else F.col("x.m")
        held = F.when(F.col("rule") == r.id, F.when(F.length(group) >= r.least, F.lit(1))).otherwise(held)
    rows = scanned.select("blob", "rule", F.posexplode_outer("pieces").alias("pos", "x"))
    rows = rows.select("blob", "rule", "pos", F.length("x.m").alias("size"), (F.col("x.b") + F.length("x.m")).alias("step"), held.alias("held"))
    upto = F.sum("step").over(Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("end", upto)
    kind = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.id, r.kind)]), F.col("rule"))
    span = F.when(F.col("held") == 1, F.struct(kind.alias("kind"), (F.col("end") - F.col("size")).alias("start"), F.col("end")))
    return rows.groupBy("blob", "rule").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _addressed(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return versions.select(F.col(path_col).alias("path"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def scan(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The pairs that ``ledger`` lacks, scanned: ``blob, rule, spans``; the ledger grows by these rows.

    One row stands for a blob: the one with the smallest path. Only narrow rows are grouped; the texts then move once,
    to meet the blobs that are left.
    """
    rows = _addressed(versions, path_col, text_col)
    blobs = rows.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*[F.lit(r.id) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", every)
    else:
        known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        todo = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0).drop("done")
    todo = todo.withColumnsRenamed({"blob": "todo_blob", "path": "todo_path"})
    texts = rows.join(todo, F.col("path").eqNullSafe(F.col("todo_path")) & (F.col("blob") == F.col("todo_blob")))
    pairs = [F.when(F.array_contains("todo", r.id), F.struct(F.lit(r.id).alias("rule"), pieces(F.col("text"), r).alias("pieces"))) for r in rules]
    # Rows that repeat path and text stand for one blob.
    scanned = texts.select("blob", F.inline(F.array_compact(F.array(*pairs)))).dropDuplicates(["blob", "rule"])
    return _placed(scanned, rules)


def findings(versions: DataFrame, ledger: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row's path and ``spans``, sorted by start, then by the rules' order; from the current rule versions."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    current = ledger.where(F.col("rule").isin([r.id for r in rules]) & (F.size("spans") > 0))
    by_blob = current.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ordered = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("turn"), s["end"].alias("end"), s["kind"].alias("kind")))
    by_blob = by_blob.select("blob", F.array_sort(ordered).alias("spans"))
    rows = _addressed(versions, path_col, text_col).select(F.col("path").alias(path_col), "blob")
    return rows.join(by_blob, "blob", "left").select(path_col, F.coalesce("spans", F.array()).alias("spans"))


def joined(spans_: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(docs, cut(scan(docs)))
    counts = [_count(k).alias(f"n_{k}") for k in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(list(BASE_KINDS)))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    each = "\n  UNION ALL\n  ".join(
        f"SELECT doc_id, {i} AS turn, '{r.kind}' AS kind, regexp_extract_all(t, p{i}, 0) AS m, regexp_extract_all(t, p{i}, {r.group}) AS g,"
        f" string_split_regex(t, p{i}) AS b, {r.least} AS least FROM d, p"
        for i, r in enumerate(RULES)
    )
    patterns = ", ".join(f"'{r.pattern.replace(chr(39), chr(39) * 2)}' AS p{i}" for i, r in enumerate(RULES))
    return f"""
WITH p AS (SELECT {patterns}), d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), e AS (
  {each}
), i AS (
  SELECT *, unnest(range(1, len(m) + 1)) AS i FROM e
), s AS (
  SELECT doc_id, turn, kind, length(m[i]) AS size, length(g[i]) AS held, least,
         list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM i
), k AS (
  SELECT doc_id, turn, kind, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM s WHERE held >= least
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, turn) FILTER (WHERE kind <> 'vendor') AS base,
         string_agg(span, ',' ORDER BY start, turn) AS spans
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


ORACLE = _oracle()
