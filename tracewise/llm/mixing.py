"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its token share raised to an exponent between 0 and 1, normalised. The exponent is bisected until
the weights meet a target entropy, or until no source is repeated more than a limit. The budget then gives each source a
number of passes over its documents: whole passes, and for what is left a part of one. Documents lie in blocks by a hash
of their id; each pass visits the blocks in a permutation of its own. The partial pass first takes blocks that hold a
large share of their source, the largest first, then the others in their permutation, each if it fits what is left of the
budget; one that does not fit is passed over. DataFrame functions only.

Without a budget, the smallest one is taken that gives every source a whole pass, so no document is left out. A source
whose share of a budget is under a token has no visit. Defined cases: null text counts as empty and has no tokens; a source without tokens gets one pass; null sources form a source
of their own; rows with a null id are dealt to blocks by all their columns; repeated rows count each; an empty table gives
an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewise.llm.common import SPACE_RUN, cut, table, text_or_empty

#: Times that a document of the most repeated source occurs, at most.
MAX_REPETITION = 2.0
#: Blocks of the whole corpus: so many at least and at most, and in between of so many tokens on average. A pass over a
#: source orders its blocks, which are no more than these.
MIN_BLOCKS, MAX_BLOCKS, BLOCK_TOKENS = 256, 65_536, 4_000_000
#: Blocks with more than this share of their source's tokens are taken first in a partial pass.
LARGE_SHARE = 1 / 16
#: Blocks of a partial pass that are folded together.
FOLD = 256
#: Parts that one job splits the exponent's interval into, and jobs; 4 bits a job.
PARTS, ROUNDS = 16, 12


def token_count(text: str | Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _hash32(*parts: str | Column) -> Column:
    """A 32-bit number from the MD5 of the parts, which any engine can make."""
    joined = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def exponent_for_repetition(least: float, most: float, limit: float) -> float:
    """The smallest exponent at which the smallest share is repeated ``limit`` times at most while the largest is passed once."""
    low, high = 0.0, 1.0
    over = lambda a: (least / most) ** (a - 1) > limit
    if not over(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) else (low, mid)
    return high


def exponent_for_entropy(shares: DataFrame, target: float) -> float:
    """The exponent at which the weights' entropy (nats) is ``target``; 0 or 1 where that lies outside the range.

    ``shares`` has one row per source with a share above 0. A job evaluates the entropy at inner points of the interval
    by sums over all sources; only those sums come to the driver.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
        sums = []
        for i, a in enumerate(points):
            power = F.pow("share", F.lit(a))
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log("share")).alias(f"l{i}")]
        row = shares.agg(*sums).first()
        if row["z0"] is None:
            return 1.0
        entropy = [math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"] for i, a in enumerate(points)]
        # Entropy falls as the exponent rises: the last point that still reaches the target starts the next interval.
        reach = [i for i, h in enumerate(entropy) if h >= target]
        if not reach:
            return low
        if reach[-1] == PARTS:
            return high
        low, high = points[reach[-1]], points[reach[-1] + 1]
    return low


def _tokens(text_col: str, tokens_col: str | None) -> Column:
    """A row's tokens: those of a column that holds them, or the text's."""
    return (token_count(text_col) if tokens_col is None else F.coalesce(F.col(tokens_col).cast("long"), F.lit(0))).alias("n_tokens")


def _block(docs: DataFrame, seed: str, id_col: str, blocks: int) -> Column:
    """A row's block."""
    everything = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return (_hash32(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), everything)) % blocks).alias("block")


def source_weights(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    tokens_col: str | None = None,
    max_repetition: float = MAX_REPETITION,
    target_entropy: float | None = None,
    budget_tokens: float | None = None,
) -> tuple[DataFrame, int]:
    """One row per source: ``src, tokens, weight, passes``; and the number of blocks.

    ``passes`` is how often the budget goes over the source's documents.
    """
    rows = docs.select(F.col(source_col).cast("string").alias("src"), _tokens(text_col, tokens_col))
    sources = cut(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens")), few=True)
    known = sources.where("tokens > 0")
    total, least, most = known.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if total is None:
        return sources.select("src", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("passes")), MIN_BLOCKS
    if target_entropy is None:
        exponent = exponent_for_repetition(least, most, max_repetition)
    else:
        exponent = exponent_for_entropy(known.select((F.col("tokens") / total).alias("share")), target_entropy)
    raw = F.pow(F.col("tokens") / F.lit(most), F.lit(exponent))
    scale = known.agg(F.sum(raw)).first()[0]
    # The exponent is 1 at most, so the largest source is the one with the fewest passes.
    budget = most * scale if budget_tokens is None else budget_tokens
    weight = F.when(F.col("tokens") > 0, raw / scale).otherwise(0.0)
    passes = F.when(F.col("tokens") > 0, F.lit(budget) * raw / scale / F.col("tokens")).otherwise(1.0)
    blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, math.ceil(total / BLOCK_TOKENS)))
    return sources.select("src", "tokens", weight.alias("weight"), passes.alias("passes")), blocks


def _fitting(visits: DataFrame) -> DataFrame:
    """The visits of whole passes, and of partial passes those that fit one after another.

    A pass's blocks, bounded in number, are folded in parts: a part's fold appends to a list of its own, so that no step
    copies more than a part, or the list of parts.
    """
    size = F.when(F.col("n_tokens") > LARGE_SHARE * F.col("tokens"), -F.col("n_tokens")).otherwise(F.lit(0))
    passes = visits.groupBy("src", "epoch").agg(
        F.first("whole").alias("whole"), F.first("part").alias("part"), F.sort_array(F.collect_list(F.struct(size.alias("size"), "block_pos", "block", "n_tokens"))).alias("held")
    )

    def step(state, x):
        taken = F.struct((state["left"] - x["n_tokens"]).alias("left"), F.concat(state["taken"], F.array(x)).alias("taken"))
        return F.when(x["n_tokens"] <= state["left"], taken).otherwise(state)

    def folded(state, part):
        none = F.slice(part, 1, 0)
        own = F.aggregate(part, F.struct(state["left"].alias("left"), none.alias("taken")), step)
        # Made once: a fold of one element that the fold of the part is.
        return F.aggregate(F.array(own), state, lambda s, x: F.struct(x["left"].alias("left"), F.concat(s["taken"], F.array(x["taken"])).alias("taken")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("held") - 1) / FOLD)), lambda i: F.slice("held", (i * FOLD + 1).cast("int"), FOLD))
    dealt = passes.withColumn("parts", parts)
    start = F.struct(F.col("part").cast("long").alias("left"), F.slice("parts", 1, 0).alias("taken"))
    taken = F.when(F.col("epoch") < F.col("whole"), F.col("held")).otherwise(F.flatten(F.aggregate("parts", start, folded, lambda x: x["taken"])))
    return dealt.select("src", "epoch", F.explode(taken).alias("x")).select("src", "x.block", "epoch", "x.block_pos")


def block_plan(docs: DataFrame, seed: str, id_col: str, source_col: str, text_col: str, tokens_col: str | None = None, **targets) -> tuple[DataFrame, int]:
    """One row per visit of a block: ``src, block, epoch, block_pos``; and the number of blocks."""
    sources, blocks = source_weights(docs, source_col, text_col, tokens_col, **targets)
    rows = docs.select(F.col(source_col).cast("string").alias("src"), _block(docs, seed, id_col, blocks), _tokens(text_col, tokens_col))
    sums = rows.groupBy("src", "block").agg(F.sum("n_tokens").alias("n_tokens"))
    whole = F.floor(F.col("passes") + 1e-9).cast("int")
    part = F.greatest(F.floor(F.col("tokens") * (F.col("passes") - F.col("whole")) + 1e-6).cast("double"), F.lit(0.0))
    paced = sources.withColumn("whole", whole).withColumn("part", part).select("src", "tokens", "whole", "part")
    visits = sums.join(paced, sums.src.eqNullSafe(paced.src)).select(sums.src, "block", "n_tokens", "tokens", "whole", "part")
    # A source whose budget is under a token has no pass at all.
    last = F.when(F.col("part") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    visits = visits.where((F.col("whole") > 0) | (F.col("part") > 0)).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    turn = Window.partitionBy("src", "epoch").orderBy(_hash32(F.lit(seed), "src", "epoch", "block"), "block")
    return _fitting(visits.withColumn("block_pos", F.row_number().over(turn) - 1)), blocks


def mix(
    docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens_col: str | None = None, **targets
) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as its block is visited.

    One struct column ``row`` with the columns of ``docs``, and ``epoch, block, block_pos``: the pass, the block, and the
    block's turn in it. ``tokens_col`` names a column with token counts, where words of the text are not what counts. A
    hot source is spread over its blocks before the join with the plan.
    """
    plan, blocks = block_plan(docs, seed, id_col, source_col, text_col, tokens_col, **targets)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("src"), _block(docs, seed, id_col, blocks))
    joined = rows.join(plan, (rows.block == plan.block) & rows.src.eqNullSafe(plan.src))
    return joined.select("row", "epoch", rows.block.cast("int").alias("block"), "block_pos")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visit of every document: ``doc_id, source, n_tokens, epoch, block, block_pos``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", token_count("text").alias("n_tokens"))
    return mix(docs, tokens_col="n_tokens").select("row.*", "epoch", "block", "block_pos")


ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
), t AS (
  SELECT source, sum(n_tokens)::DOUBLE AS tokens FROM c GROUP BY source
), e AS (
  SELECT sum(tokens) AS total, max(tokens) AS most,
         CASE WHEN max(tokens) / min(tokens) <= 2.0 THEN 0.0 ELSE 1 - ln(2.0) / ln(max(tokens) / min(tokens)) END AS a
  FROM t WHERE tokens > 0
), p AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens / most, a) * most / tokens ELSE 1.0 END AS passes FROM t, e
), q AS (
  SELECT source, tokens, floor(passes + 1e-9)::INT AS whole,
         greatest(floor(tokens * (passes - floor(passes + 1e-9)) + 1e-6), 0)::BIGINT AS part FROM p
), d AS (
  SELECT c.*, ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT % least(65536, greatest(256, ceil(total / 4000000)))::BIGINT AS block FROM c, e
), s AS (
  SELECT source, block, sum(n_tokens)::BIGINT AS n_tokens FROM d GROUP BY source, block
), v AS (
  SELECT s.*, q.tokens, q.whole, q.part, unnest(range(0, CASE WHEN q.part > 0 THEN whole + 1 ELSE whole END)) AS epoch
  FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source
), o AS (
  SELECT *, ('0x' || substr(md5('mix:' || coalesce(source, '') || ':' || epoch || ':' || block), 1, 8))::BIGINT AS turn FROM v
), w AS (
  SELECT *, row_number() OVER (PARTITION BY source, epoch ORDER BY turn, block) - 1 AS block_pos FROM o
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n_tokens > tokens / 16 THEN -n_tokens ELSE 0 END, block_pos, block) AS i
  FROM w WHERE epoch = whole
), g(source, i, room, taken) AS (
  SELECT source, 0::BIGINT, part, false FROM q
  UNION ALL
  SELECT r.source, r.i, room - CASE WHEN n_tokens <= room THEN n_tokens ELSE 0 END, n_tokens <= room
  FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source AND r.i = g.i + 1
), x AS (
  SELECT source, block, epoch, block_pos FROM w WHERE epoch < whole
  UNION ALL SELECT r.source, block, epoch, block_pos FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source AND r.i = g.i WHERE taken
)
SELECT d.doc_id, d.source, d.n_tokens, x.epoch::INT AS epoch, d.block::INT AS block, x.block_pos::INT AS block_pos
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.block = x.block
"""
