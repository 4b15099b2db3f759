"""Trial counts, denominators, pooled events and unit universes of the protocol groups.

``legacy=True`` keeps four known slips of the published figures, so that their numbers come out; ``legacy=False`` mends
them: day TD1 stays out of the pooled events; control files marked as modified count; each session lists its own units;
reference totals of dendrites under stimulus alignment are counted on their own outcomes.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.keys import PRE_DAYS, contains_any, day_label, null_safe_join, phase_label, session_name, without_modified
from tracewise.operators.recipes import PASSIVE_PROTOCOL

# Tables of trial counts and behaviour, and the days that each kind of recording has.
FLAT_TABLES = {"task_axons": "trials_task_axons", "NO_DREADDs": "trials_no_dreadds"}
FLAT_TRACES = {"task_axons": "traces_task_axons", "NO_DREADDs": "traces_no_dreadds"}
BATCH1, BATCH3 = "RGECO_GCaMP_Batch1", "GCaMP_POm_Batch3"
DENDRITE_TABLES = {
    "behavior_task_dendrites": ("task_dendrites", ("TD0", "TD2", "TD3")),
    "behavior_control_dendrites": ("control_dendrites", ("TD1", "TD2", "TD3")),
}
UNIVERSE_DAYS = ("TD0", "TD2", "TD3")
COUNT_COLUMNS = "protocol string, td string, session string, ttype string, n long"


def flat_counts(trials: DataFrame) -> DataFrame:
    """``session, ttype, n`` without the types that are none or responses; of repeated ones the last row counts."""
    kept = trials.where((F.col("ttype") != "None") & ~F.col("ttype").contains("resp"))
    return kept.groupBy(F.col("id").cast("string").alias("session"), "ttype").agg(F.max_by("n_trials", "row_ord").cast("long").alias("n"))


def _passive_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``protocol, session, history`` of the passive recordings."""
    one = tables["behavior_batch1"].where(F.col("protocol") == PASSIVE_PROTOCOL).select(
        F.when(F.col("compartment") == "AXONS", "passive_axons").otherwise("passive_dendrites").alias("protocol"),
        session_name(BATCH1, "id").alias("session"), "compartment", F.col("history").cast("string").alias("history"),
    )
    three = tables["behavior_batch3"].where(F.col("protocol") == PASSIVE_PROTOCOL).select(
        F.lit("passive_axons").alias("protocol"), session_name(BATCH3, "id", "fov").alias("session"), F.lit(None).cast("string").alias("compartment"),
        F.col("history").cast("string").alias("history"),
    )
    return one.unionByName(three)


def _dendrite_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``protocol, td, session, ttype`` of the dendrite recordings."""
    pieces = [
        tables[name].where(F.col("td").isin(*days)).select(day_label(prefix, F.col("td")).alias("protocol"), "td", F.lower("mouse").alias("session"), F.col("trial type").cast("string").alias("ttype"))
        for name, (prefix, days) in DENDRITE_TABLES.items()
        if name in tables
    ]
    return reduce(DataFrame.unionByName, pieces)


def trial_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``protocol, td, session, ttype, n`` of all protocols; ``td`` is null but for dendrites."""
    none = F.lit(None).cast("string")
    flat = [flat_counts(tables[t]).select(F.lit(p).alias("protocol"), none.alias("td"), "session", "ttype", "n") for p, t in FLAT_TABLES.items() if t in tables]
    passive = _passive_rows(tables).groupBy("protocol", none.alias("td"), "session", F.col("history").alias("ttype")).agg(F.count("*").alias("n")) if "behavior_batch1" in tables else None
    dendrite = _dendrite_rows(tables).groupBy("protocol", "td", "session", "ttype").agg(F.count("*").alias("n")) if any(t in tables for t in DENDRITE_TABLES) else None
    return reduce(DataFrame.unionByName, [x for x in (*flat, passive, dendrite) if x is not None])


def trial_totals(counts: DataFrame, alignment: str, legacy: bool = True) -> DataFrame:
    """``protocol, n_target, n_reference`` from ``protocol, ttype, n``."""
    holds = lambda *marks: contains_any(F.col("ttype"), marks)
    flat, passive = F.col("protocol").isin(*FLAT_TABLES), F.col("protocol").contains("passive")
    first, second = ("Rew", "Stim") if alignment == "reward" else ("Stim", "Rew")
    if alignment == "reward":
        target, reference = holds("HIT"), ~holds("HIT")
    else:
        target = holds("HIT", "miss")
        reference = target if legacy else holds("FA", "CATCH")
    t = F.when(flat, F.col("ttype") == "HIT").when(passive, holds(first)).otherwise(target)
    r = F.when(flat, F.col("ttype").isin("FA", "CATCH")).when(passive, holds(second)).otherwise(reference)
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return counts.groupBy("protocol").agg(of(t).alias("n_target"), of(r).alias("n_reference"))


def without_last_part(key: Column) -> Column:
    """The text before its last underscore; empty if it has none."""
    parts = F.split(key, "_")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "_")


def rate_session(k0: str = "k0", k1: str = "k1") -> Column:
    """The session whose trials divide a unit's events: a one-part key's last part goes only if it holds ``.0``."""
    alone = F.when(F.col(k0).contains(".0"), without_last_part(F.col(k0))).otherwise(F.col(k0))
    return F.when(F.col(k1).isNull(), alone).otherwise(F.col(k0))


def modulation_session(k0: str = "k0", k1: str = "k1") -> Column:
    """The same for modulation, where a one-part key's last part always goes."""
    return F.when(F.col(k1).isNull(), without_last_part(F.col(k0))).otherwise(F.col(k0))


def with_day(units: DataFrame, counts: DataFrame) -> DataFrame:
    """``units`` plus ``td``: of dendrite protocols their only day or, of several, TD3 if the unit's name says so, else TD2."""
    days = counts.where("td is not null").groupBy("protocol").agg(F.min("td").alias("only"), F.count_distinct("td").alias("days"))
    named = F.coalesce(F.col("k1"), F.col("k0")).contains("TD3")
    td = F.when(F.col("days") == 1, F.col("only")).when(F.col("days") > 1, F.when(named, "TD3").otherwise("TD2"))
    return units.join(days, "protocol", "left").withColumn("td", td).drop("only", "days")


def modulation_denominators(units: DataFrame, counts: DataFrame, alignment: str) -> DataFrame:
    """``protocol, k0, k1, n_target, n_reference`` for distinct ``protocol, k0, k1`` of ``units``."""
    passive, day = F.col("protocol").contains("passive"), F.col("protocol").contains("CNO")
    marks = ("HIT",) if alignment == "reward" else ("HIT", "miss")
    first = "Rew" if alignment == "reward" else "Stim"
    held = contains_any(F.col("ttype"), marks)
    # A type that holds two marks counts for each.
    times = reduce(Column.__add__, [F.col("ttype").contains(m).cast("long") for m in marks])
    own = F.when(passive, F.col("ttype").contains(first).cast("long")).when(day | F.lit(alignment != "reward"), times).otherwise((F.col("ttype") == "HIT").cast("long"))
    rest = F.when(passive, ~F.col("ttype").contains(first)).otherwise(~held)
    sums = counts.groupBy("protocol", "td", F.col("session").alias("of")).agg(
        F.sum(F.col("n") * own).alias("t"), F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("r"), F.max(F.when(F.col("ttype") == "ALL", F.col("n"))).alias("all")
    )
    sums = sums.withColumn("r", F.when(passive | day, F.col("r")).otherwise(F.col("all") - F.col("t")))
    wanted = with_day(units.select("protocol", "k0", "k1").distinct(), counts).withColumn("of", modulation_session())
    found = null_safe_join(wanted, sums, ["protocol", "td", "of"])
    return found.select("protocol", "k0", "k1", F.col("t").alias("n_target"), F.col("r").alias("n_reference"))


def pooled_events(events: DataFrame, active_only: bool = True, exclude: tuple[str, ...] = ("TD1",), legacy: bool = True) -> DataFrame:
    """``events`` (with ``stem``) plus ``protocol``, the group that the stem's events are pooled in.

    Active units are those of the group's files. In legacy mode excluded stems keep a group of their own among the active
    units, but not among the events, so their rows stay where another file of the pool has the unit.
    """
    title = without_modified(F.col("stem"))
    out = contains_any(title, exclude)
    rows = events.withColumn("protocol", phase_label(title))
    if not legacy:
        rows = rows.where(~out)
    if not active_only:
        return rows
    active = events.select(F.when(out & F.lit(legacy), title).otherwise(phase_label(title)).alias("protocol"), "k0", "k1", out.alias("out"))
    active = (active if legacy else active.where("not out")).select("protocol", "k0", "k1").distinct()
    return null_safe_join(rows, active, ["protocol", "k0", "k1"], "left_semi")


def replace_groups(files: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Events of files, where found events take the place of the file of the same stem."""
    found = regenerated.withColumnRenamed("group", "stem")
    kept = files.join(found.select("stem").distinct(), "stem", "left_anti")
    return kept.unionByName(found, allowMissingColumns=True)


def _day_of_stem(stem: Column, legacy: bool) -> Column:
    """The day that a frequency file's stem names; legacy mode misreads modified control files."""
    parts = F.split(stem, "_")
    right = F.when(stem.contains("MODIFIED"), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return F.when(~stem.contains("COHORT") & F.lit(legacy), F.get(parts, F.lit(0))).otherwise(right)


def file_units(frequencies: DataFrame, legacy: bool = True) -> DataFrame:
    """``protocol, k0, k1`` of frequency files, one row for each unit of each file."""
    stem = F.col("stem")
    kind = F.when(stem.contains("COHORT"), "task_dendrites").when(stem.contains("CONTROL"), "control_dendrites")
    rows = frequencies.select("stem", "k0", "k1", kind.alias("kind"), _day_of_stem(stem, legacy).alias("td"))
    rows = rows.where(F.col("kind").isNotNull() & F.col("td").isin(*UNIVERSE_DAYS)).distinct()
    return rows.select(day_label(F.col("kind"), F.col("td")).alias("protocol"), "k0", "k1")


def trace_units(tables: Mapping[str, DataFrame], legacy: bool = True) -> DataFrame:
    """``protocol, k0, k1`` of the traces. In legacy mode all of batch 1 lists the units of batch 3's last field."""
    three = tables["traces_batch3"].where(F.col("protocol") == PASSIVE_PROTOCOL).groupBy("id", "fov", "roi").agg(F.min("row_ord").alias("first"))
    axons = three.select(F.lit("passive_axons").alias("protocol"), session_name(BATCH3, "id", "fov").alias("k0"), "roi")
    one = tables["traces_batch1"].where(F.col("protocol") == PASSIVE_PROTOCOL).select("id", "compartment", "roi").distinct()
    if legacy:
        # Fields come in the order of their first rows. One row names the last; its units, some hundreds that one image
        # holds, are listed by each session: the slip's own output, whatever makes it.
        last = three.groupBy("id", "fov").agg(F.min("first").alias("first")).orderBy(F.desc("first")).limit(1)
        stale = three.join(F.broadcast(last.select("id", "fov")), ["id", "fov"]).select("roi")
        one = one.select("id", "compartment").distinct().crossJoin(stale)
    label = F.when(F.col("compartment") == "AXONS", "passive_axons").otherwise("passive_dendrites")
    batch1 = one.select(label.alias("protocol"), session_name(BATCH1, "id").alias("k0"), "roi")
    flat = [
        tables[t].select(F.lit(p).alias("protocol"), F.concat(F.col("id"), F.lit("_"), F.col("roi")).alias("k0"), F.lit(None).cast("string").alias("roi")).distinct()
        for p, t in FLAT_TRACES.items()
        if t in tables
    ]
    return reduce(DataFrame.unionByName, [axons, batch1, *flat]).withColumnRenamed("roi", "k1")


def unit_universe(frequencies: DataFrame, tables: Mapping[str, DataFrame], legacy: bool = True) -> DataFrame:
    """All units of all protocols; one that several files list counts for each."""
    return file_units(frequencies, legacy).unionByName(trace_units(tables, legacy))


def is_pre(td: Column) -> Column:
    """Whether a day lies before the treatment."""
    return td.isin(*PRE_DAYS)
