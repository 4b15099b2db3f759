"""Views of the benchmark tables in the library's schemas.

``EVENTS_SQL`` and ``TRACES_SQL`` say the same in SQL, for checks by another engine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.plans.lineage import shared_folder
from tracewise.sources.event_files import SUFFIXES

FPS = 10.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, from ``events``; users are units, days are trials."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, user = F.col("event_type"), F.col("user_id")
    pick = lambda names, other: F.expr(f"CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} ELSE '{other}' END")
    protocol = F.element_at(F.array(*map(F.lit, ("task_axons", "NO_DREADDs", "passive_axons", "task_dendrites (pre-CNO)"))), (user % 4 + 1).cast("int"))
    onset = (F.unix_micros(F.col("ts").cast("timestamp")) % 10_000_000) / 1e6
    return raw.select(
        protocol.alias("protocol"),
        F.concat(F.lit("s"), (user % 3).cast("string")).alias("k0"),
        F.concat(F.lit("r"), user.cast("string")).alias("k1"),
        F.dayofmonth("ts").cast("long").alias("trial"),
        pick({"purchase": "cHIT", "signup": "nHIT", "click": "nCATCH", "error": "FA"}, "cCATCH").alias("outcome"),
        pick({"purchase": "cRew", "signup": "nRew", "click": "cStim"}, "nStim").alias("history"),
        F.when(kind.isin("purchase", "signup"), "target").otherwise("reference").alias("side"),
        onset.alias("ev_onset"),
        F.col("value").alias("peak"),
        (onset + F.col("event_id") % 5 / 10).alias("peak_time"),
        (onset + F.col("event_id") % 11 / 10).alias("ev_offset"),
        (F.col("event_id") % 11 / 10).alias("ev_duration"),
        (F.col("value") * 0.5).alias("integral"),
        F.col("event_id").alias("row_ord"),
    )


EVENTS_SQL = """ev AS (
  SELECT CASE user_id % 4 WHEN 0 THEN 'task_axons' WHEN 1 THEN 'NO_DREADDs' WHEN 2 THEN 'passive_axons'
              ELSE 'task_dendrites (pre-CNO)' END AS protocol,
         's' || (user_id % 3) AS k0, 'r' || user_id AS k1, day(ts)::BIGINT AS trial,
         CASE event_type WHEN 'purchase' THEN 'cHIT' WHEN 'signup' THEN 'nHIT' WHEN 'click' THEN 'nCATCH'
              WHEN 'error' THEN 'FA' ELSE 'cCATCH' END AS outcome,
         CASE event_type WHEN 'purchase' THEN 'cRew' WHEN 'signup' THEN 'nRew' WHEN 'click' THEN 'cStim' ELSE 'nStim' END AS history,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'target' ELSE 'reference' END AS side,
         (epoch_us(ts) % 10000000) / 1e6 AS ev_onset, value AS peak,
         (epoch_us(ts) % 10000000) / 1e6 + event_id % 5 / 10 AS peak_time,
         (epoch_us(ts) % 10000000) / 1e6 + event_id % 11 / 10 AS ev_offset,
         event_id % 11 / 10 AS ev_duration, value * 0.5 AS integral, event_id AS row_ord
  FROM events
)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trial of 64 frames, from ``embeddings``; labels are units, four vectors in turn are outcomes."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    outcome = F.element_at(F.array(*map(F.lit, ("cHIT", "nHIT", "cCATCH", "FA"))), (F.col("vec_id") % 4 + 1).cast("int"))
    return raw.select(
        F.lit("s").alias("session"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("roi"), F.col("vec_id").alias("trial"),
        outcome.alias("outcome"), F.transform("embedding", lambda x: x.cast("double")).alias("y"), F.col("vec_id").alias("row_ord"),
    )


TRACES_SQL = """tr AS (
  SELECT 's' AS session, 'r' || label AS roi, vec_id AS trial,
         CASE vec_id % 4 WHEN 0 THEN 'cHIT' WHEN 1 THEN 'nHIT' WHEN 2 THEN 'cCATCH' ELSE 'FA' END AS outcome,
         embedding::DOUBLE[] AS y, vec_id AS row_ord
  FROM embeddings
)"""


def trial_counts(events: DataFrame, label: str = "outcome") -> DataFrame:
    """Distinct trials per ``protocol, session, ttype``."""
    return events.groupBy("protocol", F.col("k0").alias("session"), F.col(label).alias("ttype")).agg(F.count_distinct("trial").alias("n"))


def lick_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session, trial, lick_latency``: mean click value of a user and day; the session is the user."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'")
    return raw.groupBy(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("session"), F.dayofmonth("ts").cast("long").alias("trial")).agg((F.avg("value") / 1000).alias("lick_latency"))


def recordings(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Converted trace and behaviour tables from ``embeddings``: four spellings of a vector in a row are 256 frames."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e, label, trial = F.transform("embedding", lambda x: x.cast("double")), F.col("label"), F.col("vec_id")
    y = F.concat(e, F.reverse(e), F.transform(e, lambda x: x * 1.25), F.transform(e, lambda x: -x)).alias("y")
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), (trial % 4 + 1).cast("int"))
    common = [label.cast("string").alias("roi"), trial.alias("trial"), y, trial.alias("row_ord")]
    task = F.concat(F.lit("s"), (label % 2).cast("string")).alias("id")
    batch = [
        F.lit("NAIVE STIM REW").alias("protocol"), F.concat(F.lit("m"), (label % 2).cast("string")).alias("id"),
        F.when(label % 4 < 2, "AXONS").otherwise("DENDRITES").alias("compartment"),
    ]
    outcomes, histories = of(("cHIT", "nHIT", "cCATCH", "FA")), of(("cRew", "nRew", "cStim", "none"))
    return {
        "traces_task_axons": raw.select(task, *common, outcomes.alias("unvalidated_type")),
        "traces_no_dreadds": raw.select(task, *common, outcomes.alias("trial_type")),
        "traces_batch1": raw.select(*batch, *common),
        "behavior_batch1": raw.select(*batch, trial.alias("trial"), histories.alias("history")),
    }


def count_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Converted tables of trial types and behaviour from ``events``; some flat types stand there twice."""
    raw, user = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("user_id")
    named = lambda p, n: F.concat(F.lit(p), (user % n).cast("string"))
    kind = F.col("event_type")
    ttype = F.when(kind == "purchase", "HIT").when(kind == "signup", "CATCH").when(kind == "click", "None").when(kind == "error", "resp early").otherwise("FA")
    history = F.when(kind == "purchase", "cRew").when(kind == "signup", "nRew").when(kind == "click", "cStim").otherwise("nStim").alias("history")
    flat = raw.groupBy(named("s", 3).alias("id"), ttype.alias("ttype"), (user % 2).alias("part")).agg(F.count("*").alias("n_trials"), F.max("event_id").alias("row_ord"))
    protocol = F.when(user % 5 > 0, "NAIVE STIM REW").otherwise("OTHER").alias("protocol")
    days = raw.select(named("TD", 4).alias("td"), named("MOUSE", 3).alias("mouse"), ttype.alias("trial type"))
    return {
        "trials_task_axons": flat,
        "trials_no_dreadds": flat.withColumn("id", F.concat(F.lit("x"), "id")),
        "behavior_batch1": raw.select(protocol, named("m", 3).alias("id"), F.when(user % 2 == 0, "AXONS").otherwise("DENDRITES").alias("compartment"), history),
        "behavior_batch3": raw.select(protocol, named("n", 3).alias("id"), named("FOV", 2).alias("fov"), history),
        "behavior_task_dendrites": days,
        "behavior_control_dendrites": days,
    }


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_files(rows: DataFrame, folder: str, name: str) -> None:
    """``rows`` as CSV files of ``folder``: one for each value of the column ``name``, which is the file's name."""
    spark = rows.sparkSession
    parts = f"{folder}/parts-{uuid.uuid4().hex}"
    rows.repartition(name).write.partitionBy(name).option("header", True).csv(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    for held in files.listStatus(path(parts)):
        title = held.getPath().getName().partition("=")[2]
        for file in files.listStatus(held.getPath()) if title else []:
            files.rename(file.getPath(), path(f"{folder}/{title}.csv"))
    files.delete(path(parts), True)


def event_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """``events`` as CSV files in the three layouts, eight of each group and side; names say both."""
    rows = events(spark, sf_dir)
    group = F.when(F.col("protocol").contains("dendrites"), "task_dendrites_TD0").otherwise(F.col("protocol"))
    side = F.element_at(F.create_map(F.lit("target"), F.lit(SUFFIXES["reward"][0]), F.lit("reference"), F.lit(SUFFIXES["reward"][1])), F.col("side"))
    rows = rows.withColumn("file", F.concat(F.lit("part"), (F.col("row_ord") % 8).cast("string"), F.lit("_MODIFIED_"), group, side))
    numbers = ["peak", "ev_onset", "peak_time", "ev_offset", "ev_duration", "integral"]
    task = F.col("protocol").isin("task_axons", "NO_DREADDs")
    flat = F.concat("k0", F.lit("_"), "k1", F.lit(".0")).alias("ROI")
    csv_files(rows.where(task).select(F.col("row_ord").alias("place"), flat, "trial", "outcome", *numbers, "file"), folder, "file")
    keyed = [F.col("k0").alias("id"), F.col("k1").alias("ROI"), "trial"]
    csv_files(rows.where(F.col("protocol").contains("passive")).select(*keyed, "history", *numbers, "file"), folder, "file")
    csv_files(rows.where(F.col("protocol").contains("dendrites")).select(*keyed, "outcome", *numbers, "file"), folder, "file")


def frequency_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Events of each unit by outcome, as frequency files: one of each protocol."""
    counts = events(spark, sf_dir).groupBy("protocol", "k0", "k1").agg(*[(F.count_if(F.col("outcome") == o) / 8).alias(o) for o in ("cHIT", "nHIT", "FA")])
    name = F.concat(F.regexp_replace("protocol", "[^A-Za-z_]+", "_"), F.lit("_fullreward_event_frequencies"))
    csv_files(counts.select(F.col("k0").alias("id"), F.col("k1").alias("ROI"), "cHIT", "nHIT", "FA", name.alias("file")), folder, "file")


#: Vectors in a row that make a session of the nested sources.
SESSION = 64


def _sorted_lists(rows: DataFrame, keys: list[str], **columns) -> DataFrame:
    """Rows of each group as one array of structs, in ``at``."""
    # By ``at`` alone: maps have no order.
    earlier = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    held = F.array_sort(F.collect_list(F.struct("at", *[c.alias(n) for n, c in columns.items()])), earlier)
    return rows.groupBy(*keys).agg(held.alias("held"), F.min("at").alias("at"))


def nested_sources(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """``embeddings`` as nested JSON recordings: sessions of 64 vectors, their labels as units."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e, at, odd = F.transform("embedding", lambda x: x.cast("double")), F.col("vec_id"), F.col("at") % 2 == 1
    kind = F.element_at(F.array(*map(F.lit, ("cHIT", "nHIT", "cCATCH", "FA"))), (at % 4 + 1).cast("int"))
    rows = raw.select(F.floor(at / SESSION).alias("position"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("roi"), at.alias("at"), kind.alias("kind"), e.alias("y"))
    labels = F.create_map(F.lit("unvalidated_type"), F.col("kind"), F.lit("response_latency"), F.when(odd, (F.col("at") / 10).cast("string")).otherwise("none"))
    drop = lambda *names: F.transform("held", lambda x: F.struct(*[x[n].alias(n) for n in names]))
    flat = rows.withColumn("ttype", F.explode(F.array(F.lit("ALL"), F.when(F.col("kind").contains("HIT"), "HIT").otherwise("other"))))
    units = _sorted_lists(flat, ["position", "ttype", "roi"], trial=F.col("at").cast("string"), labels=labels, y=F.col("y")).withColumn("trials", drop("trial", "labels", "y"))
    branches = _sorted_lists(units, ["position", "ttype"], roi=F.col("roi"), trials=F.col("trials")).withColumn("rois", drop("roi", "trials"))
    ordered = branches.withColumn("at", F.when(F.col("ttype") == "ALL", 0).when(F.col("ttype") == "HIT", 1).otherwise(2))
    sessions = _sorted_lists(ordered, ["position"], ttype=F.col("ttype"), rois=F.col("rois")).withColumn("branches", drop("ttype", "rois"))
    sessions.select("position", F.concat(F.lit("s"), "position").alias("id"), "branches").write.json(f"{folder}/task_axons.json")
    # The same trials as a series: two groups of a protocol, each with its units and a behaviour table.
    grouped = rows.withColumn("name", F.when(F.col("at") % 3 == 0, "AXONS").otherwise("DENDRITES"))
    units = _sorted_lists(grouped, ["position", "name", "roi"], trial=F.col("at").cast("int"), y=F.col("y")).withColumn("trials", drop("trial", "y"))
    held = _sorted_lists(units, ["position", "name"], roi=F.col("roi"), trials=F.col("trials")).withColumn("rois", drop("roi", "trials")).select("position", "name", "rois")
    fields = F.create_map(F.lit("history"), F.col("kind"), F.lit("Rew lick latency"), F.when(odd, (F.col("at") / 10).cast("string")).otherwise("no lick"))
    seen = _sorted_lists(grouped, ["position", "name"], trial=F.col("at").cast("int"), row=F.col("at").cast("int"), fields=fields).withColumn("behavior", drop("trial", "row", "fields"))
    groups = held.join(seen.select("position", "name", "behavior"), ["position", "name"]).withColumn("at", F.when(F.col("name") == "AXONS", 0).otherwise(1))
    series = _sorted_lists(groups, ["position"], name=F.col("name"), behavior=F.col("behavior"), rois=F.col("rois")).withColumn("groups", drop("name", "behavior", "rois"))
    protocols = F.array(F.struct(F.lit("NAIVE STIM REW").alias("protocol"), "groups"))
    series.select("position", F.concat(F.lit("m"), "position").alias("id"), protocols.alias("protocols")).write.json(f"{folder}/batch1.json")
