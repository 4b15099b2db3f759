"""Nested recordings, one JSON row per session, flattened into the converted tables.

Lists keep the order of sessions, branches, units and trials, which the tables carry on as ``source_order`` and
``row_ord``. Pickled sources are not read: their content comes as JSON of these schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.sources.tables import stringified, write_tables

# Schemas of the nested sources, and each dataset's name of its inner level or its labels.
TRIAL = "struct<trial:string,labels:map<string,string>,y:array<double>>"
FLAT = f"position long, id string, branches array<struct<ttype:string,rois:array<struct<roi:string,trials:array<{TRIAL}>>>>>"
SERIES = (
    "position long, id string, protocols array<struct<protocol:string,groups:array<struct<name:string,"
    "behavior:array<struct<trial:int,row:int,fields:map<string,string>>>,rois:array<struct<roi:string,trials:array<struct<trial:int,y:array<double>>>>>>>>>"
)
BEHAVIOR = "position long, td string, mice array<struct<mouse:string,rows:array<map<string,string>>>>"
FLAT_LABELS = {"task_axons": ("unvalidated_type", "previous_type", "response_latency", "early_lick"), "no_dreadds": ("trial_type",)}
GROUP_FIELD = {"batch1": "compartment", "batch3": "fov"}
COHORTS = ("task_dendrites", "control_dendrites")


def packed(*places: tuple[str, int]) -> Column:
    """One number from the places of nested levels, each with its bits; more places than these hold are an error."""
    out = F.lit(0).cast("long")
    for name, bits in places:
        place = F.col(name).cast("long")
        out = out * (1 << bits) + F.when(place < 1 << bits, place).otherwise(F.raise_error(F.lit(f"a level of a nested source has more than {1 << bits} places: {name}")))
    return out


def flatten_branches(nested: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(traces, trial counts) of sessions with branches by trial type.

    Traces come from the branch ``ALL``; counts from the first unit of every named branch that has units.
    """
    branches = nested.select("position", "id", F.posexplode("branches").alias("b", "branch")).select("position", "id", "b", "branch.*")
    named = branches.where(F.col("ttype").isNotNull() & (F.size("rois") > 0))
    trials = named.select(
        F.lit(dataset).alias("dataset"), "id", "ttype", F.size(F.get("rois", F.lit(0))["trials"]).alias("n_trials"), F.col("position").alias("source_order"),
        packed(("position", 40), ("b", 12)).alias("row_ord"),
    )
    rows = branches.where("ttype = 'ALL'").select("position", "id", "b", F.posexplode("rois").alias("r", "unit"))
    rows = rows.select("position", "id", "b", "r", "unit.roi", F.posexplode("unit.trials").alias("t", "x"))
    labels = [F.col("x.labels")[n].alias(n) for n in FLAT_LABELS[dataset]]
    traces = rows.select(F.lit(dataset).alias("dataset"), "id", "roi", "x.trial", *labels, F.col("position").alias("source_order"), packed(("position", 19), ("b", 12), ("r", 12), ("t", 20)).alias("row_ord"), "x.y")
    if "response_latency" in traces.columns:
        traces = traces.withColumn("response_latency", F.expr("try_cast(response_latency AS DOUBLE)"))
    return traces, trials


def flatten_series(nested: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(traces, behaviour) of sessions with protocols and groups, each with units and a behaviour table.

    ``source_order`` rises with sessions, protocols and groups in their order, ``row_ord`` with units and trials, too: up to
    2^20 trials a unit.
    """
    groups = nested.select("position", "id", F.posexplode("protocols").alias("p", "x")).select("position", "id", "p", "x.protocol", F.posexplode("x.groups").alias("g", "group"))
    numbered = groups.withColumn("source_order", packed(("position", 39), ("p", 12), ("g", 12)))
    field = F.col("group.name").alias(GROUP_FIELD[dataset])
    head = [F.lit(dataset).alias("dataset"), "id", "protocol", field]
    levels = ["position", "p", "g"]
    units = numbered.select(*head, *levels, "source_order", F.posexplode("group.rois").alias("r", "unit"))
    rows = units.select("dataset", "id", "protocol", GROUP_FIELD[dataset], *levels, "source_order", "r", "unit.roi", F.posexplode("unit.trials").alias("t", "x"))
    traces = rows.select("dataset", "id", "protocol", GROUP_FIELD[dataset], "roi", "x.trial", "source_order", packed(("position", 15), ("p", 8), ("g", 8), ("r", 12), ("t", 20)).alias("row_ord"), "x.y")
    seen = numbered.select(*head, "source_order", F.explode("group.behavior").alias("x"))
    behavior = seen.select("dataset", "id", "protocol", GROUP_FIELD[dataset], "source_order", "x.trial", F.col("x.row").alias("behavior_row"), "x.fields")
    names = behavior_fields(behavior)
    return traces, behavior.select("dataset", "id", "protocol", GROUP_FIELD[dataset], "source_order", "trial", "behavior_row", *[F.col("fields")[n].alias(n) for n in names])


def behavior_fields(rows: DataFrame, column: str = "fields") -> list[str]:
    """Names that occur in the rows' maps: the columns of a behaviour table, a few dozen."""
    return sorted(r[0] for r in rows.select(F.explode(F.map_keys(column))).distinct().collect())


def flatten_behavior(nested: DataFrame, cohort: str) -> DataFrame:
    """Behaviour of dendrite cohorts: days, mice and rows."""
    rows = nested.select(F.col("position").alias("source_order"), "td", F.explode("mice").alias("m")).select("source_order", "td", "m.mouse", F.explode("m.rows").alias("fields"))
    names = behavior_fields(rows)
    return rows.select(F.lit(cohort).alias("cohort"), "td", "mouse", "source_order", *[F.col("fields")[n].alias(n) for n in names])


def read_nested(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A nested source; each line of its files is a session. A file that is no such JSON is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}.json")


def convert_all(spark: SparkSession, source: str, dest: str) -> dict[str, str]:
    """All six nested sources as the ten converted tables with a manifest; returns their paths."""
    tables: dict[str, DataFrame] = {}
    for name in FLAT_LABELS:
        tables[f"traces_{name}"], tables[f"trials_{name}"] = flatten_branches(read_nested(spark, source, name, FLAT), name)
    for name in GROUP_FIELD:
        tables[f"traces_{name}"], tables[f"behavior_{name}"] = flatten_series(read_nested(spark, source, name, SERIES), name)
    for name in COHORTS:
        tables[f"behavior_{name}"] = stringified(flatten_behavior(read_nested(spark, source, f"{name}_behavior", BEHAVIOR), name))
    return write_tables(tables, dest, {n: f"{source}/{n}" for n in (*FLAT_LABELS, *GROUP_FIELD, *COHORTS)}, source)
