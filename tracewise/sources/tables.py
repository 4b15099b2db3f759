"""Converted tables: scans by name, wide-to-array traces, and the write side."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewise.sources.files import listed, tree_checksums

# Names of the converted tables.
CONVERTED = (
    "trials_task_axons", "trials_no_dreadds", "behavior_batch1", "behavior_batch3", "behavior_task_dendrites",
    "behavior_control_dendrites", "traces_batch1", "traces_batch3", "traces_task_axons", "traces_no_dreadds",
)
MANIFEST = "conversion_manifest"


class ConvertedDataMissing(FileNotFoundError):
    """A converted table is not there."""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A converted table; where it is missing, the error says how to make it."""
    path = f"{folder}/{name}.parquet"
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise ConvertedDataMissing(f"{path} not found; make it with tracewise.sources.nested.convert_all(spark, source_folder, {folder!r})") from error
    return as_arrays(found) if name.startswith("traces_") else found


def read_converted(spark: SparkSession, folder: str, names: tuple[str, ...] = CONVERTED) -> dict[str, DataFrame]:
    """All converted tables by name; nothing is read yet."""
    return {n: read_table(spark, folder, n) for n in names}


def as_arrays(traces: DataFrame) -> DataFrame:
    """Traces with the frames ``f000, f001, …`` as the array ``y``; any number of frames counts.

    Tables that have ``y`` stay. ``row_ord``, the order of rows, must be there: it can't be told afterwards.
    """
    if "y" in traces.columns:
        return traces
    frames = sorted((c for c in traces.columns if c[:1] == "f" and c[1:].isdigit() and len(c) >= 4), key=lambda c: int(c[1:]))
    if "row_ord" not in traces.columns:
        raise ValueError("a trace table needs row_ord, the order that its rows were recorded in")
    return traces.select(*[c for c in traces.columns if c not in frames], F.array(*[F.col(c).cast("double") for c in frames]).alias("y"))


def stringified(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested columns as JSON text, null kept; the others as they are."""
    nested = [c for c, t in df.dtypes if c not in keep and t.startswith(("array", "map", "struct"))]
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)) for c in nested})


def checksums(spark: SparkSession, folder: str) -> dict[str, str]:
    """The hash of each file below a folder by its path there, as ``files.tree_checksums`` makes them: a file of up to 8 MB
    has its SHA-256, a larger one that of its tree. One short row a file comes to the driver, for the manifest."""
    return {r.name: r.sha256 for r in tree_checksums(spark, listed(folder, recursive=True)).orderBy("name").collect()}


def write_tables(tables: Mapping[str, DataFrame], folder: str, sources: Mapping[str, str] | None = None, source_folder: str | None = None) -> dict[str, str]:
    """Each table as Parquet, and a manifest: row counts, sources and the source files' checksums. Returns the paths by name.

    Rows are counted as they are written.
    """
    paths, counts = {}, {}
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        paths[name] = f"{folder}/{name}.parquet"
        seen = Observation(name)
        table.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(paths[name])
        counts[name] = seen.get["n"]
    body = {"sources": dict(sources or {}), "row_counts": counts, "spark_version": spark.version, "sha256": checksums(spark, source_folder) if source_folder else {}}
    spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(manifest_path(folder))
    return paths


def write_bucketed(traces: DataFrame, table: str, buckets: int, unit: tuple[str, ...] = ("session", "roi")) -> DataFrame:
    """Traces as a table of the warehouse, in buckets of units, a file each, in the order of trials; returns the table.

    Whatever groups, joins or orders it by unit finds a unit's traces together: thresholds, detection and baselines then
    need no exchange of traces.
    """
    traces.repartition(buckets, *unit).write.mode("overwrite").bucketBy(buckets, *unit).sortBy(*unit, "row_ord").saveAsTable(table)
    return traces.sparkSession.table(table)


def manifest_path(folder: str) -> str:
    """Where a folder's manifest is."""
    return f"{folder}/{MANIFEST}"


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """What ``write_tables`` noted."""
    return json.loads(spark.read.text(manifest_path(folder)).first()[0])
