"""Event and frequency tables in CSV files, whose names say the group and whose keys stand in columns by layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions.keys import without_modified
from tracewise.sources.files import listed
from tracewise.sources.keyed_csv import KeyedCsv

# File endings by alignment, target side first, and the frequency files' pattern.
SUFFIXES = {"reward": ("_all_2s_reward_events", "_all_2s_noreward_events"), "stimulus": ("_all_500ms_stim_events", "_all_500ms_nostim_events")}
FREQUENCY_GLOBS = {"reward": "*fullreward_event_frequencies.csv", "stimulus": "*500ms_stim_event_frequencies.csv"}
NUMBERS = ("peak", "ev_onset", "peak_time", "ev_offset", "ev_duration", "integral")
TASK = ("task_axons", "NO_DREADDs")


def _files(spark: SparkSession, folder: str, pattern: str, keys: int = 1) -> DataFrame:
    """Rows of the folder's files that fit the pattern, each under its own header, in one scan."""
    spark.dataSource.register(KeyedCsv)
    if not listed(folder, pattern):
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return spark.read.format(KeyedCsv.name()).option("pattern", pattern).option("keys", keys).load(folder)


def _number(name: str) -> Column:
    return F.col("fields")[name].try_cast("double").alias(name)


def read_event_folder(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Events of all files with the ending, whatever their layout: ``stem, k0, k1, trial, outcome, history``, metrics and
    ``row_ord``, in one scan.

    The stem says the layout: task recordings have their key in the column ``ROI``, the others in the first column and
    ``ROI``. Columns that a file lacks are null, but for ``ROI``, without which rows have no key: that is an error.
    ``row_ord`` rises with the stems and the rows in a file.
    """
    stem = F.regexp_replace("file", rf"{suffix}\.csv$", "")
    task = without_modified(stem).isin(*TASK)
    lost = F.raise_error(F.concat(F.lit("no column ROI in "), "file"))
    roi = F.when(F.map_contains_key("fields", "ROI"), F.col("fields")["ROI"]).otherwise(lost)
    keys = [F.when(task, roi).otherwise(F.col("keys")[0]).alias("k0"), F.when(~task, roi).alias("k1")]
    texts = [F.col("fields")[c].alias(c) for c in ("trial", "outcome", "history")]
    return _files(spark, folder, f"*{suffix}.csv").select(stem.alias("stem"), *keys, *texts, *map(_number, NUMBERS), "row_ord")


def read_frequencies(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``stem, k0, k1`` and a column per outcome of all frequency files that fit the pattern; null where a file lacks it.

    The first two columns are keys, whatever their headers; outcomes are a few dozen names.
    """
    rows = _files(spark, folder, pattern, keys=2)
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("fields"))).distinct().collect())
    return rows.select(F.regexp_replace("file", r"\.csv$", "").alias("stem"), F.col("keys")[0].alias("k0"), F.col("keys")[1].alias("k1"), *map(_number, names))
