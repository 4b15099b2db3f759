"""What the corpus operators share: reading tables, text normalisation and cutting lineage."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space, as the contracts spell them.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def one_spaced(text: str | Column) -> Column:
    """The text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(text_or_empty(text), SPACE_RUN, " ")


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores in front as it takes to differ from all ``taken`` names, upper or lower case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


#: Spark's setting, from 4.1 on, by which the shuffle files of a plan go once it has run.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, few: bool = False, tidy: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that its lineage ends there.

    ``few`` is for results of groupings, narrow and much smaller than what they come from: they are written in four files a
    core at most, where shuffle partitions would leave many tiny ones. With ``tidy`` the shuffle files behind the result are
    deleted as soon as it is written; else they stay until the JVM collects what refers to them. The folder is the cluster's ``spark.checkpoint.dir``.
    Where that is unset, a local session gets a folder of its own; on a cluster it is an error, as a folder of one machine
    is lost with it and not seen by others.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="tracewise-", dir=os.environ.get("TMPDIR")))
    conf = df.sparkSession.conf
    before = conf.get(_TIDY, None)
    if tidy:
        conf.set(_TIDY, "true")
    try:
        # A plan of its own each time: the setting is read as a plan is made, and a plan whose files are gone is not run again.
        return (df.coalesce(4 * context.defaultParallelism) if few else df.select("*") if tidy else df).checkpoint(eager=True)
    finally:
        if tidy:
            conf.unset(_TIDY) if before is None else conf.set(_TIDY, before)
