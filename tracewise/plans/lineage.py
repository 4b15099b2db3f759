"""Ending a plan's lineage in files that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, for what later steps read back.

    Where that is unset, a local session gets a folder of its own; on a cluster it is an error, as a folder of one machine is
    lost with it and not seen by others.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="tracewise-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
