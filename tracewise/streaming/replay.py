"""A bounded table put through a streaming query: written in slices, read as a stream, and what comes out read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tracewise.plans.lineage import shared_folder

STORE = "spark.sql.streaming.stateStore.providerClass"
#: The store that keeps state of stateful processors on disk.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(spark: SparkSession, slices: Iterable[DataFrame], made: Callable[[DataFrame], DataFrame], files_a_batch: int = 64) -> DataFrame:
    """What the streaming query ``made`` gives for a stream of the slices, all of one schema, one after another.

    Slices, state and outcome lie in the shared checkpoint folder, where a restarted query goes on. Batches take files in
    the order in which they were written. Events that wait for the watermark need a last row that carries it past them.
    """
    folder, schema = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", None
    for part in slices:
        part.write.mode("append").parquet(f"{folder}/in")
        schema = part.schema
    stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{folder}/in"))
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        sink = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state")
        sink.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
