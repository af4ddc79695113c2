"""Streams run to the end of what has arrived, and taken up again from their checkpoints."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which map state needs; the session's choice comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_once(stream: DataFrame, path: str) -> list[dict]:
    """Append all that has arrived to the table at ``path`` (state beside it), and the progress of each micro-batch.

    The file sink writes a batch's files under its number, so that a batch that is run again after a failure counts once.
    """
    running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return [p if isinstance(p, dict) else json.loads(p.json) for p in running.recentProgress]


def run_in_slices(spark: SparkSession, slices: list[DataFrame], build: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, list[dict]]:
    """Let each slice arrive as files, run the stream on it, stop, and go on with the next: (what it wrote, progress).

    build: from the stream of arriving rows to the stream that is written. Every slice but the first is a restart.
    """
    schema, progress = slices[0].schema, []
    for part in slices:
        part.write.mode("append").parquet(f"{path}-arrived")
        stream = build(spark.readStream.schema(schema).parquet(f"{path}-arrived"))
        progress += run_once(stream, path)
    return spark.read.schema(stream.schema).parquet(path), progress


def rows_too_late(progress: list[dict]) -> int:
    """Rows (of partial sums, where a batch is summed before it meets the state) that came after the watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])


def write_batches(stream: DataFrame, path: str, by: str) -> None:
    """A stream routed into one table for each value of ``by``, a folder for each batch, written over if it runs again."""

    def route(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch={batch}")

    running = stream.writeStream.foreachBatch(route).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    running.awaitTermination()
