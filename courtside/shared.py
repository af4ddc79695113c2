"""Tables written once and read again, in a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def _require_local(master: str) -> None:
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {_CONF} to a folder that the driver and all executors share (master is {master})")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master (tests).

    On a cluster no folder of one machine can serve, so an unset name is an error there.
    """
    found = spark.conf.get(_CONF, None)
    if not found:
        _require_local(spark.sparkContext.master)
        found = tempfile.mkdtemp(prefix="courtside-")
        spark.conf.set(_CONF, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/courtside/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation, and later plans see the real size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
