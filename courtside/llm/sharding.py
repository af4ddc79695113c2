"""Shuffled shards of a table by a two-pass external shuffle.

First pass: every record goes to a shard by its key and, uniformly by a seeded hash of the record's number, to one of
that shard's buckets; a shard has as many buckets as keep each at about ``bucket_bytes``. Second pass: one task holds a
bucket at a time, shuffles it (Spark's ``shuffle``, a Fisher-Yates shuffle with a seed) and writes it. A shard is its
buckets one after the other. Records are shuffled over the network once and written once.

Shards are chosen by rendezvous hashing: a key goes to the shard whose seeded hash with it is greatest. Only the key and
the number of shards decide, and one more shard takes records only into itself.

Defined results: null keys count as one key. Rows that share a key, repeats included, share its shard but are dealt to
all of its buckets, so that no hot key makes a large task. Null texts are of no bytes. A record travels as one struct,
so any column names are right. An empty table gives no files' rows. The order in a shard depends on the seed and on the
order in which Spark reads the table; give a table that is read alike each time (files, not the result of a shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard, from 0 on, whose hash with the key is greatest."""
    best = F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]) if shards > 1 else F.struct(F.lit(0).alias("s"))
    return best["s"]


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = 8, seed: int = 0, bucket_bytes: int = 16 << 20) -> None:
    """Write ``docs`` as Parquet under ``path``: shard (folders), bucket, place (in the bucket) and record (all columns)."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    sizes = docs.groupBy(shard_of(F.col(key), shards, seed).alias("shard")).agg(F.sum(size).alias("bytes")).collect()  # a row for each shard
    buckets = [1] * shards
    for row in sizes:
        buckets[row["shard"]] = max(1, -(-row["bytes"] // bucket_bytes))
    dealt = docs.select(F.struct(*docs.columns).alias("record"), F.monotonically_increasing_id().alias("number"))
    dealt = dealt.withColumn("shard", shard_of(F.col(f"record.{key}"), shards, seed))
    of_shard = F.get(F.array(*[F.lit(b) for b in buckets]), F.col("shard"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "number"), of_shard.cast("long")))
    scattered = dealt.repartition(sum(buckets), "shard", "bucket")
    held = scattered.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(F.struct("number", "record"))).alias("records"))
    shuffled = held.withColumn("records", F.shuffle("records", seed))
    laid = shuffled.select("shard", "bucket", F.posexplode("records").alias("place", "entry")).select("shard", "bucket", "place", "entry.record")
    laid.sortWithinPartitions("shard", "bucket", "place").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """shard, bucket, place and record (of these columns) of all that was written; a shard's order is that of (bucket, place)."""
    schema = StructType().add("bucket", LongType()).add("place", IntegerType()).add("record", columns).add("shard", IntegerType())
    return spark.read.schema(schema).parquet(path)


def with_slots(laid: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``laid`` with ``slot``, the record's place in its shard, from 0 on without gaps.

    counts: rows with shard and bucket of all records, if ``laid`` has only some columns or rows of them.
    """
    sizes = (laid if counts is None else counts).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row for each bucket
    return laid.join(sizes.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("__before")), ["shard", "bucket"]).withColumn("slot", F.col("__before") + F.col("place")).drop("__before")
