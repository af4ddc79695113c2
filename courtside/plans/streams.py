"""Structured Streaming queries: a stream of the events table, run until it has read all there is, and what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.plans.registry import query
from courtside.shared import fresh_path
from courtside.streaming import market as M
from courtside.streaming.runs import write_batches

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    price = 0.02 + 0.96 * F.least("value", F.lit(150.0)) / 150
    return e.select("event_id", F.col("ts").cast("timestamp").alias("trade_time"), F.col("user_id").alias("ticker"), price.alias("yes_price"), F.get_json_object("props", "$.k").cast("long").alias("size"), "event_type")


def _written(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and return the table that it wrote."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    running = writer.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT event_id, user_id AS ticker, ts AS trade_time, CAST(props->>'$.k' AS BIGINT) AS size FROM events")
def st5_tape_append(spark, sf_dir):
    """The tape as an append-only table, each id once within the watermark; every trade arrives twice."""
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    tape = twice.withWatermark("trade_time", "400 days").dropDuplicatesWithinWatermark(["event_id"])
    return _written(tape, "tape").select("event_id", "ticker", F.col("trade_time").cast("timestamp_ntz").alias("trade_time"), "size")


@query("""SELECT user_id AS ticker, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, max(0.02::DOUBLE + 0.96::DOUBLE * least(value, 150.0::DOUBLE) / 150) AS high, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS volume FROM events GROUP BY 1, 2""")
def st8_streaming_bars(spark, sf_dir):
    bars = M.trade_bars(_stream(spark, sf_dir), [F.window("trade_time", "1 day"), "ticker"])
    got = _written(bars, "bars", "complete")
    return got.select("ticker", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "high", "volume")


@query("""WITH g AS (SELECT event_type, round(avg(value), 6) AS usual FROM events GROUP BY 1) SELECT event_id, event_type, round(value - usual, 6) AS edge FROM events JOIN g USING (event_type) WHERE value > usual""")
def st10_stream_static_edges(spark, sf_dir):
    """A stream joined with a historical table of a few rows, one for each event type."""
    usual = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("usual"))
    e = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = e.join(F.broadcast(usual), "event_type").where("value > usual").select("event_id", "event_type", F.round(F.col("value") - F.col("usual"), 6).alias("edge"))
    return _written(found, "edges")


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def st1_message_routing(spark, sf_dir):
    """One stream routed by type to a table each in every micro-batch; the tables counted."""
    base = fresh_path(spark, "routed")
    e = _stream(spark, sf_dir)
    write_batches(e, base, "event_type")
    back = spark.read.schema(e.schema).parquet(base)
    return back.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
