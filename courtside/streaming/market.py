"""Market streams: the same functions serve batch tables and Structured Streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One JSON line for each message of the feed.
MESSAGE = "type string, ticker string, seq long, ts timestamp, side string, price int, delta long, yes_price double, size long, trade_id string"


def trade_bars(trades: DataFrame, keys: list) -> DataFrame:
    """Open, high, low, close, count, volume and volume-weighted price; first and last are those of least and greatest (time, id)."""
    order = F.struct("trade_time", "event_id")
    return trades.groupBy(*keys).agg(
        F.min_by("yes_price", order).alias("open"), F.max("yes_price").alias("high"), F.min("yes_price").alias("low"), F.max_by("yes_price", order).alias("close"), F.count("*").alias("n"), F.sum("size").alias("volume"), (F.sum(F.col("yes_price") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("vwap")
    )


def streaming_bars(trades: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of trades; a bar is emitted once the watermark has passed it, and later trades are dropped."""
    return trade_bars(trades.withWatermark("trade_time", late), [F.window("trade_time", width), "ticker"])


def book_levels(deltas: DataFrame, level: list[str], order: list[str], delta: str) -> DataFrame:
    """Sizes of the levels above zero after all deltas, each level held at zero when a delta would take it below.

    With running sums P of a level, its size is P - min(0, least P so far).
    """
    w = Window.partitionBy(*level).orderBy(*order)
    last = Window.partitionBy(*level).orderBy(*[F.desc(c) for c in order])
    d = deltas.withColumn("__sum", F.sum(delta).over(w))
    d = d.withColumns({"__size": F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(w)), "__n": F.row_number().over(last)})
    return d.where("__n = 1 AND __size > 0").select(*level, F.col("__size").alias("size"))


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON lines that arrive in a folder."""
    return spark.readStream.schema(MESSAGE).json(folder)


def routed(messages: DataFrame, kind: str) -> DataFrame:
    return messages.where(F.col("type") == kind)


def tape_of(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Trades, each id once within the watermark."""
    trades = routed(messages, "trade").select("trade_id", "ticker", F.col("ts").alias("trade_time"), "yes_price", "size", F.col("seq").alias("event_id"))
    return trades.withWatermark("trade_time", late).dropDuplicatesWithinWatermark(["trade_id"])
