"""Streams with state and event time, run slice by slice from one checkpoint, against what SQL makes of the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.plans.registry import query
from courtside.shared import fresh_path, materialize
from courtside.streaming import book as B
from courtside.streaming.market import trade_bars
from courtside.streaming.runs import run_in_slices, with_rocksdb
from courtside.tables import table

#: Messages of a ticker after which a new snapshot comes, and those that arrive in the first and second slice.
EVERY, SLICES = 20, (30, 70)


def _feed(spark, sf_dir) -> DataFrame:
    """A book feed of the events: every 20th message of a ticker is a snapshot, some are sent twice, some are lost."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.select("event_id", "ts", F.col("user_id").alias("ticker"), F.when(F.col("event_type").isin("click", "view"), "yes").otherwise("no").alias("side"), F.round(F.least("value", F.lit(99.0))).cast("int").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("k"), n.cast("long").alias("n"))
    snapshot = F.col("n") % EVERY == 1
    twice = (F.col("event_id") % 11 == 0) & ~snapshot & (F.col("n") % EVERY > 2)
    lost = (F.col("n") % EVERY == 13) & (F.col("ticker") % 3 == 0)
    level = lambda side, price, size: F.struct(side.alias("side"), price.cast("int").alias("price"), size.cast("long").alias("size"))
    whole = F.array(level(F.lit("yes"), F.col("price"), F.col("k") + 1), level(F.lit("no"), F.greatest(F.lit(0), 90 - F.col("price")), F.col("k") + 2), level(F.lit("yes"), F.lit(1), F.lit(5)))
    levels = F.when(snapshot & (F.col("price") != 1), whole).when(snapshot, F.slice(whole, 1, 2)).otherwise(F.array(level(F.col("side"), F.col("price"), F.col("k") - 50)))
    return e.where(~lost).select("ticker", F.col("n").alias("arrival"), (F.col("n") - F.when(twice, 1).otherwise(0)).alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(snapshot, "snapshot").otherwise("delta").alias("kind"), levels.alias("levels"))


#: The same feed, what each message does, and the levels after all of them.
_FEED_SQL = f"""
WITH n AS (SELECT user_id AS ticker, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'yes' ELSE 'no' END AS side, CAST(round(least(value, 99)) AS INT) AS price,
  CAST(props->>'$.k' AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS arrival FROM events),
feed AS (SELECT *, arrival % {EVERY} = 1 AS whole, arrival - CASE WHEN event_id % 11 = 0 AND arrival % {EVERY} > 2 THEN 1 ELSE 0 END AS seq FROM n WHERE NOT (arrival % {EVERY} = 13 AND ticker % 3 = 0)),
epochs AS (SELECT *, sum(whole::INT) OVER (PARTITION BY ticker ORDER BY arrival) AS epoch FROM feed),
told AS (SELECT *, min(CASE WHEN whole THEN seq END) OVER (PARTITION BY ticker, epoch) AS start, dense_rank() OVER (PARTITION BY ticker, epoch ORDER BY seq) - 1 AS place,
  row_number() OVER (PARTITION BY ticker, epoch, seq ORDER BY arrival) AS copy FROM epochs),
judged AS (SELECT *, CASE WHEN whole THEN 'snapshot' WHEN seq - start <> place THEN 'gap' WHEN copy > 1 THEN 'duplicate' ELSE 'applied' END AS status FROM told),
moves AS (
  SELECT ticker, epoch, arrival, side, price, k - 50 AS size FROM judged WHERE status = 'applied'
  UNION ALL SELECT ticker, epoch, arrival, 'yes', price, k + 1 FROM judged WHERE whole
  UNION ALL SELECT ticker, epoch, arrival, 'no', greatest(0, 90 - price), k + 2 FROM judged WHERE whole
  UNION ALL SELECT ticker, epoch, arrival, 'yes', 1, 5 FROM judged WHERE whole AND price <> 1),
sums AS (SELECT *, sum(size) OVER w AS run FROM moves WINDOW w AS (PARTITION BY ticker, epoch, side, price ORDER BY arrival)),
sizes AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY ticker, epoch, side, price ORDER BY arrival)) AS held FROM sums)
"""


def _changes(spark, sf_dir) -> DataFrame:
    feed = materialize(_feed(spark, sf_dir), "feed")
    first, second = SLICES
    slices = [feed.where(F.col("arrival") <= first), feed.where((F.col("arrival") > first) & (F.col("arrival") <= second)), feed.where(F.col("arrival") > second)]
    with with_rocksdb(spark):
        return run_in_slices(spark, slices, B.book_changes, fresh_path(spark, "book"))[0]


@query(f"""{_FEED_SQL}
SELECT ticker, side, price, arg_max(held, arrival)::BIGINT AS size FROM sizes WHERE (ticker, epoch) IN (SELECT (ticker, max(epoch)) FROM judged GROUP BY ticker) GROUP BY ALL HAVING arg_max(held, arrival) > 0""")
def st2_streaming_book(spark, sf_dir):
    """The levels that a stream's state leaves, after two restarts."""
    return B.book_after(_changes(spark, sf_dir))


@query(f"""{_FEED_SQL},
spans AS (SELECT *, lead(arrival) OVER (PARTITION BY ticker, epoch, side, price ORDER BY arrival) AS until FROM sizes),
tops AS (
  SELECT j.ticker, j.arrival, j.seq, j.status, max(CASE WHEN s.side = 'yes' THEN s.price END) AS bid, 100 - max(CASE WHEN s.side = 'no' THEN s.price END) AS ask
  FROM judged j LEFT JOIN spans s ON s.ticker = j.ticker AND s.epoch = j.epoch AND s.held > 0 AND s.arrival <= j.arrival AND (s.until IS NULL OR s.until > j.arrival) GROUP BY ALL)
SELECT ticker, arrival, seq, status, CASE WHEN bid < ask OR bid IS NULL OR ask IS NULL THEN bid END AS bid, CASE WHEN bid < ask OR bid IS NULL OR ask IS NULL THEN ask END AS ask FROM tops""")
def st4_streaming_tops(spark, sf_dir):
    """What each message did, and the top of the book right after it; a crossed book has none."""
    return _changes(spark, sf_dir).where("side IS NULL").select("ticker", "arrival", "seq", "status", "bid", "ask")


#: How long a stream waits for rows that come late, and the rows that come after all others.
LATE, LAST = "2 days", "event_id % 17 = 0"
_ARRIVED_SQL = f"""
WITH cut AS (SELECT epoch_ms(CAST(floor(epoch_us(max(ts)) / 1000) AS BIGINT)) - INTERVAL {LATE} AS mark FROM events WHERE NOT {LAST})"""


def _slices(spark, sf_dir) -> list[DataFrame]:
    """Trades as they arrive: the first half by time, the second, and last of all those that were held up."""
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("trade_time"), F.col("user_id").alias("ticker"), F.get_json_object("props", "$.k").cast("long").alias("size"), (0.02 + 0.96 * F.least("value", F.lit(150.0)) / 150).alias("yes_price"), "event_type", "value")
    low, high = e.agg(F.min("trade_time"), F.max("trade_time")).first()
    middle = F.lit(low + (high - low) / 2)
    on_time = e.where(f"NOT {LAST}")
    return [on_time.where(F.col("trade_time") < middle), on_time.where(F.col("trade_time") >= middle), e.where(LAST)]


@query(f"""{_ARRIVED_SQL}, t AS (SELECT user_id AS ticker, date_trunc('day', ts)::TIMESTAMP AS day, ts, event_id, 0.02::DOUBLE + 0.96::DOUBLE * least(value, 150.0::DOUBLE) / 150 AS p, CAST(props->>'$.k' AS BIGINT) AS size FROM events WHERE NOT {LAST})
SELECT ticker, day, count(*) AS n, max(p) AS high, min(p) AS low, arg_min(p, (ts, event_id)) AS open, arg_max(p, (ts, event_id)) AS close, sum(size)::BIGINT AS volume FROM t, cut WHERE day + INTERVAL 1 DAY <= mark GROUP BY ALL""")
def st8_event_time_bars(spark, sf_dir):
    """Daily bars, each written once when the watermark has passed its day; rows for days that are closed are dropped."""

    def bars(arriving: DataFrame) -> DataFrame:
        b = trade_bars(arriving.withWatermark("trade_time", LATE), [F.window("trade_time", "1 day").alias("window"), "ticker"])
        return b.select("ticker", "window", "n", "high", "low", "open", "close", "volume")

    got, _ = run_in_slices(spark, _slices(spark, sf_dir), bars, fresh_path(spark, "event-bars"))
    return got.select("ticker", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "high", "low", "open", "close", "volume")


@query(f"""{_ARRIVED_SQL}, g AS (SELECT event_type, round(avg(value), 6) AS usual FROM events GROUP BY 1)
SELECT event_id, user_id AS ticker, event_type, round(value - usual, 6) AS edge FROM events JOIN g USING (event_type), cut WHERE value > usual AND (NOT {LAST} OR ts > mark)""")
def st10_edges_on_time(spark, sf_dir):
    """Trades with an edge over the historical table, each trade once; those later than the watermark are dropped.

    The state holds an id only until the watermark has passed its time.
    """
    usual = materialize(table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("usual")), "usual")

    def edges(arriving: DataFrame) -> DataFrame:
        once = arriving.withWatermark("trade_time", LATE).dropDuplicatesWithinWatermark(["event_id"])
        return once.join(F.broadcast(usual), "event_type").where("value > usual").select("event_id", "ticker", "event_type", F.round(F.col("value") - F.col("usual"), 6).alias("edge"))

    return run_in_slices(spark, _slices(spark, sf_dir), edges, fresh_path(spark, "on-time"))[0]
