"""Prediction-market queries: calibration, edges, strategy results and signals over trade tapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators.joins import asof, in_bins, keep_last
from courtside.plans.registry import query
from courtside.sources import domain as D
from courtside.tables import table

#: Half-open bins of price and of hours to tip-off.
PRICE_EDGES = [0.0, 0.1, 0.25, 0.4, 0.6, 0.75, 0.9, 1.0]
TIME_EDGES = [0.0, 24.0, 168.0, 720.0, 100000.0]


def _r(column, name: str, digits: int = 6):
    return F.round(column, digits).alias(name)


def _bins_sql(x: str, edges: list[float], closed: str = "left") -> str:
    low, high = (">=", "<") if closed == "left" else (">", "<=")
    return "CASE " + " ".join(f"WHEN {x} {low} {a}::DOUBLE AND {x} {high} {b}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + " END"


_T = f"WITH {D.TAPE_SQL.strip()}"


@query(f"""{_T}, b AS (SELECT *, {_bins_sql('hours_to_tipoff', TIME_EDGES)} AS time_bin, {_bins_sql('yes_price', PRICE_EDGES)} AS price_bin FROM tape)
SELECT time_bin, price_bin, round(avg(yes_price), 6) AS mean_price, round(avg(actual_win), 6) AS win_rate, count(*) AS n, count(DISTINCT ticker) AS markets, round(100 * (avg(actual_win) - avg(yes_price)), 4) AS edge_cents
FROM b WHERE time_bin IS NOT NULL AND price_bin IS NOT NULL GROUP BY 1, 2""")
def a1_p18_edge_grid(spark, sf_dir):
    return edge_grid(D.tape(spark, sf_dir))


def edge_grid(tape):
    binned = tape.withColumns({"time_bin": in_bins(tape, "hours_to_tipoff", TIME_EDGES), "price_bin": in_bins(tape, "yes_price", PRICE_EDGES)}).where("time_bin IS NOT NULL AND price_bin IS NOT NULL")
    return binned.groupBy("time_bin", "price_bin").agg(
        _r(F.avg("yes_price"), "mean_price"), _r(F.avg("actual_win"), "win_rate"), F.count("*").alias("n"), F.countDistinct("ticker").alias("markets"), _r(100 * (F.avg("actual_win") - F.avg("yes_price")), "edge_cents", 4)
    )


_TEN = [i / 10 for i in range(11)]


@query(f"""{_T}, b AS (SELECT *, {_bins_sql('yes_price', _TEN, 'right')} AS bin FROM tape)
SELECT bin, count(*) AS n, round(avg(yes_price), 6) AS mean_price, round(avg(actual_win), 6) AS win_rate, round(avg(actual_win) - avg(yes_price), 6) AS bias FROM b WHERE bin IS NOT NULL GROUP BY 1""")
def a2_calibration_by_price(spark, sf_dir):
    t = D.tape(spark, sf_dir)
    return t.groupBy(in_bins(t, "yes_price", _TEN, "right").alias("bin")).agg(F.count("*").alias("n"), _r(F.avg("yes_price"), "mean_price"), _r(F.avg("actual_win"), "win_rate"), _r(F.avg("actual_win") - F.avg("yes_price"), "bias")).where("bin IS NOT NULL")


_THIRDS, _FIFTHS = [0.0, 1 / 3, 2 / 3, 1.0], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@query(f"""{_T}, b AS (SELECT *, {_bins_sql('pct_elapsed', _THIRDS)} AS elapsed, {_bins_sql('yes_price', _FIFTHS, 'right')} AS bin FROM tape)
SELECT elapsed, bin, count(*) AS n, round(avg(actual_win) - avg(yes_price), 6) AS bias FROM b WHERE elapsed IS NOT NULL AND bin IS NOT NULL GROUP BY 1, 2""")
def a3_calibration_by_time_and_price(spark, sf_dir):
    t = D.tape(spark, sf_dir)
    got = t.groupBy(in_bins(t, "pct_elapsed", _THIRDS).alias("elapsed"), in_bins(t, "yes_price", _FIFTHS, "right").alias("bin")).agg(F.count("*").alias("n"), _r(F.avg("actual_win") - F.avg("yes_price"), "bias"))
    return got.where("elapsed IS NOT NULL AND bin IS NOT NULL")


@query(f"""{_T}, w AS (SELECT *, exp(-(date_diff('microsecond', trade_time, TIMESTAMP '2024-12-31 00:00:00') / 86400e6::DOUBLE) / 30) AS w, {_bins_sql('yes_price', _FIFTHS, 'right')} AS bin FROM tape)
SELECT bin, round(sum(w * yes_price) / sum(w), 6) AS price, round(sum(w * actual_win) / sum(w), 6) AS win_rate, round(sum(w) * sum(w) / sum(w * w), 4) AS effective_n FROM w WHERE bin IS NOT NULL GROUP BY 1""")
def a4_recency_weighted_calibration(spark, sf_dir):
    """Weights fall by e in 30 days before a given day."""
    t = D.tape(spark, sf_dir)
    age = F.timestamp_diff("MICROSECOND", F.col("trade_time"), F.lit("2024-12-31 00:00:00").cast("timestamp_ntz")) / 86400e6
    t = t.select(F.exp(-age / 30).alias("w"), "yes_price", "actual_win", in_bins(t, "yes_price", _FIFTHS, "right").alias("bin")).where("bin IS NOT NULL")
    return t.groupBy("bin").agg(_r(F.sum(F.col("w") * F.col("yes_price")) / F.sum("w"), "price"), _r(F.sum(F.col("w") * F.col("actual_win")) / F.sum("w"), "win_rate"), _r(F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w")), "effective_n", 4))


@query(f"""{_T}, b AS (SELECT *, {_bins_sql('hours_to_tipoff', TIME_EDGES)} AS time_bin, {_bins_sql('yes_price', _TEN, 'right')} AS bin FROM tape)
SELECT time_bin, bin, count(*) AS n, round(avg(actual_win), 6) AS p, round(1.96::DOUBLE * sqrt(avg(actual_win) * (1 - avg(actual_win)) / count(*)), 6) AS ci FROM b WHERE bin IS NOT NULL AND time_bin IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100""")
def a5_calibration_curve(spark, sf_dir):
    t = D.tape(spark, sf_dir)
    got = t.groupBy(in_bins(t, "hours_to_tipoff", TIME_EDGES).alias("time_bin"), in_bins(t, "yes_price", _TEN, "right").alias("bin")).agg(F.count("*").alias("n"), F.avg("actual_win").alias("a"))
    got = got.where("n >= 100 AND bin IS NOT NULL AND time_bin IS NOT NULL")
    return got.select("time_bin", "bin", "n", _r(F.col("a"), "p"), _r(1.96 * F.sqrt(F.col("a") * (1 - F.col("a")) / F.col("n")), "ci"))


@query(f"{_T} SELECT * FROM (SELECT event_id, ticker, round(yes_price, 8) AS yes_price, round(least(greatest(pct_elapsed, 0), 1), 8) AS pct_elapsed, round(hours_to_tipoff, 6) AS hours FROM tape WHERE yes_price > 0.01 AND yes_price < 0.99)")
def b1_p19_tape_enrichment(spark, sf_dir):
    t = D.tape(spark, sf_dir).where("yes_price > 0.01 AND yes_price < 0.99")
    return t.select("event_id", "ticker", _r(F.col("yes_price"), "yes_price", 8), _r(F.least(F.greatest("pct_elapsed", F.lit(0.0)), F.lit(1.0)), "pct_elapsed", 8), _r(F.col("hours_to_tipoff"), "hours"))


@query(f"""{_T}, t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_time, event_id) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM tape),
a AS (SELECT ticker, median(CASE WHEN abs(hours_to_tipoff - 24) <= 7.2 THEN yes_price END) AS near, median(CASE WHEN k <= greatest(1, n // 5) THEN yes_price END) AS early FROM t GROUP BY 1)
SELECT ticker, round(coalesce(near, early), 8) AS price, near IS NULL AS fallback FROM a""")
def b2_decision_price(spark, sf_dir):
    """The median price within 0.3 h of a decision 24 hours before tip-off; without trades there, of the first fifth of the trades."""
    w = Window.partitionBy("ticker")
    t = D.tape(spark, sf_dir).withColumns({"k": F.row_number().over(w.orderBy("trade_time", "event_id")), "n": F.count("*").over(w)})
    near = F.percentile(F.when(F.abs(F.col("hours_to_tipoff") - 24) <= 7.2, F.col("yes_price")), 0.5)
    early = F.percentile(F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5)), F.col("yes_price")), 0.5)
    return t.groupBy("ticker").agg(near.alias("near"), early.alias("early")).select("ticker", _r(F.coalesce("near", "early"), "price", 8), F.col("near").isNull().alias("fallback"))


#: Strategy rules: name, hours from and to, price from and to, side.
STRATEGIES = [("fade_long", 24.0, 100000.0, 0.02, 0.25, "fade"), ("back_fav", 0.0, 100000.0, 0.75, 0.98, "back"), ("late_mid", 0.0, 24.0, 0.4, 0.6, "back")]
_STRATEGY_VALUES = ", ".join(f"({i}, '{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, '{s}')" for i, (n, a, b, c, d, s) in enumerate(STRATEGIES))
_FIRST = f"""{_T}, s(priority, strategy, h0, h1, p0, p1, side) AS (VALUES {_STRATEGY_VALUES}),
f AS (SELECT t.*, s.* FROM tape t JOIN s ON hours_to_tipoff >= h0 AND hours_to_tipoff < h1 AND yes_price >= p0 AND yes_price < p1
      QUALIFY row_number() OVER (PARTITION BY ticker, strategy ORDER BY trade_time, event_id) = 1),
p AS (SELECT *, CASE WHEN side = 'back' THEN actual_win - yes_price ELSE yes_price - actual_win END AS pnl FROM f),
c AS (SELECT *, sum(pnl) OVER w AS total FROM p WINDOW w AS (PARTITION BY strategy ORDER BY trade_time, event_id)),
m AS (SELECT *, total - greatest(max(total) OVER (PARTITION BY strategy ORDER BY trade_time, event_id), 0) AS down FROM c)"""


def first_trades(spark, sf_dir):
    """The first trade of each market that qualifies for each strategy, with its profit; the rules are a table of a few rows."""
    rules = spark.createDataFrame([(i, *s) for i, s in enumerate(STRATEGIES)], "priority int, strategy string, h0 double, h1 double, p0 double, p1 double, side string")
    fits = (F.col("hours_to_tipoff") >= F.col("h0")) & (F.col("hours_to_tipoff") < F.col("h1")) & (F.col("yes_price") >= F.col("p0")) & (F.col("yes_price") < F.col("p1"))
    found = D.tape(spark, sf_dir).join(F.broadcast(rules), fits)
    # the least struct of a group is its first trade; partial aggregation leaves one row for each task and group to shuffle
    first = found.groupBy("ticker", "strategy").agg(F.min(F.struct("trade_time", "event_id", "yes_price", "actual_win", "side")).alias("t")).select("ticker", "strategy", "t.*")
    won, price = F.col("actual_win"), F.col("yes_price")
    return first.withColumn("pnl", F.when(F.col("side") == "back", won - price).otherwise(price - won))


@query(f"""{_FIRST} SELECT strategy, count(*) AS n, round(avg(CAST(pnl > 0 AS INT)), 6) AS win_rate, round(avg(pnl), 6) AS mean_pnl, round(sum(pnl), 5) AS total_pnl, round(avg(pnl) / stddev_samp(pnl) * sqrt(count(*)), 5) AS sharpe, round(min(down), 5) AS max_drawdown FROM m GROUP BY 1""")
def b6_a14_w11_w26_strategy_pnl(spark, sf_dir):
    w = Window.partitionBy("strategy").orderBy("trade_time", "event_id")
    c = first_trades(spark, sf_dir).withColumn("total", F.sum("pnl").over(w))
    c = c.withColumn("down", F.col("total") - F.greatest(F.max("total").over(w), F.lit(0.0)))
    return c.groupBy("strategy").agg(
        F.count("*").alias("n"), _r(F.avg((F.col("pnl") > 0).cast("int")), "win_rate"), _r(F.avg("pnl"), "mean_pnl"), _r(F.sum("pnl"), "total_pnl", 5), _r(F.try_divide(F.avg("pnl"), F.stddev_samp("pnl")) * F.sqrt(F.count("*")), "sharpe", 5), _r(F.min("down"), "max_drawdown", 5)
    )


@query(f"""{_T}, last AS (SELECT * FROM tape QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_time DESC, event_id DESC) = 1),
s(priority, strategy, h0, h1, p0, p1, side) AS (VALUES {_STRATEGY_VALUES}),
b AS (SELECT *, {_bins_sql('hours_to_tipoff', TIME_EDGES)} AS time_bin, {_bins_sql('yes_price', PRICE_EDGES)} AS price_bin FROM tape),
g AS (SELECT time_bin, price_bin, round(100 * (avg(actual_win) - avg(yes_price)), 4) AS edge FROM b WHERE time_bin IS NOT NULL AND price_bin IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, {_bins_sql('hours_to_tipoff', TIME_EDGES)} AS time_bin, {_bins_sql('yes_price', PRICE_EDGES)} AS price_bin FROM last),
j AS (SELECT l.*, s.strategy, s.priority, coalesce(g.edge, 0) AS edge_cents, row_number() OVER (PARTITION BY l.ticker ORDER BY s.priority) AS k
  FROM l LEFT JOIN s ON hours_to_tipoff >= h0 AND hours_to_tipoff < h1 AND yes_price >= p0 AND yes_price < p1 LEFT JOIN g ON g.time_bin = l.time_bin AND g.price_bin = l.price_bin)
SELECT ticker, round(yes_price, 8) AS mid, round(hours_to_tipoff, 6) AS hours, strategy, edge_cents FROM j WHERE k = 1""")
def b8_b7_j21_signal_scan(spark, sf_dir):
    """Each market's last state with the first strategy that fits it and the historical edge of its cell, 0 where there is none."""
    t = D.tape(spark, sf_dir)
    last = keep_last(t, ["ticker"], F.col("trade_time"), F.col("event_id"))
    last = last.withColumns({"time_bin": in_bins(last, "hours_to_tipoff", TIME_EDGES), "price_bin": in_bins(last, "yes_price", PRICE_EDGES)})
    grid = edge_grid(t).select("time_bin", "price_bin", "edge_cents")  # as many rows as cells
    hours, price = F.col("hours_to_tipoff"), F.col("yes_price")
    strategy = F.lit(None).cast("string")
    for name, h0, h1, p0, p1, _ in reversed(STRATEGIES):
        strategy = F.when((hours >= h0) & (hours < h1) & (price >= p0) & (price < p1), F.lit(name)).otherwise(strategy)
    return last.join(F.broadcast(grid), ["time_bin", "price_bin"], "left").select("ticker", _r(price, "mid", 8), _r(hours, "hours"), strategy.alias("strategy"), F.coalesce("edge_cents", F.lit(0.0)).alias("edge_cents"))


@query(f"""{_T} SELECT ticker, time_bucket AS bar, min_by(yes_price, (trade_time, event_id)) AS open, max(yes_price) AS high, min(yes_price) AS low, max_by(yes_price, (trade_time, event_id)) AS close, count(*) AS n, CAST(sum(size) AS BIGINT) AS volume, round(sum(yes_price * size) / nullif(sum(size), 0), 6) AS vwap
FROM (SELECT *, date_trunc('hour', trade_time) AS time_bucket FROM tape) GROUP BY 1, 2""")
def st8_trade_bars(spark, sf_dir):
    """Hourly open, high, low, close, volume and volume-weighted price; the batch twin of the streaming bars."""
    from courtside.streaming.market import trade_bars

    return trade_bars(D.tape(spark, sf_dir).withColumn("bar", F.date_trunc("hour", "trade_time").cast("timestamp_ntz")), ["ticker", "bar"]).withColumn("vwap", F.round("vwap", 6))


@query(f"""{_T}, c AS (SELECT ticker, date_trunc('hour', trade_time) + INTERVAL 1 HOUR AS at, max_by(yes_price, (trade_time, event_id)) AS close FROM tape GROUP BY 1, 2),
q AS (SELECT DISTINCT ticker, tipoff - INTERVAL 2 HOUR AS cut FROM tape)
SELECT q.ticker, q.cut, c.close, c.at FROM q ASOF LEFT JOIN c ON q.ticker = c.ticker AND q.cut >= c.at""")
def j13_closing_line(spark, sf_dir):
    """The last hourly close at or before two hours ahead of tip-off."""
    t = D.tape(spark, sf_dir)
    hour = F.date_trunc("hour", "trade_time").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    candles = t.groupBy("ticker", hour.alias("at")).agg(F.max_by("yes_price", F.struct("trade_time", "event_id")).alias("close"))
    cuts = t.select("ticker", (F.col("tipoff") - F.expr("INTERVAL 2 HOUR")).alias("cut")).distinct()
    return asof(cuts, candles, ["ticker"], "cut", "at", ["close"], exact=True).select("ticker", "cut", "close", "at")


@query(f"""{_T}, c AS (SELECT ticker, yes_price, actual_win, row_number() OVER (PARTITION BY ticker ORDER BY trade_time DESC, event_id DESC) AS k FROM tape)
SELECT ticker % 5 AS model, count(*) AS n, round(avg(pow(yes_price - actual_win, 2)), 6) AS brier, round(avg(CAST((yes_price >= 0.5) = (actual_win = 1) AS INT)), 6) AS accuracy FROM c WHERE k = 1 GROUP BY 1""")
def b5_j18_closing_benchmark(spark, sf_dir):
    last = keep_last(D.tape(spark, sf_dir), ["ticker"], F.col("trade_time"), F.col("event_id"))
    right = ((F.col("yes_price") >= 0.5) == (F.col("actual_win") == 1)).cast("int")
    return last.groupBy((F.col("ticker") % 5).alias("model")).agg(F.count("*").alias("n"), _r(F.avg(F.pow(F.col("yes_price") - F.col("actual_win"), F.lit(2))), "brier"), _r(F.avg(right), "accuracy"))


@query(f"""{_T}, o AS (SELECT event_id, yes_price AS p, least(0.95::DOUBLE, 0.1::DOUBLE + (ticker * 7 % 80) / 100::DOUBLE) AS prob FROM tape),
f AS (SELECT *, ceil(round(0.07::DOUBLE * p * (1 - p) * 100, 8)) / 100 AS fee FROM o)
SELECT event_id, fee, round(prob - p, 8) AS edge, round(greatest(0, (prob - p) / (1 - p)), 8) AS kelly, CASE WHEN prob - p > fee THEN 'yes' WHEN p - prob > fee THEN 'no' END AS side, CAST(floor(1000 * least(0.05::DOUBLE, greatest(0, (prob - p) / (1 - p)))) AS BIGINT) AS contracts FROM f""")
def f19_f20_edges_and_sizes(spark, sf_dir):
    t = D.tape(spark, sf_dir).select("event_id", F.col("yes_price").alias("p"), F.least(F.lit(0.95), 0.1 + (F.col("ticker") * 7 % 80) / 100).alias("prob"))
    p, prob, cost = F.col("p"), F.col("prob"), S.fee(F.col("p"), 0.07)
    side = F.when(prob - p > cost, "yes").when(p - prob > cost, "no")
    return t.select("event_id", cost.alias("fee"), _r(prob - p, "edge", 8), _r(S.kelly(prob, p), "kelly", 8), side.alias("side"), F.floor(1000 * F.least(F.lit(0.05), S.kelly(prob, p))).alias("contracts"))


@query(f"""{_T}, q AS (SELECT ticker, percentile_cont(0.25) WITHIN GROUP (ORDER BY yes_price) AS bid, percentile_cont(0.75) WITHIN GROUP (ORDER BY yes_price) AS ask FROM tape GROUP BY 1)
SELECT t.ticker, round(bid, 8) AS bid, round(ask, 8) AS ask, CAST(sum(CASE WHEN yes_price <= bid THEN size ELSE 0 END) AS BIGINT) AS at_bid, CAST(sum(CASE WHEN yes_price >= ask THEN size ELSE 0 END) AS BIGINT) AS at_ask
FROM tape t JOIN q USING (ticker) WHERE hours_to_tipoff > 2 GROUP BY 1, 2, 3""")
def b4_quote_crossing_volume(spark, sf_dir):
    """Volume printed at or through a market's quotes, here the quartiles of its prices, until two hours before tip-off."""
    t = D.tape(spark, sf_dir)
    quotes = t.groupBy("ticker").agg(F.percentile("yes_price", 0.25).alias("bid"), F.percentile("yes_price", 0.75).alias("ask"))
    through = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0))
    got = t.where("hours_to_tipoff > 2").join(quotes, "ticker").groupBy("ticker", "bid", "ask").agg(through(F.col("yes_price") <= F.col("bid")).alias("at_bid"), through(F.col("yes_price") >= F.col("ask")).alias("at_ask"))
    return got.select("ticker", _r(F.col("bid"), "bid", 8), _r(F.col("ask"), "ask", 8), "at_bid", "at_ask")


@query(f"""{_T}, d AS (SELECT ticker, event_type AS side, CAST(round(least(value, 99)) AS INT) AS price, CAST(props->>'$.k' AS BIGINT) - 50 AS delta, ts, event_id FROM events JOIN (SELECT DISTINCT ticker FROM tape) ON user_id = ticker),
p AS (SELECT *, sum(delta) OVER w AS total FROM d WINDOW w AS (PARTITION BY ticker, side, price ORDER BY ts, event_id)),
m AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY ticker, side, price ORDER BY ts, event_id)) AS level, row_number() OVER (PARTITION BY ticker, side, price ORDER BY ts DESC, event_id DESC) AS k FROM p)
SELECT ticker, side, price, CAST(level AS BIGINT) AS size FROM m WHERE k = 1 AND level > 0""")
def st2_order_book(spark, sf_dir):
    """The book after all deltas: levels never fall below zero, which two running windows express."""
    from courtside.streaming.market import book_levels

    e = table(spark, sf_dir, "events")
    deltas = e.select(F.col("user_id").alias("ticker"), F.col("event_type").alias("side"), F.round(F.least("value", F.lit(99.0))).cast("int").alias("price"), (F.get_json_object("props", "$.k").cast("long") - 50).alias("delta"), "ts", "event_id")
    return book_levels(deltas, ["ticker", "side", "price"], ["ts", "event_id"], "delta")


@query("""WITH d AS (SELECT user_id AS ticker, event_id, event_id // 3 AS seq, ts FROM events),
l AS (SELECT *, max(seq) OVER (PARTITION BY ticker ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM d)
SELECT ticker, event_id, seq, CASE WHEN last IS NULL THEN 'first' WHEN seq <= last THEN 'duplicate' WHEN seq > last + 1 THEN 'gap' ELSE 'next' END AS state FROM l""")
def st3_sequence_check(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), "event_id", F.floor(F.col("event_id") / 3).alias("seq"), "ts")
    last = F.max("seq").over(Window.partitionBy("ticker").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    state = F.when(last.isNull(), "first").when(F.col("seq") <= last, "duplicate").when(F.col("seq") > last + 1, "gap").otherwise("next")
    return e.select("ticker", "event_id", "seq", state.alias("state"))


@query("SELECT user_id AS ticker, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events QUALIFY recency <= 5")
def st11_last_trades(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), "event_id", "ts", F.row_number().over(w).cast("long").alias("recency")).where("recency <= 5")


@query("""WITH l AS (SELECT *, CAST(coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 1800000000, true) AS INT) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l)
SELECT user_id AS ticker, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, session""")
def st9_sessions(spark, sf_dir):
    """Runs of a ticker's events without a gap of 30 minutes."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.col("user_id").alias("ticker"), F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return s.select("ticker", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "value")


@query("""WITH u AS (SELECT user_id AS ticker, ts, event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(props->>'$.k' AS BIGINT) - 50 END AS contracts FROM events)
SELECT ticker, contracts, sign(contracts)::INT AS side FROM (SELECT ticker, max_by(contracts, (ts, event_id)) AS contracts FROM u GROUP BY 1) WHERE contracts <> 0""")
def st7_positions(spark, sf_dir):
    """The last update of each ticker; zero closes a position and its sign is the side."""
    e = table(spark, sf_dir, "events")
    contracts = F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.get_json_object("props", "$.k").cast("long") - 50)
    last = e.select("user_id", "ts", "event_id", contracts.alias("c")).groupBy(F.col("user_id").alias("ticker")).agg(F.max_by("c", F.struct("ts", "event_id")).alias("contracts"))
    return last.where("contracts <> 0").withColumn("side", F.signum("contracts").cast("int"))


@query(f"""{_T}, r AS (SELECT ticker, CAST(sum(size) AS BIGINT) AS want, round(avg(yes_price), 8) AS p, ticker % 20 AS cluster FROM tape GROUP BY 1),
o AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY cluster ORDER BY p DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT ticker, cluster, CAST(greatest(0, least(want, 1000 - before)) AS BIGINT) AS granted FROM o""")
def u9_o9_capped_allocation(spark, sf_dir):
    """Contracts granted in order of preference until a cluster's 1000 are used: what is left is the cap less all earlier wishes."""
    r = D.tape(spark, sf_dir).groupBy("ticker").agg(F.sum("size").alias("want"), F.round(F.avg("yes_price"), 8).alias("p")).withColumn("cluster", F.col("ticker") % 20)
    before = F.coalesce(F.sum("want").over(Window.partitionBy("cluster").orderBy(F.desc("p"), "ticker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return r.select("ticker", "cluster", F.greatest(F.lit(0), F.least(F.col("want"), 1000 - before)).alias("granted"))


@query(f"""{_T} SELECT ticker % 20 AS cluster, count(DISTINCT ticker) AS markets, CAST(sum(size) AS BIGINT) AS contracts, round(sum(size * yes_price), 4) AS exposure FROM tape GROUP BY 1""")
def a27_cluster_exposure(spark, sf_dir):
    return D.tape(spark, sf_dir).groupBy((F.col("ticker") % 20).alias("cluster")).agg(F.countDistinct("ticker").alias("markets"), F.sum("size").alias("contracts"), _r(F.sum(F.col("size") * F.col("yes_price")), "exposure", 4))
