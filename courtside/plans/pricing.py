"""Quotes, fees, risk rules and sizing over tapes and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators import windows as W
from courtside.operators.quantiles import exact_quantiles
from courtside.plans.registry import query
from courtside.sources import domain as D
from courtside.tables import table

_T = f"WITH {D.TAPE_SQL.strip()}"
_O = f"WITH {D.OOF_SQL.strip()}"


def _r(column, name: str, digits: int = 6):
    return F.round(column, digits).alias(name)


@query(f"""{_T}, f AS (SELECT event_id, round(yes_price, 6) AS p FROM tape)
SELECT event_id, CAST(round(100 * p + 1e-7::DOUBLE) AS INT) AS fair, CAST(greatest(1, round(100 * p + 1e-7::DOUBLE) - CASE WHEN p < 0.2 OR p > 0.8 THEN 1 ELSE 2 END) AS INT) AS bid, CAST(least(99, round(100 * p + 1e-7::DOUBLE) + CASE WHEN p < 0.2 OR p > 0.8 THEN 1 ELSE 2 END) AS INT) AS ask FROM f""")
def f17_fair_quotes(spark, sf_dir):
    """Fair value in cents and quotes around it, narrower near the ends; never outside 1 to 99."""
    t = D.tape(spark, sf_dir).select("event_id", F.round("yes_price", 6).alias("p"))
    fair, half = F.round(100 * F.col("p") + 1e-7), F.when((F.col("p") < 0.2) | (F.col("p") > 0.8), 1).otherwise(2)
    return t.select("event_id", fair.cast("int").alias("fair"), F.greatest(F.lit(1), fair - half).cast("int").alias("bid"), F.least(F.lit(99), fair + half).cast("int").alias("ask"))


@query("""WITH l AS (SELECT user_id AS ticker, event_type IN ('click', 'view') AS yes, CAST(round(least(value, 99)) AS INT) AS price FROM events),
t AS (SELECT ticker, max(CASE WHEN yes THEN price END) AS best_yes, 100 - max(CASE WHEN NOT yes THEN price END) AS best_ask FROM l GROUP BY 1)
SELECT ticker, CASE WHEN best_yes < best_ask THEN best_yes END AS bid, CASE WHEN best_yes < best_ask THEN best_ask END AS ask, CASE WHEN best_yes < best_ask THEN (best_yes + best_ask) / 2.0::DOUBLE END AS mid FROM t""")
def f18_f30_f31_top_of_book(spark, sf_dir):
    """Best bid from the yes side, best ask from the no side; a crossed book has neither."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), F.col("event_type").isin("click", "view").alias("yes"), F.round(F.least("value", F.lit(99.0))).cast("int").alias("price"))
    t = e.groupBy("ticker").agg(F.max(F.when(F.col("yes"), F.col("price"))).alias("b"), (100 - F.max(F.when(~F.col("yes"), F.col("price")))).alias("a"))
    there = F.col("b") < F.col("a")
    return t.select("ticker", F.when(there, F.col("b")).alias("bid"), F.when(there, F.col("a")).alias("ask"), F.when(there, (F.col("a") + F.col("b")) / 2.0).alias("mid"))


@query(f"""{_T}, p AS (SELECT DISTINCT CAST(round(100 * yes_price) AS INT) AS cents FROM tape)
SELECT cents, ceil(round(0.07::DOUBLE * cents * (100 - cents) / 100.0::DOUBLE, 8)) / 100 AS taker, ceil(round(0.0175::DOUBLE * cents * (100 - cents) / 100.0::DOUBLE, 8)) / 100 AS maker FROM p""")
def f32_fee_table(spark, sf_dir):
    """Fees at every price that occurs."""
    p = D.tape(spark, sf_dir).select(F.round(100 * F.col("yes_price")).cast("int").alias("cents")).distinct()
    at = lambda rate: F.ceil(F.round(rate * F.col("cents") * (100 - F.col("cents")) / 100.0, 8)) / 100
    return p.select("cents", at(0.07).alias("taker"), at(0.0175).alias("maker"))


@query(f"""{_T}, x AS (SELECT ticker, CAST(sum(size) AS BIGINT) AS contracts, round(sum(size * yes_price), 4) AS exposure, count(*) AS n FROM tape GROUP BY 1)
SELECT ticker, CASE WHEN n < 20 THEN 'too few trades' WHEN exposure > 20000 THEN 'exposure' WHEN contracts > 40000 THEN 'contracts' WHEN ticker % 13 = 0 THEN 'blocked' END AS reason FROM x""")
def p20_risk_rules(spark, sf_dir):
    """The first rule that a market breaks, null if none."""
    x = D.tape(spark, sf_dir).groupBy("ticker").agg(F.sum("size").alias("contracts"), F.round(F.sum(F.col("size") * F.col("yes_price")), 4).alias("exposure"), F.count("*").alias("n"))
    reason = F.when(F.col("n") < 20, "too few trades").when(F.col("exposure") > 20000, "exposure").when(F.col("contracts") > 40000, "contracts").when(F.col("ticker") % 13 == 0, "blocked")
    return x.select("ticker", reason.alias("reason"))


_SPREAD = "greatest(pred_a, pred_b, pred_c) - least(pred_a, pred_b, pred_c)"


@query(f"""{_O}, s AS (SELECT *, round({_SPREAD}, 9) AS gap FROM oof), e AS (SELECT quantile_cont(gap, 1 / 3.0) AS lo, quantile_cont(gap, 2 / 3.0) AS hi FROM s),
t AS (SELECT CASE WHEN gap <= lo THEN 'high' WHEN gap <= hi THEN 'medium' ELSE 'low' END AS tier, CAST((pred_a > 15) = (y_true > 15) AS INT) AS right_ FROM s, e)
SELECT tier, count(*) AS n, round(avg(right_), 6) AS accuracy, round(least(2.0, greatest(0.2, avg(right_) / (SELECT avg(right_) FROM t))), 6) AS multiplier FROM t GROUP BY 1""")
def a23_f23_confidence_tiers(spark, sf_dir):
    """Tiers by thirds of the models' disagreement, their accuracy and a sizing multiplier; edges and the mean are one row each."""
    three = [F.col(c) for c in ("pred_a", "pred_b", "pred_c")]
    s = D.oof(spark, sf_dir).select(F.round(F.greatest(*three) - F.least(*three), 9).alias("gap"), ((F.col("pred_a") > 15) == (F.col("y_true") > 15)).cast("int").alias("right"))
    low, high = exact_quantiles(s, F.col("gap"), [1 / 3, 2 / 3])
    t = s.crossJoin(F.broadcast(s.agg(F.avg("right").alias("all")))).withColumn("tier", F.when(F.col("gap") <= low, "high").when(F.col("gap") <= high, "medium").otherwise("low"))
    return t.groupBy("tier").agg(F.count("*").alias("n"), _r(F.avg("right"), "accuracy"), _r(F.least(F.lit(2.0), F.greatest(F.lit(0.2), F.avg("right") / F.max("all"))), "multiplier"))


@query(f"""{_T}, g AS (SELECT ticker, ticker % 20 AS game, round(avg(abs(yes_price - 0.5)), 9) AS score FROM tape GROUP BY 1),
s AS (SELECT game, sum(score) AS score, count(*) AS n FROM g GROUP BY 1)
SELECT game, n, round(greatest(0.3::DOUBLE / count(*) OVER (), least(0.25::DOUBLE, score / sum(score) OVER ())), 6) AS share FROM s""")
def a28_budget_shares(spark, sf_dir):
    """Shares of a budget by score, at least 30 % of an equal share and a quarter at most; totals are one row."""
    g = D.tape(spark, sf_dir).groupBy("ticker").agg(F.round(F.avg(F.abs(F.col("yes_price") - 0.5)), 9).alias("score"))
    s = g.groupBy((F.col("ticker") % 20).alias("game")).agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    total = s.agg(F.sum("score").alias("all"), F.count("*").alias("games"))
    return s.crossJoin(F.broadcast(total)).select("game", "n", _r(F.greatest(0.3 / F.col("games"), F.least(F.lit(0.25), F.col("score") / F.col("all"))), "share"))


@query(f"""{_O}, s AS (SELECT {_SPREAD} AS gap FROM oof) SELECT round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS std, round(quantile_cont(gap, 0.5), 6) AS median, round(quantile_cont(gap, 0.75), 6) AS p75, round(quantile_cont(gap, 0.95), 6) AS p95 FROM s""")
def a33_disagreement_stats(spark, sf_dir):
    three = [F.col(c) for c in ("pred_a", "pred_b", "pred_c")]
    s = D.oof(spark, sf_dir).select((F.greatest(*three) - F.least(*three)).alias("gap"))
    found = exact_quantiles(s, F.col("gap"), [0.5, 0.75, 0.95])
    return s.agg(_r(F.avg("gap"), "mean"), _r(F.stddev_samp("gap"), "std"), *[_r(F.lit(q), n) for q, n in zip(found, ("median", "p75", "p95"), strict=True)])


@query(f"""{_O}, u AS (SELECT season, 'pred_a' AS feature, avg(abs(pred_a - y_true)) AS s FROM oof GROUP BY 1 UNION ALL SELECT season, 'pred_b', avg(abs(pred_b - y_true)) FROM oof GROUP BY 1 UNION ALL SELECT season, 'pred_c', avg(abs(pred_c - y_true)) FROM oof GROUP BY 1)
SELECT feature, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(stddev_samp(s) / avg(s), 5) AS cv, round(quantile_cont(s, 0.5), 6) AS median FROM u GROUP BY 1""")
def a29_fold_summary(spark, sf_dir):
    long = D.oof(spark, sf_dir).unpivot(["season", "y_true"], ["pred_a", "pred_b", "pred_c"], "feature", "pred")
    u = long.groupBy("season", "feature").agg(F.avg(F.abs(F.col("pred") - F.col("y_true"))).alias("s"))
    return u.groupBy("feature").agg(_r(F.avg("s"), "mean"), _r(F.stddev_samp("s"), "std"), _r(F.stddev_samp("s") / F.avg("s"), "cv", 5), _r(F.percentile("s", 0.5), "median"))


#: The grid of a parameter sweep: least edge, Kelly fraction, cap.
SWEEP = [(e, k, 0.05) for e in (0.0, 0.02, 0.05) for k in (0.25, 0.5)]
_SWEEP = ", ".join(f"({e}::DOUBLE, {k}::DOUBLE, {c}::DOUBLE)" for e, k, c in SWEEP)


@query(f"""{_T}, s(min_edge, fraction, cap) AS (VALUES {_SWEEP}), o AS (SELECT yes_price AS p, actual_win AS won, least(0.95::DOUBLE, 0.1::DOUBLE + (ticker * 7 % 80) / 100::DOUBLE) AS prob FROM tape),
f AS (SELECT *, ceil(round(0.07::DOUBLE * p * (1 - p) * 100, 8)) / 100 AS fee FROM o), b AS (SELECT *, least(cap, fraction * greatest(0, (prob - p) / (1 - p))) AS stake FROM f, s WHERE prob - p - fee > min_edge)
SELECT min_edge, fraction, count(*) AS n, round(avg(won), 6) AS win_rate, round(sum(stake * (won - p - fee) / p), 4) AS pnl FROM b GROUP BY 1, 2""")
def b3_entry_sweep(spark, sf_dir):
    """Directional entries over a grid of parameters, a table of six rows."""
    grid = spark.createDataFrame(SWEEP, "min_edge double, fraction double, cap double")
    o = D.tape(spark, sf_dir).select(F.col("yes_price").alias("p"), F.col("actual_win").alias("won"), F.least(F.lit(0.95), 0.1 + (F.col("ticker") * 7 % 80) / 100).alias("prob"))
    o = o.withColumn("fee", S.fee(F.col("p"), 0.07)).join(F.broadcast(grid), F.col("prob") - F.col("p") - F.col("fee") > F.col("min_edge"))
    stake = F.least("cap", F.col("fraction") * S.kelly(F.col("prob"), F.col("p")))
    return o.groupBy("min_edge", "fraction").agg(F.count("*").alias("n"), _r(F.avg("won"), "win_rate"), _r(F.sum(stake * (F.col("won") - F.col("p") - F.col("fee")) / F.col("p")), "pnl", 4))


@query(f"""{_O} SELECT game_id, line, round(abs(prob - 1 / (1 + exp(-(pred_a - 15) / 3))), 6) AS prob_gap, round(abs(pred_a + pred_b - 2 * pred_c), 6) AS additivity, CASE WHEN abs(prob - 1 / (1 + exp(-(pred_a - 15) / 3))) > 0.3 THEN 'conflict' WHEN abs(pred_a + pred_b - 2 * pred_c) > 1.5 THEN 'check' ELSE 'ok' END AS verdict FROM oof""")
def f25_consistency(spark, sf_dir):
    """Whether the probability model and the score models agree."""
    a, b, c = F.col("pred_a"), F.col("pred_b"), F.col("pred_c")
    gap, add = F.abs(F.col("prob") - 1 / (1 + F.exp(-(a - 15) / 3))), F.abs(a + b - 2 * c)
    return D.oof(spark, sf_dir).select("game_id", "line", _r(gap, "prob_gap"), _r(add, "additivity"), F.when(gap > 0.3, "conflict").when(add > 1.5, "check").otherwise("ok").alias("verdict"))


@query(f"""WITH {D.GAMES_SQL} SELECT game_id, round(pow((home_pts / (home_pts + away_pts)::DOUBLE), 2) + pow(away_pts / (home_pts + away_pts)::DOUBLE, 2) + 1e-9::DOUBLE, 6) AS concentration, round(1 / (1 + pow(10.0::DOUBLE, -(home_pts - away_pts) / 15.0::DOUBLE)), 6) AS logit_prob,
  round(0.4 * (home_pts / 100.0::DOUBLE) - 0.25 * (away_pts / 100.0::DOUBLE) + 0.2 * attendance / 20000.0::DOUBLE, 6) AS composite, round((home_pts + away_pts) / 2.0::DOUBLE, 3) AS pace, abs(home_pts - away_pts) AS mismatch FROM games""")
def f4_f5_f7_f9_game_factors(spark, sf_dir):
    h, a = F.col("home_pts"), F.col("away_pts")
    share = h / (h + a)
    return D.games(spark, sf_dir).select(
        "game_id", _r(share * share + (1 - share) * (1 - share) + 1e-9, "concentration"), _r(S.elo_probability(h - a, 15.0), "logit_prob"), _r(0.4 * h / 100.0 - 0.25 * a / 100.0 + 0.2 * F.col("attendance") / 20000.0, "composite"), _r((h + a) / 2.0, "pace", 3), F.abs(h - a).alias("mismatch")
    )


@query(f"""{_T}, last AS (SELECT ticker, arg_max(event_type, (trade_time, event_id)) AS signal FROM tape GROUP BY 1)
SELECT event_id, CASE WHEN l.signal = 'error' THEN 0.5 WHEN l.signal = t.event_type THEN 1.25 ELSE 1.0 END::DOUBLE AS multiplier FROM tape t JOIN last l USING (ticker)""")
def b10_signal_agreement(spark, sf_dir):
    """A multiplier by whether a trade agrees with its market's latest signal."""
    t = D.tape(spark, sf_dir)
    last = t.groupBy("ticker").agg(F.max_by("event_type", F.struct("trade_time", "event_id")).alias("signal"))
    m = F.when(F.col("signal") == "error", 0.5).when(F.col("signal") == F.col("event_type"), 1.25).otherwise(1.0)
    return t.join(last, "ticker").select("event_id", m.cast("double").alias("multiplier"))


@query(f"""{_O} SELECT season, 0.5::DOUBLE AS base, round(avg(prob), 6) AS mean_prob, round(avg(CASE WHEN prob > 0.5 THEN 1 - label ELSE label END), 6) AS upset_rate FROM oof GROUP BY 1""")
def f22_upsets(spark, sf_dir):
    p, y = F.col("prob"), F.col("label")
    return D.oof(spark, sf_dir).groupBy("season").agg(F.lit(0.5).alias("base"), _r(F.avg(p), "mean_prob"), _r(F.avg(F.when(p > 0.5, 1 - y).otherwise(y)), "upset_rate"))


@query()
def f28_f29_normal_pricing(spark, sf_dir):
    """Probability that the score passes a line under a normal error of the season's spread, and what it is called."""
    o = D.oof(spark, sf_dir)
    scale = o.groupBy("season").agg(F.stddev_samp(F.col("y_true") - F.col("pred_a")).alias("sd"))  # one row for each season
    p = S.normal_cdf((F.col("pred_a") - 15) / F.col("sd"))
    return o.join(F.broadcast(scale), "season").select("game_id", "line", _r(p, "over_prob"), F.when(p > 0.75, "likely").when(p < 0.25, "unlikely").otherwise("open").alias("label"))


@query(f"""WITH {D.HISTORY_SQL}, l AS (SELECT team_id, game_id, list(CAST(win AS VARCHAR)) OVER (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS last FROM history),
f AS (SELECT team_id, game_id, last, list_reduce(list_prepend({{'seen': []::VARCHAR[], 'word': ''}}, list_transform(last, lambda x: {{'seen': []::VARCHAR[], 'word': x}})),
  lambda s, e: {{'seen': CASE WHEN list_contains(s.seen, s.word || e.word) THEN s.seen ELSE list_append(s.seen, s.word || e.word) END, 'word': CASE WHEN list_contains(s.seen, s.word || e.word) THEN s.word || e.word ELSE '' END}}) AS r FROM l)
SELECT team_id, game_id, CASE WHEN len(last) >= 5 THEN round(len(r.seen) / len(last)::DOUBLE, 6) END AS complexity FROM f""")
def w14_lempel_ziv(spark, sf_dir):
    """Distinct words that a left-to-right parse of the last 20 results into new words finds, over their number."""
    h = W.in_blocks(D.team_history(D.games(spark, sf_dir)), 20, "team_id")
    w = W.lagged(20, "team_id", W.BLOCK)
    h = W.own_rows(h, "team_id", "game_id", F.collect_list(F.col("win").cast("string")).over(w).alias("last"))
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.lit("").alias("word"))

    def step(s, x):
        word = F.concat(s["word"], x)
        known = F.array_contains(s["seen"], word)
        return F.struct(F.when(known, s["seen"]).otherwise(F.array_append(s["seen"], word)).alias("seen"), F.when(known, word).otherwise("").alias("word"))

    words = F.aggregate("last", zero, step, lambda s: F.size(s["seen"]))
    return h.select("team_id", "game_id", F.when(F.size("last") >= 5, F.round(words / F.size("last"), 6)).alias("complexity"))
