"""Model evaluation over out-of-fold predictions, and feature statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators import windows as W
from courtside.operators.quantiles import exact_quantiles, exact_quantiles_of
from courtside.operators.joins import in_bins
from courtside.plans.registry import query
from courtside.sources import domain as D
from courtside.tables import table

_O = f"WITH {D.OOF_SQL.strip()}"
_LL = "-(label * ln(least(greatest(prob, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)) + (1 - label) * ln(1 - least(greatest(prob, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)))"


def _r(column, name: str, digits: int = 6):
    return F.round(column, digits).alias(name)


def _long(spark, sf_dir):
    """season, y_true, model, pred: the three predictions as rows."""
    return D.oof(spark, sf_dir).unpivot(["game_id", "line", "season", "y_true"], ["pred_a", "pred_b", "pred_c"], "model", "pred")


_LONG = f"""{_O}, long AS (SELECT game_id, line, season, y_true, 'pred_a' AS model, pred_a AS pred FROM oof UNION ALL SELECT game_id, line, season, y_true, 'pred_b', pred_b FROM oof UNION ALL SELECT game_id, line, season, y_true, 'pred_c', pred_c FROM oof)"""


@query(f"""{_LONG} SELECT model, season, count(*) AS n, round(avg(abs(pred - y_true)), 6) AS mae, round(sqrt(avg(pow(pred - y_true, 2))), 6) AS rmse,
  round(avg(CASE WHEN abs(pred - y_true) <= 0.5 THEN 0.5 * pow(pred - y_true, 2) ELSE 0.5 * (abs(pred - y_true) - 0.25) END), 6) AS huber FROM long GROUP BY 1, 2""")
def a16_l12_regression_metrics(spark, sf_dir):
    e = F.col("pred") - F.col("y_true")
    huber = F.when(F.abs(e) <= 0.5, 0.5 * e * e).otherwise(0.5 * (F.abs(e) - 0.25))
    return _long(spark, sf_dir).groupBy("model", "season").agg(F.count("*").alias("n"), _r(F.avg(F.abs(e)), "mae"), _r(F.sqrt(F.avg(e * e)), "rmse"), _r(F.avg(huber), "huber"))


@query(f"""{_O}, r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY prob) + (count(*) OVER (PARTITION BY season, prob) - 1) / 2.0::DOUBLE AS rk FROM oof)
SELECT season, count(*) AS n, round(avg(pow(prob - label, 2)), 6) AS brier, round(avg({_LL}), 6) AS log_loss, round(avg(CAST((prob >= 0.5) = (label = 1) AS INT)), 6) AS accuracy,
  round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label)))::DOUBLE, 6) AS auc FROM r GROUP BY 1""")
def a16_classification_metrics(spark, sf_dir):
    """Brier score, log-loss, accuracy and AUC; the AUC needs ranks within a season, from counts of each score rather than a sort of rows."""
    o = D.oof(spark, sf_dir)
    y, p = F.col("label"), F.col("prob")
    totals = o.groupBy("season").agg(F.count("*").alias("n"), _r(F.avg(F.pow(p - y, F.lit(2))), "brier"), _r(F.avg(S.log_loss(y, p)), "log_loss"), _r(F.avg(((p >= 0.5) == (y == 1)).cast("int")), "accuracy"))
    scores = o.groupBy("season", "prob").agg(F.count("*").alias("c"), F.sum("label").alias("pos"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("season").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = scores.withColumn("rank", below + (F.col("c") + 1) / 2).groupBy("season").agg(F.sum(F.col("pos") * F.col("rank")).alias("sum"), F.sum("pos").alias("pos"), F.sum("c").alias("all"))
    auc = ranks.select("season", _r((F.col("sum") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * (F.col("all") - F.col("pos"))), "auc"))
    return totals.join(auc, "season")


@query(f"""{_LONG}, s AS (SELECT model, season, avg(abs(pred - y_true)) AS mae, avg(abs(y_true)) AS scale FROM long GROUP BY 1, 2),
w AS (SELECT *, exp(0.3::DOUBLE * (row_number() OVER (PARTITION BY model ORDER BY season) - 1)) AS w FROM s)
SELECT model, round(sum(w * mae) / sum(w), 6) AS weighted_mae, round(sum(w * mae / scale) / sum(w), 6) AS weighted_nmae, count(*) AS seasons FROM w GROUP BY 1""")
def a17_recency_weighted_error(spark, sf_dir):
    s = _long(spark, sf_dir).groupBy("model", "season").agg(F.avg(F.abs(F.col("pred") - F.col("y_true"))).alias("mae"), F.avg(F.abs("y_true")).alias("scale"))
    s = s.withColumn("w", F.exp(0.3 * (F.row_number().over(Window.partitionBy("model").orderBy("season")) - 1)))
    return s.groupBy("model").agg(_r(F.sum(F.col("w") * F.col("mae")) / F.sum("w"), "weighted_mae"), _r(F.sum(F.col("w") * F.col("mae") / F.col("scale")) / F.sum("w"), "weighted_nmae"), F.count("*").alias("seasons"))


@query(f"""{_O} SELECT CAST(line_at AS BIGINT) AS line_at, round(avg(CAST((y_true > line_at) = (pred_a > line_at) AS INT)), 6) AS accuracy, round(avg(CAST(y_true > line_at AS INT)), 6) AS over_rate, round(avg(CAST(abs(y_true - pred_a) >= line_at / 100.0::DOUBLE AS INT)), 6) AS tail FROM oof, generate_series(10, 20) AS t(line_at) GROUP BY 1""")
def a18_a19_over_under_lines(spark, sf_dir):
    """Accuracy at each of eleven lines and the share of errors beyond a threshold: rows are exploded by a constant, summed in each task."""
    o = D.oof(spark, sf_dir).select("y_true", "pred_a", F.explode(F.sequence(F.lit(10).cast("long"), F.lit(20).cast("long"))).alias("line_at"))
    y, p, at = F.col("y_true"), F.col("pred_a"), F.col("line_at")
    return o.groupBy("line_at").agg(_r(F.avg(((y > at) == (p > at)).cast("int")), "accuracy"), _r(F.avg((y > at).cast("int")), "over_rate"), _r(F.avg((F.abs(y - p) >= at / 100.0).cast("int")), "tail"))


_SD = "sqrt((pow(pred_a - m, 2) + pow(pred_b - m, 2) + pow(pred_c - m, 2)) / 3)"


@query(f"""{_O}, s AS (SELECT *, {_SD} AS sd FROM (SELECT *, (pred_a + pred_b + pred_c) / 3 AS m FROM oof)),
e AS (SELECT quantile_cont(round(sd, 9), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM s),
d AS (SELECT len(list_filter(q, lambda x: x < round(sd, 9))) AS decile, abs(m - y_true) AS err FROM s, e),
t AS (SELECT avg(err) AS overall FROM d)
SELECT decile, count(*) AS n, round(avg(err), 6) AS mae, round(CASE WHEN count(*) < 100 THEN 1.0 ELSE least(2.0, greatest(0.2, any_value(overall) / avg(err))) END, 6) AS multiplier FROM d, t GROUP BY 1""")
def a20_a35_disagreement_deciles(spark, sf_dir):
    """Error by decile of the models' disagreement; edges and the overall error are one aggregated row."""
    o = D.oof(spark, sf_dir)
    m = (F.col("pred_a") + F.col("pred_b") + F.col("pred_c")) / 3
    o = o.withColumn("m", m).withColumn("sd", F.round(F.sqrt((F.pow(F.col("pred_a") - F.col("m"), F.lit(2)) + F.pow(F.col("pred_b") - F.col("m"), F.lit(2)) + F.pow(F.col("pred_c") - F.col("m"), F.lit(2))) / 3), 9))
    o = o.select("sd", F.abs(F.col("m") - F.col("y_true")).alias("err"))
    edges = F.array(*map(F.lit, exact_quantiles(o, F.col("sd"), [i / 10 for i in range(1, 10)])))
    d = o.crossJoin(F.broadcast(o.agg(F.avg("err").alias("overall")))).withColumn("decile", F.size(F.filter(edges, lambda x: x < F.col("sd"))).cast("long"))
    multiplier = F.when(F.count("*") < 100, 1.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.2), F.max("overall") / F.avg("err"))))
    return d.groupBy("decile").agg(F.count("*").alias("n"), _r(F.avg("err"), "mae"), _r(multiplier, "multiplier"))


_BUCKETS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0, 100.0]


@query(f"""{_O}, b AS (SELECT abs(pred_a - y_true) AS e FROM oof)
SELECT CASE {" ".join(f"WHEN e >= {a}::DOUBLE AND e < {b}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(_BUCKETS, _BUCKETS[1:], strict=False)))} END AS bucket, count(*) AS n, round(avg(e), 6) AS mean_error, round(avg(CAST(e <= 0.5 AS INT)), 6) AS within FROM b GROUP BY 1""")
def a21_error_buckets(spark, sf_dir):
    o = D.oof(spark, sf_dir).select(F.abs(F.col("pred_a") - F.col("y_true")).alias("e"))
    return o.groupBy(in_bins(o, "e", _BUCKETS).alias("bucket")).agg(F.count("*").alias("n"), _r(F.avg("e"), "mean_error"), _r(F.avg((F.col("e") <= 0.5).cast("int")), "within"))


@query(f"{_O} SELECT CAST(floor(pred_a) AS BIGINT) AS bin, count(*) AS n, round(stddev_samp(pred_a - y_true), 5) AS spread FROM oof GROUP BY 1")
def a22_heteroscedasticity(spark, sf_dir):
    return D.oof(spark, sf_dir).groupBy(F.floor("pred_a").alias("bin")).agg(F.count("*").alias("n"), _r(F.stddev_samp(F.col("pred_a") - F.col("y_true")), "spread", 5))


@query(f"""{_O}, u AS (SELECT 'y_true' AS name, y_true AS x FROM oof UNION ALL SELECT 'pred_a', pred_a FROM oof UNION ALL SELECT 'prob', prob FROM oof)
SELECT name, count(*) AS n, round(min(x), 6) AS low, round(quantile_cont(x, 0.05), 6) AS p5, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, round(max(x), 6) AS high, round(avg(x), 6) AS mean, round(stddev_samp(x), 5) AS std FROM u GROUP BY 1""")
def a25_column_profile(spark, sf_dir):
    o, names = D.oof(spark, sf_dir), ["y_true", "pred_a", "prob"]
    at = exact_quantiles_of(o, {name: F.col(name) for name in names}, [0.05, 0.5, 0.95])

    def quantile(k: int):
        return F.round(F.create_map(*[x for name in names for x in (F.lit(name), F.lit(at[name][k]))])[F.col("name")], 6)

    stats = o.unpivot([], names, "name", "x").groupBy("name").agg(F.count("*").alias("n"), _r(F.min("x"), "low"), _r(F.max("x"), "high"), _r(F.avg("x"), "mean"), _r(F.stddev_samp("x"), "std", 5))
    return stats.select("name", "n", "low", *[quantile(k).alias(f"p{p}") for k, p in enumerate((5, 50, 95))], "high", "mean", "std")


@query(f"WITH {D.GAMES_SQL} SELECT season, season_type, count(*) AS n, round(avg(home_pts + away_pts), 6) AS mean_total, round(stddev_samp(home_pts + away_pts), 6) AS std_total FROM games GROUP BY ROLLUP (season, season_type)")
def a11_seasonal_trend(spark, sf_dir):
    total = F.col("home_pts") + F.col("away_pts")
    return D.games(spark, sf_dir).rollup("season", "season_type").agg(F.count("*").alias("n"), _r(F.avg(total), "mean_total"), _r(F.stddev_samp(total), "std_total"))


@query(f"""WITH {D.GAMES_SQL}, m AS (SELECT season, avg(s) AS m FROM (SELECT season, home_pts - away_pts AS s FROM games) GROUP BY 1),
c AS (SELECT season, avg(pow(s - m, 2)) AS v, avg(pow(s - m, 3)) AS k3, avg(pow(s - m, 4)) AS k4, any_value(m) AS m FROM (SELECT season, home_pts - away_pts AS s FROM games) JOIN m USING (season) GROUP BY 1)
SELECT season, round(m, 6) AS mean, round(k3 / pow(v, 1.5), 5) AS skew, round(k4 / (v * v) - 3, 5) AS kurtosis FROM c""")
def a12_m16_moments(spark, sf_dir):
    g = D.games(spark, sf_dir).withColumn("s", F.col("home_pts") - F.col("away_pts"))
    return g.groupBy("season").agg(_r(F.avg("s"), "mean"), _r(F.skewness("s"), "skew", 5), _r(F.kurtosis("s"), "kurtosis", 5))


@query(f"WITH {D.GAMES_SQL} SELECT home_team_id, max(attendance) AS largest, round(quantile_cont(attendance, 0.95), 4) AS p95 FROM games GROUP BY 1")
def a9_arena_capacity(spark, sf_dir):
    return D.games(spark, sf_dir).groupBy("home_team_id").agg(F.max("attendance").alias("largest"), _r(F.percentile("attendance", 0.95), "p95", 4))


@query(f"""WITH {D.GAMES_SQL}, d AS (SELECT DISTINCT season, game_date FROM games)
SELECT season, game_date, round(dense_rank() OVER (PARTITION BY season ORDER BY game_date) / count(*) OVER (PARTITION BY season)::DOUBLE, 8) AS progress FROM d""")
def a10_season_progress(spark, sf_dir):
    d = D.games(spark, sf_dir).select("season", "game_date").distinct()
    return d.select("season", "game_date", _r(F.dense_rank().over(Window.partitionBy("season").orderBy("game_date")) / F.count("*").over(Window.partitionBy("season")), "progress", 8))


@query(f"""WITH {D.RATINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY as_of_date ORDER BY rating DESC, team_id) AS rk FROM snaps)
SELECT as_of_date, count(*) AS teams, max(rk) AS worst, count(DISTINCT rk) = max(rk) AND count(*) = max(rk) AS complete FROM r GROUP BY 1""")
def a13_rank_check(spark, sf_dir):
    w = Window.partitionBy("as_of_date").orderBy(F.desc("rating"), "team_id")
    r = D.rating_snapshots(spark, sf_dir).withColumn("rk", F.row_number().over(w).cast("long"))
    return r.groupBy("as_of_date").agg(F.count("*").alias("teams"), F.max("rk").alias("worst"), ((F.countDistinct("rk") == F.max("rk")) & (F.count("*") == F.max("rk"))).alias("complete"))


@query(f"""{_O} SELECT round(corr(pred_a, pred_b), 6) AS ab, round(corr(pred_a, pred_c), 6) AS ac, round(corr(pred_b, pred_c), 6) AS bc, round(corr(pred_a - y_true, pred_b - y_true), 6) AS errors_ab, round(covar_samp(pred_a, pred_b), 5) AS cov_ab FROM oof""")
def m1_l5_l9_correlations(spark, sf_dir):
    """All pairs in one aggregation."""
    y = F.col("y_true")
    return D.oof(spark, sf_dir).agg(_r(F.corr("pred_a", "pred_b"), "ab"), _r(F.corr("pred_a", "pred_c"), "ac"), _r(F.corr("pred_b", "pred_c"), "bc"), _r(F.corr(F.col("pred_a") - y, F.col("pred_b") - y), "errors_ab"), _r(F.covar_samp("pred_a", "pred_b"), "cov_ab", 5))


@query(f"""{_O}, s AS (SELECT DISTINCT season FROM oof) SELECT season, CAST((dense_rank() OVER (ORDER BY season) - 1) % 3 AS INT) AS fold FROM s""")
def m5_season_folds(spark, sf_dir):
    """Folds of the seasons; the ranked table has one row for each season."""
    s = D.oof(spark, sf_dir).select("season").distinct()
    return s.select("season", ((F.dense_rank().over(Window.orderBy("season")) - 1) % 3).cast("int").alias("fold"))


@query(f"""{_O}, d AS (SELECT game_id, avg(abs(pred_a - y_true)) - avg(abs(pred_b - y_true)) AS d FROM oof GROUP BY 1),
a AS (SELECT round(d, 9) AS d FROM d WHERE round(d, 9) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk FROM a)
SELECT count(*) AS n, round(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), 3) AS w_plus, round(sum(CASE WHEN d < 0 THEN rk ELSE 0 END), 3) AS w_minus FROM r""")
def m9_wilcoxon(spark, sf_dir):
    """Signed-rank sums of two models' errors by game. Ranks come from counts of each size of difference: sizes are put in
    ranges, the ranges' totals (one row for each range) are summed up, and ranks are completed within each range."""
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("y_true")))
    d = D.oof(spark, sf_dir).groupBy("game_id").agg(F.round(err("pred_a") - err("pred_b"), 9).alias("d")).where("d <> 0")
    sizes = d.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("pos")).withColumn("range", F.floor(F.col("size") * 1000))
    totals = sizes.groupBy("range").agg(F.sum("c").alias("all"))
    starts = totals.select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("range").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("inside", inside).join(starts, "range").withColumn("rank", F.col("start") + F.col("inside") + (F.col("c") + 1) / 2)
    return ranked.agg(F.sum("c").alias("n"), _r(F.sum(F.col("pos") * F.col("rank")), "w_plus", 3), _r(F.sum((F.col("c") - F.col("pos")) * F.col("rank")), "w_minus", 3))


@query(f"""{_O} SELECT game_id, line, round((CASE WHEN abs(pred_a - med) <= 0.6 THEN pred_a ELSE 0 END + CASE WHEN abs(pred_b - med) <= 0.6 THEN pred_b ELSE 0 END + CASE WHEN abs(pred_c - med) <= 0.6 THEN pred_c ELSE 0 END)
  / (CAST(abs(pred_a - med) <= 0.6 AS INT) + CAST(abs(pred_b - med) <= 0.6 AS INT) + CAST(abs(pred_c - med) <= 0.6 AS INT)) + 1e-9::DOUBLE, 6) AS blend, round(med + 1e-9::DOUBLE, 6) AS median
FROM (SELECT *, pred_a + pred_b + pred_c - greatest(pred_a, pred_b, pred_c) - least(pred_a, pred_b, pred_c) AS med FROM oof)""")
def f24_f33_robust_blend(spark, sf_dir):
    """The mean of the models near their median; values are nudged off rounding ties."""
    three = [F.col(c) for c in ("pred_a", "pred_b", "pred_c")]
    o = D.oof(spark, sf_dir).withColumn("med", three[0] + three[1] + three[2] - F.greatest(*three) - F.least(*three))
    near = [F.when(F.abs(c - F.col("med")) <= 0.6, c) for c in three]
    return o.select("game_id", "line", _r(S.mean_of(*near) + 1e-9, "blend"), _r(F.col("med") + 1e-9, "median"))


@query(f"""WITH {D.GAMES_SQL}, {D.ARENAS_SQL}, t AS (SELECT game_id, lat, lon, LAG(lat) OVER w AS plat, LAG(lon) OVER w AS plon FROM games JOIN arenas ON team_id = home_team_id WINDOW w AS (PARTITION BY away_team_id ORDER BY game_date, game_id))
SELECT game_id, round((lon - plon) / 15, 6) AS shift, CASE WHEN (lon - plon) / 15 > 0.5 THEN 1 WHEN (lon - plon) / 15 < -0.5 THEN -1 ELSE 0 END AS direction, round(1.5 * greatest(0, (lon - plon) / 15) + greatest(0, (plon - lon) / 15), 6) AS fatigue FROM t WHERE plat IS NOT NULL""")
def f1_f2_f3_travel(spark, sf_dir):
    g = D.games(spark, sf_dir).join(D.arenas(spark, sf_dir), F.col("team_id") == F.col("home_team_id"))
    previous = F.lag("lon").over(W.by("away_team_id", W.BLOCK))
    g = W.own_rows(W.in_blocks(g, 1, "away_team_id"), "game_id", "lon", previous.alias("plon")).where("plon IS NOT NULL")
    shift = S.timezone_hours(F.col("lon")) - S.timezone_hours(F.col("plon"))
    return g.select("game_id", _r(shift, "shift"), S.travel_direction(F.col("plon"), F.col("lon")).alias("direction"), _r(S.directional_fatigue(shift), "fatigue"))


@query(f"""{_O} SELECT game_id, line, round(CASE WHEN abs(pred_c) >= 0.001 THEN pred_a / pred_c END, 6) AS ratio, round(sign(pred_a - pred_b) * ln(1 + abs(pred_a - pred_b)), 6) + 0.0::DOUBLE AS log_gap, round(sign(pred_b - pred_c) * sqrt(abs(pred_b - pred_c)), 6) + 0.0::DOUBLE AS root_gap, round(least(1e6, greatest(-1e6, pred_a * pred_b)) + 1e-8::DOUBLE, 5) AS product, round(ln(prob / (1 - prob)), 6) AS logit FROM oof""")
def f13_f26_symbolic_features(spark, sf_dir):
    a, b, c, p = (F.col(x) for x in ("pred_a", "pred_b", "pred_c", "prob"))
    return D.oof(spark, sf_dir).select("game_id", "line", _r(S.safe_divide(a, c), "ratio"), (F.round(S.signed_log1p(a - b), 6) + 0.0).alias("log_gap"), (F.round(S.signed_sqrt(b - c), 6) + 0.0).alias("root_gap"), _r(F.least(F.lit(1e6), F.greatest(F.lit(-1e6), a * b)) + 1e-8, "product", 5), _r(F.ln(p / (1 - p)), "logit"))


@query(f"""{_O}, m AS (SELECT quantile_cont(l_quantity, 0.5) AS q FROM lineitem WHERE year(l_shipdate) < 1998)
SELECT l_orderkey AS game_id, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN q ELSE l_quantity END AS value FROM lineitem, m""")
def p16_p17_train_median(spark, sf_dir):
    """Missing values (here those of returned lines) take the median of the training seasons."""
    rows = table(spark, sf_dir, "lineitem")
    median = F.lit(exact_quantiles(rows.where(F.year("l_shipdate") < 1998), F.col("l_quantity"), [0.5])[0])
    return rows.select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", median).otherwise(F.col("l_quantity")).alias("value"))


@query(f"""{_O}, e AS (SELECT abs(pred_a - y_true) AS e FROM oof), m AS (SELECT quantile_cont(round(e, 9), 0.5) AS mad FROM e)
SELECT k, round(greatest(0.1, mad / 0.6745::DOUBLE * k), 6) AS delta, round(avg(CASE WHEN e <= greatest(0.1, mad / 0.6745::DOUBLE * k) THEN 0.5 * e * e ELSE greatest(0.1, mad / 0.6745::DOUBLE * k) * (e - 0.5 * greatest(0.1, mad / 0.6745::DOUBLE * k)) END), 5) AS huber
FROM e, m, (VALUES (1.0::DOUBLE), (1.35::DOUBLE), (2.0::DOUBLE)) AS t(k) GROUP BY k, mad""")
def l4_huber_grid(spark, sf_dir):
    e = D.oof(spark, sf_dir).select(F.abs(F.col("pred_a") - F.col("y_true")).alias("e"))
    mad = F.lit(exact_quantiles(e, F.round("e", 9), [0.5])[0])
    e = e.withColumn("mad", mad).withColumn("k", F.explode(F.array(F.lit(1.0), F.lit(1.35), F.lit(2.0))))
    delta = F.greatest(F.lit(0.1), F.col("mad") / 0.6745 * F.col("k"))
    loss = F.when(F.col("e") <= delta, 0.5 * F.col("e") * F.col("e")).otherwise(delta * (F.col("e") - 0.5 * delta))
    return e.groupBy("k", "mad").agg(_r(F.avg(loss), "huber", 5)).select("k", _r(F.greatest(F.lit(0.1), F.col("mad") / 0.6745 * F.col("k")), "delta"), "huber")
