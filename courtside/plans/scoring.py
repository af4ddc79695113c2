"""Ensembles saved and applied to later batches: scores, matches with their totals, and signals for quoted markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.operators import scoring as M
from courtside.operators import windows as W
from courtside.operators.boxscores import student_t_cdf
from courtside.operators.joins import beside
from courtside.operators.signals import Sizing, match_signals
from courtside.plans.boxscores import _t_sql
from courtside.plans.registry import query
from courtside.shared import fresh_path, materialize
from courtside.sources import domain as D

#: The first season that is scored and not trained on.
SCORED = 1998


def _r(column, name: str, digits: int = 4):
    return F.round(column, digits).alias(name)


def _two_sql(name: str, y: str, x1: str, x2: str) -> str:
    """Intercept and slopes of least squares on two columns, as aggregates."""
    det = f"(var_pop({x1}) * var_pop({x2}) - covar_pop({x1}, {x2}) * covar_pop({x1}, {x2}))"
    b1 = f"(var_pop({x2}) * covar_pop({x1}, {y}) - covar_pop({x1}, {x2}) * covar_pop({x2}, {y})) / {det}"
    b2 = f"(var_pop({x1}) * covar_pop({x2}, {y}) - covar_pop({x1}, {x2}) * covar_pop({x1}, {y})) / {det}"
    return f"avg({y}) - avg({x1}) * {b1} - avg({x2}) * {b2} AS {name}0, {b1} AS {name}1, {b2} AS {name}2"


BATCH_MODELS = [M.Spec("a", ("pred_a",), True, 0.5), M.Spec("b_c", ("pred_b", "pred_c"), False, 0.3), M.Spec("p_c", ("prob", "pred_c"), True, 0.2)]


def _gaps(spark, sf_dir) -> DataFrame:
    """Predictions of which some are missing, by a null or the sentinel."""
    k, line = F.col("game_id"), F.col("line")
    o = D.oof(spark, sf_dir)
    return o.withColumn("pred_a", F.when((k * 3 + line) % 11 > 0, F.col("pred_a"))).withColumn("pred_c", F.when((k + 5 * line) % 13 == 0, M.SENTINEL).otherwise(F.col("pred_c")))


@query(f"""WITH {D.OOF_SQL}, d AS (SELECT game_id, line, season, y_true AS y, CASE WHEN (game_id * 3 + line) % 11 > 0 THEN pred_a END AS a, pred_b AS b, CASE WHEN (game_id + 5 * line) % 13 > 0 THEN pred_c END AS c, prob AS p FROM oof),
m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(c, 0.5) AS mc FROM d WHERE season < {SCORED}),
f AS (SELECT d.*, coalesce(a, ma) AS fa, coalesce(c, mc) AS fc FROM d, m),
k AS (SELECT regr_intercept(y, fa) AS i, regr_slope(y, fa) AS s, {_two_sql("v", "y", "b", "fc")}, {_two_sql("w", "y", "p", "fc")} FROM f WHERE season < {SCORED}),
q AS (SELECT game_id, line, [i + s * fa, v0 + v1 * b + v2 * fc, w0 + w1 * p + w2 * fc] AS ps, [CASE WHEN a IS NULL THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END, 0.3::DOUBLE, CASE WHEN c IS NULL THEN 0.02::DOUBLE ELSE 0.2::DOUBLE END] AS ws,
  ((a IS NULL)::INT + 2 * (c IS NULL)::INT) / 5.0::DOUBLE AS missing, a IS NULL OR c IS NULL AS low FROM f, k WHERE season >= {SCORED}),
e AS (SELECT *, list_sort(ps)[2] AS med, list_sort([abs(ps[1] - list_sort(ps)[2]), abs(ps[2] - list_sort(ps)[2]), abs(ps[3] - list_sort(ps)[2])])[2] AS mad FROM q),
n AS (SELECT *, [(abs(x - med) <= 3 * mad)::INT for x in ps] AS near FROM e),
u AS (SELECT *, CASE WHEN mad > 0 AND list_sum(near) >= 2 THEN near ELSE [1, 1, 1] END AS keep FROM n),
z AS (SELECT *, list_sum(keep) AS n_models, (keep[1] * ps[1] + keep[2] * ps[2] + keep[3] * ps[3]) / list_sum(keep) AS flat FROM u)
SELECT game_id, line, round((keep[1] * ws[1] * ps[1] + keep[2] * ws[2] * ps[2] + keep[3] * ws[3] * ps[3]) / (keep[1] * ws[1] + keep[2] * ws[2] + keep[3] * ws[3]), 4) AS mean,
  round(sqrt((keep[1] * pow(ps[1] - flat, 2) + keep[2] * pow(ps[2] - flat, 2) + keep[3] * pow(ps[3] - flat, 2)) / n_models), 4) AS std, n_models::INT AS n_models, round(missing, 4) AS missing, low AS low_weight FROM z""")
def l11_batch_scores(spark, sf_dir):
    """Scores of the last seasons by an ensemble of those before, which was written to a table and loaded again."""
    rows, path = _gaps(spark, sf_dir), fresh_path(spark, "ensembles")
    M.fit_ensemble(rows.where(F.col("season") < SCORED), "y_true", "season", BATCH_MODELS).write.parquet(path)
    scored = M.score(rows.where(F.col("season") >= SCORED), M.load_ensembles(spark, path)["y_true"])
    return scored.select("game_id", "line", _r(F.col("score.mean"), "mean"), _r(F.col("score.std"), "std"), "score.n_models", _r(F.col("score.missing"), "missing"), "score.low_weight")


#: The models of each side's points: its own mean of points and the other side's mean of points allowed, and the first alone.
SIDE_MODELS = {t: [M.Spec("both", (f"{own}_pf", f"{other}_pa"), True, 0.6), M.Spec("own", (f"{own}_pf",), False, 0.4)] for t, own, other in (("home_pts", "home", "away"), ("away_pts", "away", "home"))}


def _form(spark, sf_dir) -> DataFrame:
    """Games with each side's means over its last ten games before the day.

    Only a team's last ten games of a day can be among the ten that end with its last one, so windows see ten rows for each
    team and day, and games are joined with one row for each, whatever their number.
    """
    games = D.games(spark, sf_dir)
    history = D.team_history(games).select("team_id", "game_date", "game_id", "pf", "pa")
    last = Window.partitionBy("team_id", "game_date").orderBy(F.desc("game_id"))
    history = materialize(history.withColumn("__last", F.row_number().over(last)).where("__last <= 10").drop("__last"), "last-games")
    blocked = W.in_blocks(history, 9, "team_id")
    ten = W.by("team_id", W.BLOCK).rowsBetween(-9, 0)
    form = W.own_rows(blocked, "team_id", "game_date", "game_id", F.struct(F.avg("pf").over(ten).alias("pf"), F.avg("pa").over(ten).alias("pa")).alias("form"))
    form = form.groupBy("team_id", "game_date").agg(F.max_by("form", "game_id").alias("form"))  # the last game of a day
    before = F.lag("form").over(Window.partitionBy("team_id").orderBy("game_date"))
    form = materialize(form.withColumn("form", before), "team-form")
    out = games.select("game_id", "game_date", "season", "home_team_id", "away_team_id", "home_pts", "away_pts")
    for side in ("home", "away"):
        own = form.select(F.col("team_id").alias(f"{side}_team_id"), "game_date", F.col("form.pf").alias(f"{side}_pf"), F.col("form.pa").alias(f"{side}_pa"))
        out = beside(out, own, [f"{side}_team_id", "game_date"])
    return materialize(out, "game-form")


def _matches(spark, sf_dir):
    """(listed games with the scores of both sides, sums of the training residuals, deviation of the margin's residuals)."""
    rows, path = _form(spark, sf_dir), fresh_path(spark, "ensembles")
    train = rows.where(F.col("season") < SCORED)
    for target, models in SIDE_MODELS.items():
        M.fit_ensemble(train, target, "season", models).write.mode("append").parquet(path)
    ensembles = M.load_ensembles(spark, path)
    for target in SIDE_MODELS:
        rows = M.score(rows, ensembles[target], f"{target}_score")
    rows = rows.select("game_id", "season", "home_team_id", "away_team_id", *[c for t in ("home", "away") for c in ((F.col(f"{t}_pts") - F.col(f"{t}_pts_score.mean")).alias(f"{t}_residual"), F.col(f"{t}_pts_score.mean").alias(f"{t}_mu"), F.col(f"{t}_pts_score.std").alias(f"{t}_std"))])
    rows = materialize(rows, "scored-games")
    train = rows.where(F.col("season") < SCORED)
    margin = train.agg(F.stddev_samp(F.col("home_residual") - F.col("away_residual"))).first()[0]
    return rows.where(F.col("season") >= SCORED), M.synthetic_total(train, "home_residual", "away_residual", "home_std", "away_std"), margin


_FORM_SQL = f"""{D.HISTORY_SQL},
st AS (SELECT team_id, game_date, game_id, avg(pf) OVER w AS pf, avg(pa) OVER w AS pa FROM history WINDOW w AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
form AS (SELECT team_id, game_date AS as_of, arg_max(pf, game_id) AS pf, arg_max(pa, game_id) AS pa FROM st GROUP BY 1, 2),
d AS (SELECT g.*, h.pf AS hf, h.pa AS ha, a.pf AS af, a.pa AS aa FROM games g ASOF LEFT JOIN form h ON g.home_team_id = h.team_id AND g.game_date > h.as_of ASOF LEFT JOIN form a ON g.away_team_id = a.team_id AND g.game_date > a.as_of),
md AS (SELECT quantile_cont(hf, 0.5) AS mhf, quantile_cont(ha, 0.5) AS mha, quantile_cont(af, 0.5) AS maf, quantile_cont(aa, 0.5) AS maa FROM d WHERE season < {SCORED}),
f AS (SELECT d.*, coalesce(hf, mhf) AS fhf, coalesce(ha, mha) AS fha, coalesce(af, maf) AS faf, coalesce(aa, maa) AS faa,
  CASE WHEN hf IS NULL OR aa IS NULL THEN 0.06::DOUBLE ELSE 0.6::DOUBLE END AS wh, CASE WHEN af IS NULL OR ha IS NULL THEN 0.06::DOUBLE ELSE 0.6::DOUBLE END AS wa FROM d, md),
k AS (SELECT {_two_sql("h", "home_pts", "fhf", "faa")}, {_two_sql("a", "away_pts", "faf", "fha")}, regr_intercept(home_pts, fhf) AS hi, regr_slope(home_pts, fhf) AS hs, regr_intercept(away_pts, faf) AS ai, regr_slope(away_pts, faf) AS as_ FROM f WHERE season < {SCORED}),
p AS (SELECT f.*, h0 + h1 * fhf + h2 * faa AS ph, hi + hs * fhf AS qh, a0 + a1 * faf + a2 * fha AS pa_, ai + as_ * faf AS qa FROM f, k),
s AS (SELECT game_id, season, home_team_id, away_team_id, (wh * ph + 0.4::DOUBLE * qh) / (wh + 0.4::DOUBLE) AS home_mu, (wa * pa_ + 0.4::DOUBLE * qa) / (wa + 0.4::DOUBLE) AS away_mu, abs(ph - qh) / 2 AS home_std, abs(pa_ - qa) / 2 AS away_std, home_pts, away_pts FROM p),
t AS (SELECT corr(home_std, away_std) AS rho, var_samp(home_pts - home_mu + away_pts - away_mu) AS variance, stddev_samp(home_pts - home_mu - away_pts + away_mu) AS margin FROM s WHERE season < {SCORED}),
m AS (SELECT game_id, home_team_id, away_team_id, home_mu, away_mu, home_mu + away_mu AS mu, sqrt(greatest(0, home_std * home_std + away_std * away_std + 2 * rho * home_std * away_std)) AS std, variance, margin FROM s, t WHERE season >= {SCORED})"""


@query(f"""WITH {_FORM_SQL}, l AS (SELECT m.*, 5 * round(mu / 5) + x.d AS line FROM m, (VALUES (-9.5::DOUBLE), (-4.5::DOUBLE), (0.5::DOUBLE), (5.5::DOUBLE), (10.5::DOUBLE)) AS x(d))
SELECT game_id, round(home_mu, 4) AS home_mu, round(away_mu, 4) AS away_mu, round(mu, 4) AS mu, round(std, 4) AS std, line, round(1 - {_t_sql("((line - mu) / sqrt(variance / 2))")}, 5) AS over_prob FROM l""")
def l16_match_totals(spark, sf_dir):
    """Listed games: both sides' points, the total from them with its spread, and its chance to exceed each line near it.

    The total's residuals have the variance of both sides' with their covariance; their distribution is a t of 4 degrees.
    """
    listed, total, _ = _matches(spark, sf_dir)
    mu, std = F.col("home_mu") + F.col("away_mu"), M.combined_std(F.col("home_std"), F.col("away_std"), total["rho"])
    rows = listed.select("game_id", "home_mu", "away_mu", mu.alias("mu"), std.alias("std"))
    centre = 5 * F.round(F.col("mu") / 5)
    rows = rows.select("*", F.explode(F.array(*[centre + d for d in (-9.5, -4.5, 0.5, 5.5, 10.5)])).alias("line"))
    over = 1 - student_t_cdf((F.col("line") - F.col("mu")) / (total["variance"] / 2) ** 0.5, 4)
    return rows.select("game_id", _r(F.col("home_mu"), "home_mu"), _r(F.col("away_mu"), "away_mu"), _r(F.col("mu"), "mu"), _r(F.col("std"), "std"), "line", _r(over, "over_prob", 5))


#: Thresholds of the margin markets that are quoted for each listed game.
THRESHOLDS = (-7.5, -2.5, 2.5, 7.5)
_TIERS = Sizing(std_tiers=(0.004, 0.012))


@query(f"""WITH {_FORM_SQL}, b AS (SELECT game_id, home_team_id AS home, away_team_id AS away, home_mu - away_mu AS spread, margin / sqrt(2.0::DOUBLE) AS scale, std / 100 AS win_std FROM m),
w AS (SELECT *, {_t_sql("(spread / scale + 0.1::DOUBLE)")} AS win_prob FROM b),
q AS (SELECT game_id, 'winner' AS market, NULL::DOUBLE AS threshold, 0.3::DOUBLE + (game_id % 41) / 100.0::DOUBLE AS yes, 0.72::DOUBLE - (game_id % 41) / 100.0::DOUBLE AS no FROM b
  UNION ALL SELECT game_id, 'spread', x.t, 0.5::DOUBLE - x.t / 50 + (game_id % 7 - 3) / 60.0::DOUBLE, 0.53::DOUBLE + x.t / 50 - (game_id % 7 - 3) / 60.0::DOUBLE FROM b, (VALUES {", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)}) AS x(t)),
c AS (SELECT game_id, CASE WHEN game_id % 5 = 2 THEN away ELSE home END AS team, CASE game_id % 5 WHEN 1 THEN 'FADE' WHEN 3 THEN 'NONE' ELSE 'BACK' END AS said FROM b WHERE game_id % 5 < 4),
j AS (SELECT w.*, q.market, q.threshold, q.yes, q.no, CASE WHEN market = 'winner' THEN win_prob ELSE 1 - {_t_sql("((threshold - spread) / scale)")} END AS prob, 100 * abs(win_prob - (1 - {_t_sql("((0 - spread) / scale)")})) AS agree_pp FROM q JOIN w USING (game_id)),
e AS (SELECT *, prob - yes >= 1 - prob - no AS is_yes, greatest(prob - yes, 1 - prob - no) AS edge FROM j),
g AS (SELECT e.*, CASE WHEN is_yes THEN 'YES' ELSE 'NO' END AS side, CASE WHEN is_yes THEN yes ELSE no END AS price, CASE WHEN CASE WHEN market = 'winner' THEN is_yes ELSE threshold > 0 END THEN home ELSE away END AS team, coalesce(c.said, 'NONE') AS said FROM e LEFT JOIN c USING (game_id)),
r AS (SELECT *, CASE WHEN said = 'NONE' THEN 'NO SIGNAL' WHEN (said = 'BACK') = is_yes THEN 'AGREES' ELSE 'DISAGREES' END AS status, CASE WHEN market = 'spread' THEN 'FIXED' WHEN win_std <= 0.004 THEN 'HIGH' WHEN win_std <= 0.012 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN edge > 0 AND price < 1 THEN edge / (1 - price) ELSE 0 END AS kelly FROM g)
SELECT game_id, market, threshold, team, side, round(prob, 4) AS prob, round(price, 4) AS price, round(edge, 4) + 0.0::DOUBLE AS edge, round(kelly, 4) AS kelly, confidence, status,
  round(1000 * least(0.05::DOUBLE, kelly * 0.25::DOUBLE * CASE confidence WHEN 'MEDIUM' THEN 0.75::DOUBLE WHEN 'LOW' THEN 0.5::DOUBLE ELSE 1 END * CASE status WHEN 'AGREES' THEN 1.5::DOUBLE WHEN 'DISAGREES' THEN 0.5::DOUBLE ELSE 1 END), 2) AS bet, edge >= 0.07::DOUBLE * price AS actionable, round(agree_pp, 3) AS agree_pp FROM r""")
def b11_match_signals(spark, sf_dir):
    """Signals for the quoted winner and margin markets of listed games, sized by confidence and by other signals' agreement."""
    listed, total, margin = _matches(spark, sf_dir)
    scale = margin / 2**0.5
    spread = F.col("home_mu") - F.col("away_mu")
    matches = listed.select("game_id", F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), spread.alias("spread"), student_t_cdf(spread / scale + 0.1, 4).alias("win_prob"), (M.combined_std(F.col("home_std"), F.col("away_std"), total["rho"]) / 100).alias("win_std"))
    k, t = F.col("game_id"), F.col("threshold")
    quoted = matches.select("game_id", F.explode(F.array(F.lit(None).cast("double"), *[F.lit(x) for x in THRESHOLDS])).alias("threshold"))
    winner = t.isNull()
    yes = F.when(winner, 0.3 + (k % 41) / 100.0).otherwise(0.5 - t / 50 + (k % 7 - 3) / 60.0)
    no = F.when(winner, 0.72 - (k % 41) / 100.0).otherwise(0.53 + t / 50 - (k % 7 - 3) / 60.0)
    markets = quoted.select("game_id", F.when(winner, "winner").otherwise("spread").alias("market"), "threshold", yes.alias("yes"), no.alias("no"))
    call = F.when(k % 5 == 1, "FADE").when(k % 5 == 3, "NO TRADE").otherwise("BACK")
    calls = matches.where(k % 5 < 4).select("game_id", F.when(k % 5 == 2, F.col("away")).otherwise(F.col("home")).alias("team"), call.alias("call"), F.lit(4.0).alias("edge"), F.lit(2.0).alias("hours"), F.lit(1).alias("made_at"))
    got = match_signals(matches, markets, calls, lambda spread, threshold: 1 - student_t_cdf((threshold - spread) / scale, 4), _TIERS)
    return got.select("game_id", "market", "threshold", "team", "side", *[(F.round(c, 4) + 0.0).alias(c) for c in ("prob", "price", "edge", "kelly")], "confidence", "status", "bet", "actionable", _r(F.col("agree_pp"), "agree_pp", 3))
