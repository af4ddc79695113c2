"""Pregame features: windows over team histories, and joins that bring them to games."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators import windows as W
from courtside.operators.joins import asof, keep_last
from courtside.plans.registry import query
from courtside.sources import domain as D

#: Windows over a team's rows as ``in_blocks`` deals them.
_TEAM = ("team_id", W.BLOCK)
_LAG = "OVER (PARTITION BY {k} ORDER BY game_date, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _over(n: object, k: str = "team_id") -> str:
    return _LAG.format(n=n, k=k)


def _mean(x: str, n: object, least: int, k: str = "team_id") -> str:
    return f"CASE WHEN count({x}) {_over(n, k)} >= {least} THEN avg({x}) {_over(n, k)} END"


def _ratio(total: str, n: str):
    """A mean from a sum and a count; null where nothing was counted."""
    return F.col(total) / F.nullif(F.col(n), F.lit(0))


def _r(column, name: str, digits: int = 6):
    return F.round(column, digits).alias(name)


@query(
    f"""WITH {D.HISTORY_SQL}
SELECT team_id, game_id, game_date, """
    + ", ".join(
        f"round({_mean(x, n, 1)}, 6) AS {x}_mean_{n}, round(CASE WHEN count({x}) {_over(n)} >= 2 THEN stddev_samp({x}) {_over(n)} END, 6) AS {x}_std_{n}" for x in ("pf", "pa", "margin") for n in (5, 10, 20)
    )
    + f""", CAST(sum(win) {_over(20)} AS BIGINT) AS win_streak,
  CAST(game_date - lag(game_date) OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS INT) AS days_rest,
  CAST(coalesce(game_date - lag(game_date) OVER (PARTITION BY team_id ORDER BY game_date, game_id) <= 1, false) AS INT) AS is_back_to_back
FROM history"""
)
def w1_rolling_features(spark, sf_dir):
    got = W.rolling_features(D.team_history(D.games(spark, sf_dir)), ["pf", "pa", "margin"])
    return got.select(*[F.round(c, 6).alias(c) if "_mean_" in c or "_std_" in c else c for c in got.columns])


@query(f"""WITH {D.HISTORY_SQL}
SELECT team_id, game_id, is_away, round({_mean('pf', 10, 3, 'team_id, is_away')}, 6) AS venue_pf_10, round({_mean('margin', 20, 3, 'team_id, is_away')}, 6) AS venue_margin_20 FROM history""")
def w2_venue_rolling(spark, sf_dir):
    keys = ("team_id", "is_away")
    h = W.in_blocks(D.team_history(D.games(spark, sf_dir)), 20, *keys)
    return W.own_rows(h, "team_id", "game_id", "is_away", _r(W.lagged_mean("pf", 10, 3, *keys, W.BLOCK), "venue_pf_10"), _r(W.lagged_mean("margin", 20, 3, *keys, W.BLOCK), "venue_margin_20"))


@query(f"WITH {D.HISTORY_SQL} SELECT team_id, game_id, " + ", ".join(f"round({_mean('margin', n, 1)}, 6) AS momentum_{n}" for n in (1, 3, 5)) + " FROM history")
def w3_score_momentum(spark, sf_dir):
    h = W.in_blocks(D.team_history(D.games(spark, sf_dir)), 5, "team_id")
    return W.own_rows(h, "team_id", "game_id", *[_r(W.lagged_mean("margin", n, 1, *_TEAM), f"momentum_{n}") for n in (1, 3, 5)])


@query(f"""WITH {D.GAMES_SQL}, a AS (
  SELECT *, max(attendance) OVER (PARTITION BY home_team_id) AS capacity FROM games),
d AS (SELECT *, attendance / capacity::DOUBLE AS density, CAST(attendance >= 0.98 * capacity AS INT) AS sold FROM a),
r AS (SELECT game_id, home_team_id, season_type, {_mean('density', 10, 3, 'home_team_id')} AS m10, {_mean('density', 20, 5, 'home_team_id')} AS m20, {_mean('sold', 20, 5, 'home_team_id')} AS rate FROM d)
SELECT game_id, home_team_id, round(m10, 6) AS crowd_10, round(m20, 6) AS crowd_20, CASE WHEN season_type = 'Playoffs' THEN 1 WHEN rate > 0.8 THEN 1 ELSE 0 END AS sellout FROM r""")
def w4_crowd_history(spark, sf_dir):
    g = D.games(spark, sf_dir)
    g = g.join(g.groupBy("home_team_id").agg(F.max("attendance").alias("capacity")), "home_team_id")
    g = g.withColumn("density", F.col("attendance") / F.col("capacity")).withColumn("sold", (F.col("attendance") >= 0.98 * F.col("capacity")).cast("int"))
    keys = ("home_team_id", W.BLOCK)
    rate = W.lagged_mean("sold", 20, 5, *keys)
    return W.own_rows(
        W.in_blocks(g, 20, "home_team_id"), "game_id", "home_team_id", _r(W.lagged_mean("density", 10, 3, *keys), "crowd_10"), _r(W.lagged_mean("density", 20, 5, *keys), "crowd_20"), F.when(F.col("season_type") == "Playoffs", 1).when(rate > 0.8, 1).otherwise(0).alias("sellout")
    )


_HAV = "2 * 3959.0 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))"


@query(f"""WITH {D.HISTORY_SQL}, {D.ARENAS_SQL},
l AS (SELECT h.*, a.lat, a.lon FROM history h JOIN arenas a ON a.team_id = CASE WHEN is_away = 1 THEN opponent_id ELSE h.team_id END),
p AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(is_away) OVER w AS paway, lag(game_date) OVER w AS pdate,
        sum(CASE WHEN is_away = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS island FROM l WINDOW w AS (PARTITION BY team_id ORDER BY game_date, game_id)),
m AS (SELECT *, coalesce({_HAV}, 0.0) AS miles, coalesce(CAST(game_date - pdate AS INT), 3) AS gap, CASE WHEN paway IS NULL OR paway <> is_away THEN 1 ELSE 0 END AS switch,
        sum(is_away) OVER (PARTITION BY team_id, island ORDER BY game_date, game_id) AS streak FROM p)
SELECT team_id, game_id, round(miles, 4) AS leg_miles, gap AS day_gap, switch AS venue_switch, CAST(streak AS BIGINT) AS away_streak,
  round(sum(miles) {_over(5)}, 3) AS miles_5, CAST(sum(switch) {_over(5)} AS BIGINT) AS switches_5, CAST(sum(gap) {_over(3)} AS BIGINT) AS days_3 FROM m""")
def w5_travel_sequence(spark, sf_dir):
    h = D.team_history(D.games(spark, sf_dir))
    where = D.arenas(spark, sf_dir).select(F.col("team_id").alias("place"), "lat", "lon")
    h = h.withColumn("place", F.when(F.col("is_away") == 1, F.col("opponent_id")).otherwise(F.col("team_id"))).join(where, "place")
    # the leg before the first of the last five games needs one more row
    h = W.totals_before(W.in_blocks(h, 6, "team_id"), {"homes": 1 - F.col("is_away")}, "team_id")
    w = W.by(*_TEAM)
    h = h.withColumns({"plat": F.lag("lat").over(w), "plon": F.lag("lon").over(w), "paway": F.lag("is_away").over(w), "pdate": F.lag("game_date").over(w), "island": F.coalesce("homes", F.lit(0)) + 1 - F.col("is_away")})
    h = h.select(
        W.BLOCK,
        "__carried",
        "island",
        "is_away",
        "team_id",
        "game_id",
        "game_date",
        F.coalesce(S.haversine_miles(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")), F.lit(0.0)).alias("miles"),
        F.coalesce(F.date_diff("game_date", "pdate"), F.lit(3)).alias("gap"),
        F.when(F.col("paway").isNull() | (F.col("paway") != F.col("is_away")), 1).otherwise(0).alias("switch"),
    )
    total = lambda c, n: F.sum(c).over(W.lagged(n, *_TEAM))
    h = W.own_rows(h, "*", total("miles", 5).alias("sum_miles"), total("switch", 5).alias("sum_switches"), total("gap", 3).alias("sum_gaps"))
    h = h.withColumn("streak", F.sum("is_away").over(W.by("team_id", "island")))  # from one home game to the next
    return h.select("team_id", "game_id", _r(F.col("miles"), "leg_miles", 4), F.col("gap").alias("day_gap"), F.col("switch").alias("venue_switch"), F.col("streak").alias("away_streak"), _r(F.col("sum_miles"), "miles_5", 3), F.col("sum_switches").alias("switches_5"), F.col("sum_gaps").alias("days_3"))


_REF = f"""{D.GAMES_SQL}, {D.OFFICIALS_SQL},
r AS (SELECT official_id, game_id, game_date, home_pts + away_pts AS total, CAST(home_pts > away_pts AS INT) AS home_win FROM officials JOIN games USING (game_id)),
e AS (SELECT *, avg(total) {_over('UNBOUNDED', 'official_id')} AS total_mean, avg(home_win) {_over('UNBOUNDED', 'official_id')} AS home_rate,
        row_number() OVER (PARTITION BY official_id ORDER BY game_date, game_id) - 1 AS seen FROM r)"""


def _referees(spark, sf_dir):
    g = D.games(spark, sf_dir).select("game_id", "game_date", (F.col("home_pts") + F.col("away_pts")).alias("total"), (F.col("home_pts") > F.col("away_pts")).cast("int").alias("home_win"))
    r = D.officials(spark, sf_dir).join(g, "game_id")
    r = W.totals_before(W.in_blocks(r, 0, "official_id"), {"totals": F.col("total"), "n_totals": F.col("total").isNotNull().cast("long"), "wins": F.col("home_win"), "n_wins": F.col("home_win").isNotNull().cast("long")}, "official_id")
    return r.select("official_id", "game_id", _ratio("totals", "n_totals").alias("total_mean"), _ratio("wins", "n_wins").alias("home_rate"), F.col("__n").cast("long").alias("seen"))


@query(f"WITH {_REF} SELECT official_id, game_id, round(total_mean, 6) AS total_mean, round(home_rate, 6) AS home_rate, seen FROM e")
def w6_referee_history(spark, sf_dir):
    return _referees(spark, sf_dir).select("official_id", "game_id", _r(F.col("total_mean"), "total_mean"), _r(F.col("home_rate"), "home_rate"), "seen")


@query(f"WITH {_REF} SELECT game_id, count(*) AS crew, round(avg(seen), 6) AS experience, CASE WHEN avg(seen) >= 30 THEN round(avg(total_mean), 6) END AS crew_total, CASE WHEN avg(seen) >= 30 THEN round(avg(home_rate), 6) END AS crew_home_rate FROM e GROUP BY game_id")
def j8_a7_referee_crew(spark, sf_dir):
    known = F.avg("seen") >= 30
    return _referees(spark, sf_dir).groupBy("game_id").agg(
        F.count("*").alias("crew"), _r(F.avg("seen"), "experience"), F.when(known, F.round(F.avg("total_mean"), 6)).alias("crew_total"), F.when(known, F.round(F.avg("home_rate"), 6)).alias("crew_home_rate")
    )


@query(f"""WITH {D.GAMES_SQL},
p AS (SELECT *, least(home_team_id, away_team_id) AS a, greatest(home_team_id, away_team_id) AS b, CASE WHEN home_team_id < away_team_id THEN home_pts - away_pts ELSE away_pts - home_pts END AS m FROM games),
w AS (SELECT *, avg(m) {_over(5, 'a, b')} AS mean5, avg(CAST(m > 0 AS INT)) {_over(5, 'a, b')} AS win5, count(m) {_over(5, 'a, b')} AS n FROM p)
SELECT game_id, round(CASE WHEN home_team_id = a THEN mean5 ELSE -mean5 END, 6) AS h2h_margin, round(CASE WHEN home_team_id = a THEN win5 ELSE 1 - win5 END, 6) AS h2h_home_win, n AS h2h_games FROM w""")
def w7_head_to_head(spark, sf_dir):
    g = D.games(spark, sf_dir)
    first = F.col("home_team_id") < F.col("away_team_id")
    g = g.select("game_id", "game_date", F.least("home_team_id", "away_team_id").alias("a"), F.greatest("home_team_id", "away_team_id").alias("b"), first.alias("home_first"), (F.when(first, 1).otherwise(-1) * (F.col("home_pts") - F.col("away_pts"))).alias("m"))
    w = W.lagged(5, "a", "b")
    mean, win = F.avg("m").over(w), F.avg((F.col("m") > 0).cast("int")).over(w)
    return g.select("game_id", _r(F.when(F.col("home_first"), mean).otherwise(-mean), "h2h_margin"), _r(F.when(F.col("home_first"), win).otherwise(1 - win), "h2h_home_win"), F.count("m").over(w).alias("h2h_games"))


@query(f"""WITH {D.HISTORY_SQL},
m AS (SELECT *, CASE WHEN count(pa) OVER w >= 20 THEN quantile_cont(pa, 0.5) OVER w END AS med FROM history WINDOW w AS (PARTITION BY team_id, season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN pa > med THEN margin END AS strong, CASE WHEN pa <= med THEN margin END AS weak FROM m)
SELECT team_id, game_id, med AS opponent_median, round({_mean('strong', 'UNBOUNDED', 3, 'team_id, season')}, 6) AS vs_strong, round({_mean('weak', 'UNBOUNDED', 3, 'team_id, season')}, 6) AS vs_weak FROM c""")
def w8_conditional_matchup(spark, sf_dir):
    h = D.team_history(D.games(spark, sf_dir))
    w = W.expanding("team_id", "season")
    h = h.withColumn("med", F.when(F.count("pa").over(w) >= 20, F.percentile("pa", 0.5).over(w)))
    h = h.withColumns({"strong": F.when(F.col("pa") > F.col("med"), F.col("margin")), "weak": F.when(F.col("pa") <= F.col("med"), F.col("margin"))})
    mean = lambda c: W.at_least(F.col(c), F.avg(c), w, 3)
    return h.select("team_id", "game_id", F.col("med").alias("opponent_median"), _r(mean("strong"), "vs_strong"), _r(mean("weak"), "vs_weak"))


@query(f"""WITH {D.HISTORY_SQL},
s AS (SELECT *, count(pf) OVER w AS n, sum(pf) OVER w AS spf, sum(pa) OVER w AS spa, avg(win) OVER w AS rate FROM history WINDOW w AS (PARTITION BY team_id, season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, CASE WHEN n >= 5 THEN 1 / (1 + pow(spa / spf::DOUBLE, 13.91)) END AS x FROM s)
SELECT team_id, game_id, round(x, 6) AS pythagorean, round(rate - x, 6) AS luck FROM e""")
def w9_pythagorean(spark, sf_dir):
    counted = lambda c: F.col(c).isNotNull().cast("long")
    sums = {"n": counted("pf"), "spf": F.col("pf"), "spa": F.col("pa"), "wins": F.col("win"), "n_wins": counted("win")}
    h = W.totals_before(W.in_blocks(D.team_history(D.games(spark, sf_dir)), 0, "team_id", "season"), sums, "team_id", "season")
    x = F.when(F.col("n") >= 5, 1 / (1 + F.pow(F.col("spa") / F.col("spf"), F.lit(13.91))))
    return h.select("team_id", "game_id", x.alias("x"), _ratio("wins", "n_wins").alias("rate")).select("team_id", "game_id", _r(F.col("x"), "pythagorean"), _r(F.col("rate") - F.col("x"), "luck"))


def _ewm_sql(alpha: float, least: int) -> str:
    # weights (1 - alpha)^age over the lagged list, newest last
    w = "OVER (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(pf) {w} >= {least} THEN list(pf::DOUBLE) {w} END"


def _fold_sql(column: str, alpha: float) -> str:
    terms = f"list_transform(range(1, len({column}) + 1), lambda i: pow({1 - alpha}, len({column}) - i) * {column}[i])"
    weights = f"list_transform(range(1, len({column}) + 1), lambda i: pow({1 - alpha}, len({column}) - i))"
    return f"list_sum({terms}) / list_sum({weights})"


@query(f"""WITH {D.HISTORY_SQL},
l AS (SELECT team_id, game_id, {_ewm_sql(0.159, 3)} AS acute, {_ewm_sql(0.069, 8)} AS chronic FROM history),
e AS (SELECT team_id, game_id, {_fold_sql('acute', 0.159)} AS a, {_fold_sql('chronic', 0.069)} AS c FROM l)
SELECT team_id, game_id, round(a, 5) AS acute, round(c, 5) AS chronic, round(a / c, 5) AS ratio FROM e""")
def w10_workload_ratio(spark, sf_dir):
    """Acute and chronic exponentially weighted loads over all earlier games and their ratio, each team for itself."""
    h = D.team_history(D.games(spark, sf_dir)).select("team_id", "game_id", "game_date", F.col("pf").cast("double").alias("x"))
    found = W.exponential_means(h, "x", {"acute": (0.159, 3), "chronic": (0.069, 8)}, "team_id")
    return found.select("team_id", "game_id", _r(F.col("acute"), "acute", 5), _r(F.col("chronic"), "chronic", 5), _r(F.col("acute") / F.col("chronic"), "ratio", 5))


def _entropy_sql(p: str) -> str:
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0.0 ELSE -({p} * log2({p}) + (1 - {p}) * log2(1 - {p})) END"


@query(f"""WITH {D.HISTORY_SQL}, m AS (SELECT team_id, game_id, {_mean('win', 20, 5)} AS p20, {_mean('win', 10, 5)} AS p10 FROM history)
SELECT team_id, game_id, round(p20, 6) AS win_pct, CASE WHEN p10 IS NOT NULL THEN round({_entropy_sql('p10')}, 6) END AS win_entropy FROM m""")
def w12_win_entropy(spark, sf_dir):
    h = W.own_rows(W.in_blocks(D.team_history(D.games(spark, sf_dir)), 20, "team_id"), "team_id", "game_id", W.lagged_mean("win", 20, 5, *_TEAM).alias("p20"), W.lagged_mean("win", 10, 5, *_TEAM).alias("p10"))
    return h.select("team_id", "game_id", _r(F.col("p20"), "win_pct"), _r(W.entropy(F.col("p10")), "win_entropy"))


_UP, _DOWN = "greatest(0.0::DOUBLE, s.up + e.x)", "least(0.0::DOUBLE, s.down + e.x)"
_PASSED = f"({_UP} > 0.05 OR -({_DOWN}) > 0.05)"


@query(f"""WITH {D.HISTORY_SQL}, l AS (SELECT team_id, game_id, list(win::DOUBLE) {_over(20)} AS last, avg(win) {_over('UNBOUNDED')} AS mean FROM history),
f AS (SELECT team_id, game_id, last, list_reduce(list_prepend({{'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'peak': 0.0::DOUBLE, 'x': 0.0::DOUBLE}}, list_transform(last, lambda x: {{'up': 0.0::DOUBLE, 'down': 0.0::DOUBLE, 'peak': 0.0::DOUBLE, 'x': x - mean}})),
  lambda s, e: {{'up': CASE WHEN {_PASSED} THEN 0.0 ELSE {_UP} END, 'down': CASE WHEN {_PASSED} THEN 0.0 ELSE {_DOWN} END, 'peak': greatest(s.peak, {_UP}, -({_DOWN})), 'x': 0.0::DOUBLE}}) AS r FROM l)
SELECT team_id, game_id, CASE WHEN len(last) >= 5 THEN round(r.peak + 1e-9::DOUBLE, 6) END AS cusum_peak FROM f""")
def w13_cusum_momentum(spark, sf_dir):
    """The peak of a two-sided CUSUM of the last 20 results around the team's mean so far."""
    h = W.totals_before(W.in_blocks(D.team_history(D.games(spark, sf_dir)), 20, "team_id"), {"wins": F.col("win"), "n_wins": F.col("win").isNotNull().cast("long")}, "team_id")
    h = W.own_rows(h, "team_id", "game_id", F.collect_list(F.col("win").cast("double")).over(W.lagged(20, *_TEAM)).alias("last"), _ratio("wins", "n_wins").alias("mean"))
    return h.select("team_id", "game_id", _r(F.when(F.size("last") >= 5, W.cusum_peak(F.col("last"), F.col("mean"))) + 1e-9, "cusum_peak"))  # no ties in rounding)


@query(f"""WITH {D.QUARTERS_SQL}, d AS (SELECT game_id, team_id, game_date, q1, q2, q3, q4 FROM (
  SELECT game_id, team_id, max(CASE WHEN period_label = 'Q1' THEN period_score END) AS q1, max(CASE WHEN period_label = 'Q2' THEN period_score END) AS q2, max(CASE WHEN period_label = 'Q3' THEN period_score END) AS q3, max(CASE WHEN period_label = 'Q4' THEN period_score END) AS q4
  FROM quarters GROUP BY 1, 2) JOIN (SELECT game_id, game_date FROM games) USING (game_id)),
m AS (SELECT team_id, game_id, {", ".join(f"{_mean(q, 10, 5)} AS {q}" for q in ("q1", "q2", "q3", "q4"))} FROM d)
SELECT team_id, game_id, round(q1, 6) AS q1_10, round(q4, 6) AS q4_10, round(q1 + q2, 6) AS h1_10, round(q3 + q4, 6) AS h2_10,
  round(-(q1/(q1+q2+q3+q4)*log2(q1/(q1+q2+q3+q4)) + q2/(q1+q2+q3+q4)*log2(q2/(q1+q2+q3+q4)) + q3/(q1+q2+q3+q4)*log2(q3/(q1+q2+q3+q4)) + q4/(q1+q2+q3+q4)*log2(q4/(q1+q2+q3+q4))), 5) AS scoring_entropy FROM m""")
def w15_w16_a31_quarter_rolling(spark, sf_dir):
    g = D.games(spark, sf_dir)
    names = ["Q1", "Q2", "Q3", "Q4"]
    wide = D.quarters(g).groupBy("game_id", "team_id").pivot("period_label", names).agg(F.first("period_score", ignorenulls=True)).join(g.select("game_id", "game_date"), "game_id")
    m = W.own_rows(W.in_blocks(wide, 10, "team_id"), "team_id", "game_id", *[W.lagged_mean(q, 10, 5, *_TEAM).alias(q.lower()) for q in names])
    total = F.col("q1") + F.col("q2") + F.col("q3") + F.col("q4")
    p = [F.col(q.lower()) / total for q in names]
    entropy = -(p[0] * F.log2(p[0]) + p[1] * F.log2(p[1]) + p[2] * F.log2(p[2]) + p[3] * F.log2(p[3]))
    return m.select("team_id", "game_id", _r(F.col("q1"), "q1_10"), _r(F.col("q4"), "q4_10"), _r(F.col("q1") + F.col("q2"), "h1_10"), _r(F.col("q3") + F.col("q4"), "h2_10"), _r(entropy, "scoring_entropy", 5))


@query(f"""WITH {D.HISTORY_SQL}, f AS (SELECT *, CAST(abs(margin) > 15 AS INT) AS blow, CAST(abs(margin) <= 5 AS INT) AS close FROM history)
SELECT team_id, game_id, round({_mean('blow', 10, 5)}, 6) AS blowout_rate, round({_mean('close', 10, 5)}, 6) AS close_rate FROM f""")
def w17_blowout_close(spark, sf_dir):
    h = D.team_history(D.games(spark, sf_dir)).withColumns({"blow": (F.abs("margin") > 15).cast("int"), "close": (F.abs("margin") <= 5).cast("int")})
    return W.own_rows(W.in_blocks(h, 10, "team_id"), "team_id", "game_id", _r(W.lagged_mean("blow", 10, 5, *_TEAM), "blowout_rate"), _r(W.lagged_mean("close", 10, 5, *_TEAM), "close_rate"))


@query(f"""WITH {D.HISTORY_SQL}, f AS (SELECT *, CAST(abs(margin) <= 3 AS INT) AS ot FROM history)
SELECT team_id, game_id, round({_mean('ot', 20, 5)}, 6) AS ot_rate, round(sum(ot * win) {_over('UNBOUNDED')} / nullif(sum(ot) {_over('UNBOUNDED')}, 0)::DOUBLE, 6) AS ot_win_rate FROM f""")
def w18_overtime_history(spark, sf_dir):
    """Games within three points stand for overtime games, which the tables don't mark."""
    h = D.team_history(D.games(spark, sf_dir)).withColumn("ot", (F.abs("margin") <= 3).cast("int"))
    h = W.totals_before(W.in_blocks(h, 20, "team_id"), {"ot_wins": F.col("ot") * F.col("win"), "ots": F.col("ot")}, "team_id")
    return W.own_rows(h, "team_id", "game_id", _r(W.lagged_mean("ot", 20, 5, *_TEAM), "ot_rate"), _r(_ratio("ot_wins", "ots"), "ot_win_rate"))


@query(f"""WITH {D.HISTORY_SQL}, l AS (SELECT *, lag(margin) OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS prev FROM history)
SELECT team_id, game_id, round(CASE WHEN count(prev) {_over(19)} >= 9 AND stddev_pop(CASE WHEN prev IS NOT NULL THEN margin END) {_over(19)} > 0 AND stddev_pop(prev) {_over(19)} > 0 THEN corr(margin, prev) {_over(19)} END, 5) AS autocorr FROM l""")
def w19_margin_autocorrelation(spark, sf_dir):
    h = W.in_blocks(D.team_history(D.games(spark, sf_dir)), 20, "team_id").withColumn("prev", F.lag("margin").over(W.by(*_TEAM)))
    w = W.lagged(19, *_TEAM)
    now = F.when(F.col("prev").isNotNull(), F.col("margin"))
    spread = F.nullif(F.stddev_pop(now).over(w) * F.stddev_pop("prev").over(w), F.lit(0.0))  # margins may all be equal
    return W.own_rows(h, "team_id", "game_id", _r(F.when(F.count("prev").over(w) >= 9, F.covar_pop("margin", "prev").over(w) / spread), "autocorr", 5))


@query(f"""WITH {D.GAMES_SQL},
p AS (SELECT *, least(home_team_id, away_team_id) AS a, greatest(home_team_id, away_team_id) AS b, CAST(CASE WHEN home_pts > away_pts THEN home_team_id ELSE away_team_id END = least(home_team_id, away_team_id) AS INT) AS a_won FROM games),
s AS (SELECT *, row_number() OVER w AS game_number, coalesce(sum(2 * a_won - 1) OVER (PARTITION BY season, a, b ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lead_a,
  sum(a_won) OVER (PARTITION BY season, a, b) AS wins_a, count(*) OVER (PARTITION BY season, a, b) AS n, first_value(home_team_id) OVER w AS higher_seed, CAST(game_date - lag(game_date) OVER w AS INT) AS rest
  FROM p WINDOW w AS (PARTITION BY season, a, b ORDER BY game_date, game_id))
SELECT game_id, season, game_number, CAST(lead_a AS BIGINT) AS lead_a, CAST(wins_a AS BIGINT) AS wins_a, CAST(n - wins_a AS BIGINT) AS wins_b, CAST(wins_a AS VARCHAR) || '-' || CAST(n - wins_a AS VARCHAR) AS result, higher_seed, rest FROM s""")
def w20_w21_series_position(spark, sf_dir):
    g = D.games(spark, sf_dir)
    a = F.least("home_team_id", "away_team_id")
    g = g.select("*", a.alias("a"), F.greatest("home_team_id", "away_team_id").alias("b"), (F.when(F.col("home_pts") > F.col("away_pts"), F.col("home_team_id")).otherwise(F.col("away_team_id")) == a).cast("int").alias("a_won"))
    keys = ("season", "a", "b")
    w, whole = W.by(*keys), Window.partitionBy(*keys)
    wins = F.sum("a_won").over(whole)
    losses = F.count("*").over(whole) - wins
    return g.select(
        "game_id",
        "season",
        F.row_number().over(w).cast("long").alias("game_number"),
        F.coalesce(F.sum(2 * F.col("a_won") - 1).over(W.expanding(*keys)), F.lit(0)).alias("lead_a"),
        wins.alias("wins_a"),
        losses.alias("wins_b"),
        F.concat_ws("-", wins.cast("string"), losses.cast("string")).alias("result"),
        F.first("home_team_id").over(w).alias("higher_seed"),
        F.date_diff("game_date", F.lag("game_date").over(w)).alias("rest"),
    )


@query(f"""WITH {D.RATINGS_SQL}
SELECT team_id, as_of_date, rating, rank() OVER (PARTITION BY as_of_date ORDER BY rating DESC) AS rank_min,
  rank() OVER (PARTITION BY as_of_date ORDER BY rating DESC) + (count(*) OVER (PARTITION BY as_of_date, rating) - 1) / 2.0::DOUBLE AS rank_avg FROM snaps""")
def w22_w23_rating_ranks(spark, sf_dir):
    r = F.rank().over(Window.partitionBy("as_of_date").orderBy(F.desc("rating"))).cast("long")
    same = F.count("*").over(Window.partitionBy("as_of_date", "rating"))
    return D.rating_snapshots(spark, sf_dir).select("team_id", "as_of_date", "rating", r.alias("rank_min"), (r + (same - 1) / 2.0).alias("rank_avg"))


@query(f"""WITH {D.GAMES_SQL}, b AS (SELECT min(game_date) AS lo, max(game_date) AS hi FROM games),
t AS (SELECT game_id, 0.5::DOUBLE + 0.5::DOUBLE * (game_date - lo) / (hi - lo)::DOUBLE AS u FROM games, b)
SELECT game_id, round(u * (SELECT count(*) FROM t) / (SELECT sum(u) FROM t), 8) AS weight FROM t""")
def w24_time_decay_weights(spark, sf_dir):
    """Weights linear in the date, from a half to one, scaled to sum to the number of games; the totals are one aggregated row."""
    g = D.games(spark, sf_dir).select("game_id", F.unix_date("game_date").alias("d"))
    ends = g.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("d").alias("sum"), F.count("*").alias("n"))
    u = 0.5 + 0.5 * (F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    all_u = 0.5 * F.col("n") + 0.5 * (F.col("sum") - F.col("n") * F.col("lo")) / (F.col("hi") - F.col("lo"))
    return g.crossJoin(F.broadcast(ends)).select("game_id", _r(u * F.col("n") / all_u, "weight", 8))


@query(f"""WITH {D.GAMES_SQL}, {D.RATINGS_SQL.strip()}
SELECT g.game_id, h.rating AS home_rating, h.as_of_date AS home_as_of, a.rating AS away_rating, a.as_of_date AS away_as_of
FROM games g ASOF LEFT JOIN snaps h ON g.home_team_id = h.team_id AND g.game_date > h.as_of_date ASOF LEFT JOIN snaps a ON g.away_team_id = a.team_id AND g.game_date > a.as_of_date""")
def j3_align_ratings(spark, sf_dir):
    """The last rating of each side before the game's day."""
    out, snaps = D.games(spark, sf_dir).select("game_id", "game_date", "home_team_id", "away_team_id"), D.rating_snapshots(spark, sf_dir)
    for side in ("home", "away"):
        right = snaps.select(F.col("team_id").alias(f"{side}_team_id"), F.col("as_of_date").alias(f"{side}_as_of"), F.col("rating").alias(f"{side}_rating"))
        out = asof(out, right, [f"{side}_team_id"], "game_date", f"{side}_as_of", [f"{side}_rating"], block=lambda t: F.year(t))
    return out.select("game_id", "home_rating", "home_as_of", "away_rating", "away_as_of")


@query(f"""WITH {D.HISTORY_SQL}, f AS (SELECT team_id, game_id, {_mean('margin', 10, 1)} AS m FROM history)
SELECT g.game_id, round(h.m, 6) AS home_margin_10, round(a.m, 6) AS away_margin_10, round(h.m - a.m, 6) AS diff_margin_10, round(h.m + a.m, 6) AS sum_margin_10
FROM games g LEFT JOIN f h ON h.game_id = g.game_id AND h.team_id = g.home_team_id LEFT JOIN f a ON a.game_id = g.game_id AND a.team_id = g.away_team_id""")
def j6_f12_map_back_diffs(spark, sf_dir):
    g = D.games(spark, sf_dir)
    f = W.own_rows(W.in_blocks(D.team_history(g), 10, "team_id"), "team_id", "game_id", W.lagged_mean("margin", 10, 1, *_TEAM).alias("margin_10"))
    out = W.to_games(g.select("game_id", "home_team_id", "away_team_id"), f, ["margin_10"])
    h, a = F.col("home_margin_10"), F.col("away_margin_10")
    return out.select("game_id", _r(h, "home_margin_10"), _r(a, "away_margin_10"), _r(h - a, "diff_margin_10"), _r(h + a, "sum_margin_10"))


@query(f"WITH {D.ROSTERS_SQL} SELECT game_id, side, count(*) AS players, count(CASE WHEN inactive THEN 1 END) AS dnp, count(*) - count(CASE WHEN inactive THEN 1 END) AS active FROM rosters GROUP BY 1, 2")
def j7_a8_roster_counts(spark, sf_dir):
    r = D.rosters(spark, sf_dir).groupBy("game_id", "side").agg(F.count("*").alias("players"), F.count_if("inactive").alias("dnp"))
    return r.withColumn("active", F.col("players") - F.col("dnp"))


@query(f"""WITH {D.QUARTERS_SQL}
SELECT g.game_id, h.q1 AS home_q1, h.q4 AS home_q4, a.q1 AS away_q1, a.q4 AS away_q4, h.q1 + h.q2 - a.q1 - a.q2 AS h1_spread, h.q3 + h.q4 + a.q3 + a.q4 AS h2_total,
  CAST(h.q1 + h.q2 > a.q1 + a.q2 AS INT) AS home_wins_h1, CAST(home_pts > away_pts AS INT) AS winner, home_pts - away_pts AS spread, home_pts + away_pts AS total
FROM games g
JOIN (PIVOT quarters ON period_label IN ('Q1' AS q1, 'Q2' AS q2, 'Q3' AS q3, 'Q4' AS q4) USING first(period_score) GROUP BY game_id, team_id) h ON h.game_id = g.game_id AND h.team_id = home_team_id
JOIN (PIVOT quarters ON period_label IN ('Q1' AS q1, 'Q2' AS q2, 'Q3' AS q3, 'Q4' AS q4) USING first(period_score) GROUP BY game_id, team_id) a ON a.game_id = g.game_id AND a.team_id = away_team_id""")
def j2_t1_quarter_targets(spark, sf_dir):
    g = D.games(spark, sf_dir)
    wide = D.quarters(g).groupBy("game_id", "team_id").pivot("period_label", ["Q1", "Q2", "Q3", "Q4"]).agg(F.first("period_score", ignorenulls=True))
    out = W.to_games(g, wide, ["Q1", "Q2", "Q3", "Q4"])
    half = lambda s, a, b: F.col(f"{s}_Q{a}") + F.col(f"{s}_Q{b}")
    return out.select(
        "game_id",
        *[F.col(f"{s}_Q{q}").alias(f"{s}_q{q}") for s in ("home", "away") for q in (1, 4)],
        (half("home", 1, 2) - half("away", 1, 2)).alias("h1_spread"),
        (half("home", 3, 4) + half("away", 3, 4)).alias("h2_total"),
        F.coalesce(half("home", 1, 2) > half("away", 1, 2), F.lit(False)).cast("int").alias("home_wins_h1"),
        (F.col("home_pts") > F.col("away_pts")).cast("int").alias("winner"),
        (F.col("home_pts") - F.col("away_pts")).alias("spread"),
        (F.col("home_pts") + F.col("away_pts")).alias("total"),
    )


@query(f"""WITH {D.HISTORY_SQL}, f AS (SELECT team_id, game_id, game_date, {_mean('margin', 10, 1)} AS m FROM history),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) = 1)
SELECT a.team_id AS team_a, b.team_id AS team_b, round(a.m - b.m, 6) AS diff_margin, round(a.m + b.m, 6) AS sum_margin FROM l a JOIN l b ON a.team_id < b.team_id""")
def j20_j16_matchups(spark, sf_dir):
    """Every pairing of the teams' latest features; the two sides have one row for each of the league's teams."""
    f = W.own_rows(W.in_blocks(D.team_history(D.games(spark, sf_dir)), 10, "team_id"), "team_id", "game_id", "game_date", W.lagged_mean("margin", 10, 1, *_TEAM).alias("m"))
    last = keep_last(f, ["team_id"], F.col("game_date"), F.col("game_id")).select("team_id", "m")
    a, b = last.select(F.col("team_id").alias("team_a"), F.col("m").alias("ma")), last.select(F.col("team_id").alias("team_b"), F.col("m").alias("mb"))
    return a.join(b, F.col("team_a") < F.col("team_b")).select("team_a", "team_b", _r(F.col("ma") - F.col("mb"), "diff_margin"), _r(F.col("ma") + F.col("mb"), "sum_margin"))
