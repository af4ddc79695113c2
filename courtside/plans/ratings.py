"""Rating queries over seasons of games."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.operators import ratings as R
from courtside.plans.registry import query
from courtside.sources import domain as D

_CELLS = f"""WITH {D.GAMES_SQL}, e AS (SELECT game_id, season, game_date, home_pts - away_pts AS y, t.i, t.v FROM games, LATERAL (VALUES (home_team_id, 1.0::DOUBLE), (away_team_id, -1.0::DOUBLE), (-1::BIGINT, 1.0::DOUBLE)) AS t(i, v))"""


def _rows(spark, sf_dir, *group):
    return R.entries(D.games(spark, sf_dir), list(group), F.col("home_pts") - F.col("away_pts"))


@query(f"{_CELLS} SELECT a.season, a.i, b.i AS j, sum(a.v * b.v) AS value FROM e a JOIN e b USING (game_id) GROUP BY 1, 2, 3")
def r1_normal_matrix(spark, sf_dir):
    return R.normal_equations(_rows(spark, sf_dir, "season"), ["season"])[0]


@query(f"{_CELLS} SELECT season, i, sum(v * y) AS value FROM e GROUP BY 1, 2")
def r1_normal_side(spark, sf_dir):
    return R.normal_equations(_rows(spark, sf_dir, "season"), ["season"])[1]


@query(f"""{_CELLS}, d AS (SELECT season, game_date, i, sum(v * y) AS value FROM e GROUP BY 1, 2, 3)
SELECT season, game_date, i, value, sum(value) OVER (PARTITION BY season, i ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d""")
def j15_r10_running_side(spark, sf_dir):
    """What is known before each day, as a running sum of daily sums instead of a join of days with all earlier games."""
    return R.running_equations(R.normal_equations(_rows(spark, sf_dir, "season", "game_date"), ["season", "game_date"])[1], ["season", "i"], "game_date")


@query()
def r3_massey_ratings(spark, sf_dir):
    matrix, side = R.normal_equations(_rows(spark, sf_dir, "season"), ["season"])
    return R.solve(matrix, side, ["season"]).select("season", F.col("i").alias("team_id"), F.round("rating", 6).alias("rating"))


@query()
def r4_colley_ratings(spark, sf_dir):
    return R.colley(D.games(spark, sf_dir), ["season"]).select("season", F.col("i").alias("team_id"), F.round("rating", 6).alias("rating"))


@query()
def r5_quarter_ratings(spark, sf_dir):
    """Massey ratings of each quarter's margins."""
    g = D.games(spark, sf_dir)
    q = D.quarters(g)
    home, away = (q.select("game_id", F.col("team_id").alias(f"{s}_team_id"), "period_label", F.col("period_score").alias(s)) for s in ("home", "away"))
    margins = g.select("game_id", "season", "home_team_id", "away_team_id").join(home, ["game_id", "home_team_id"]).join(away, ["game_id", "away_team_id", "period_label"])
    group = ["season", "period_label"]
    matrix, side = R.normal_equations(R.entries(margins, group, F.col("home") - F.col("away")), group)
    return R.solve(matrix, side, group).select("season", "period_label", F.col("i").alias("team_id"), F.round("rating", 6).alias("rating"))


@query(f"""WITH {D.GAMES_SQL}, w AS (SELECT season, home_team_id AS team_id, attendance FROM games)
SELECT season, count(attendance) / count(*)::DOUBLE AS coverage, count(DISTINCT attendance) AS kinds, count(attendance) / count(*)::DOUBLE >= 0.75 AND count(DISTINCT attendance) > 1 AS admitted FROM w GROUP BY 1""")
def r2_factor_admission(spark, sf_dir):
    coverage, kinds = F.count("attendance") / F.count("*"), F.countDistinct("attendance")
    return D.games(spark, sf_dir).groupBy("season").agg(coverage.alias("coverage"), kinds.alias("kinds"), ((coverage >= 0.75) & (kinds > 1)).alias("admitted"))


@query(f"""WITH RECURSIVE {D.GAMES_SQL.strip()},
e AS (SELECT DISTINCT season, home_team_id AS a, away_team_id AS b FROM games),
s AS (SELECT season, a, b FROM e UNION SELECT season, b, a FROM e),
r(season, a, b) AS (SELECT season, a, b FROM s UNION SELECT r.season, r.a, s.b FROM r JOIN s ON r.season = s.season AND r.b = s.a)
SELECT season, a AS team_id, least(a, min(b)) AS component FROM r GROUP BY 1, 2""")
def r9_schedule_components(spark, sf_dir):
    """Components of each season's schedule: least labels spread along games until none changes."""
    g = D.games(spark, sf_dir).select("season", F.col("home_team_id").alias("a"), F.col("away_team_id").alias("b")).distinct()
    return schedule_components(g)


def schedule_components(edges):
    from courtside.shared import materialize

    both = materialize(edges.unionByName(edges.select("season", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "schedule")
    labels = materialize(both.select("season", F.col("a").alias("team_id")).distinct().withColumn("component", F.col("team_id")), "labels")
    while True:
        spread = both.join(labels.withColumnRenamed("team_id", "b"), ["season", "b"]).groupBy("season", F.col("a").alias("team_id")).agg(F.min("component").alias("near"))
        new = labels.join(spread, ["season", "team_id"], "left").select("season", "team_id", F.least("component", "near").alias("component"), (F.col("near") < F.col("component")).alias("moved"))
        new = materialize(new, "labels")
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


@query(f"""WITH {D.GAMES_SQL}, s AS (SELECT season, home_team_id AS i, away_team_id AS j, CAST(home_pts > away_pts AS DOUBLE) AS w FROM games UNION ALL SELECT season, away_team_id, home_team_id, CAST(home_pts < away_pts AS DOUBLE) FROM games)
SELECT season, i, j, sum(w) AS w FROM s GROUP BY 1, 2, 3""")
def r7_pair_wins(spark, sf_dir):
    g = D.games(spark, sf_dir)
    return R.pair_wins(g, ["season"], (F.col("home_pts") > F.col("away_pts")).cast("double"))


@query()
def r7_win_ratings(spark, sf_dir):
    """Strengths from wins alone."""
    wins = R.pair_wins(D.games(spark, sf_dir), ["season"], (F.col("home_pts") > F.col("away_pts")).cast("double"))
    return R.zermelo(wins, ["season"]).select("season", F.col("i").alias("team_id"), F.round("rating", 6).alias("rating"))


@query()
def r7_margin_ratings(spark, sf_dir):
    """Strengths from the logistic of margins capped at 20."""
    margin = F.least(F.lit(20), F.greatest(F.lit(-20), F.col("home_pts") - F.col("away_pts")))
    wins = R.pair_wins(D.games(spark, sf_dir), ["season"], 1 / (1 + F.exp(-margin / 7.0)))
    return R.zermelo(wins, ["season"]).select("season", F.col("i").alias("team_id"), F.round("rating", 6).alias("rating"))


@query()
def r8_root_margin_ratings(spark, sf_dir):
    """Least squares on the signed root of margins capped at 16, with a bonus for the winner."""
    margin = F.col("home_pts") - F.col("away_pts")
    y = F.signum(margin.cast("double")) * (F.sqrt(F.least(F.abs(margin), F.lit(16)).cast("double")) + F.sqrt(F.lit(2.0)))
    matrix, side = R.normal_equations(R.entries(D.games(spark, sf_dir), ["season"], y), ["season"])
    return R.solve(matrix, side, ["season"]).select("season", F.col("i").alias("team_id"), F.round("rating", 6).alias("rating"))
