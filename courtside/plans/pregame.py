"""Ratings known before each date, checked by the residuals of the equations that they solve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.scalars import haversine_miles
from courtside.operators import pregame as P
from courtside.plans.registry import query
from courtside.shared import materialize
from courtside.sources import domain as D

RIDGE = 0.01
#: Names of the wide table's columns by (design, target).
MARGINS = {(d.name, "margin"): d.name for d in P.DESIGNS}
SPLIT_DESIGNS = P.DESIGNS[:2]
SPLITS = {(d.name, t): f"{t}_{d.name}" for d in SPLIT_DESIGNS for t in ("off", "def")}


def scored(spark, sf_dir) -> DataFrame:
    """Games with crowd, travel and what a visitor has played before, and points for a hundred possessions of each side."""
    g, a = D.games(spark, sf_dir), D.arenas(spark, sf_dir)
    for side in ("home", "away"):
        g = g.join(F.broadcast(a.select(F.col("team_id").alias(f"{side}_team_id"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))), f"{side}_team_id")
    density = F.col("attendance") / 20000.0
    possessions = lambda k, m: (88 + (F.col("game_id") * k) % m).cast("double")
    g = g.withColumns({
        "crowd_density": density,
        "crowd_weight": 0.5 + density,
        "visitor_inexperience": F.when(F.col("game_id") % 5 > 0, ((F.col("game_id") * 13) % 7) / 7.0),
        "log_travel_distance": F.log1p(haversine_miles(F.col("home_lat"), F.col("home_lon"), F.col("away_lat"), F.col("away_lon"))),
        "travel_direction": F.signum(F.col("home_lon") - F.col("away_lon")),
        "home_poss": possessions(17, 21),
        "away_poss": possessions(29, 23),
    })
    return g.withColumns({
        "home_offrtg": 100 * F.col("home_pts") / F.col("home_poss"), "away_offrtg": 100 * F.col("away_pts") / F.col("away_poss"),
        "home_defrtg": 100 * F.col("away_pts") / F.col("home_poss"), "away_defrtg": 100 * F.col("home_pts") / F.col("away_poss"),
    })


def split_targets():
    return {"off": F.col("home_offrtg") - F.col("away_offrtg"), "def": F.col("home_defrtg") - F.col("away_defrtg")}


#: Dates with ten earlier games of their season, the teams that had played before them, and whether all of those were connected.
_DATES_SQL = f"""WITH RECURSIVE {D.GAMES_SQL.strip()},
days AS (SELECT season, game_date, coalesce(sum(n) OVER (PARTITION BY season ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT season, game_date, count(*) AS n FROM games GROUP BY ALL)),
edges AS (SELECT season, home_team_id AS a, away_team_id AS b, min(game_date) AS since FROM games GROUP BY ALL),
both_ AS (SELECT * FROM edges UNION ALL SELECT season, b, a, since FROM edges),
starts AS (SELECT season, a AS team_id, min(since) AS since FROM both_ GROUP BY ALL),
there AS (SELECT season, game_date, team_id FROM days JOIN starts USING (season) WHERE before >= 10 AND since < game_date),
reach(season, game_date, team_id) AS (
  SELECT season, game_date, min(team_id) FROM there GROUP BY ALL
  UNION SELECT r.season, r.game_date, b.b FROM reach r JOIN both_ b ON b.season = r.season AND b.a = r.team_id AND b.since < r.game_date),
sizes AS (SELECT season, game_date, count(*) AS n FROM there GROUP BY ALL),
reached AS (SELECT season, game_date, count(*) AS n FROM reach GROUP BY ALL),
whole AS (SELECT season, game_date FROM sizes JOIN reached USING (season, game_date, n)),
least_ AS (SELECT season, game_date, team_id FROM there SEMI JOIN whole USING (season, game_date))"""


def _residuals(games: DataFrame, ratings: DataFrame, designs, targets, ridge: float) -> DataFrame:
    """season, game_date, design, target, team_id, off: by how much each team's equation of (A + ridge) x = b is missed.

    The equations come from running sums over all earlier dates, apart from the solver's blocks. The last team of a date
    has the sum of all ratings in place of its equation.
    """
    cells, _ = P.daily_sums(games, ["season"], "game_date", designs, targets)
    weights = list(dict.fromkeys(d.weight for d in designs))
    factors = P._factors(designs)
    names = list(targets)
    dates = ratings.select("season", "game_date").distinct()
    lower = cells.where("i <> j AND j > -100").select("season", "kind", "day", F.col("j").alias("i"), F.col("i").alias("j"), "value")
    daily = materialize(cells.unionByName(lower).where("i >= 0"), "daily-equations")
    asked = daily.select("season", "kind", "i", "j").distinct().join(dates, "season").select("season", "kind", F.col("game_date").alias("day"), "i", "j", F.lit(0.0).alias("value"), F.lit(0).alias("sums"))
    before = Window.partitionBy("season", "kind", "i", "j").orderBy("day", "sums").rowsBetween(Window.unboundedPreceding, -1)
    running = asked.unionByName(daily.withColumn("sums", F.lit(1))).withColumn("before", F.coalesce(F.sum("value").over(before), F.lit(0.0)))
    grown = materialize(running.where("sums = 0").select("season", "kind", F.col("day").alias("game_date"), "i", "j", F.col("before").alias("value")), "equations")
    out = []
    for d in designs:
        unknowns = [P.HOME] * d.home + [P.HOME - 1 - factors.index(f) for f in d.factors]
        mine = grown.where(F.col("kind") == weights.index(d.weight))
        for k, t in enumerate(names):
            x = ratings.where((F.col("design") == d.name) & (F.col("target") == t)).select("season", "game_date", F.col("i").alias("j"), "rating")
            team = Window.partitionBy("season", "game_date")
            lhs = mine.where((F.col("j") >= 0) | F.col("j").isin(unknowns)).join(x, ["season", "game_date", "j"]).groupBy("season", "game_date", "i").agg(F.sum(F.col("value") * F.col("rating")).alias("ax"))
            rhs = mine.where(F.col("j") == -100 - k).select("season", "game_date", "i", F.col("value").alias("b"))
            own = x.where("j >= 0").select("season", "game_date", F.col("j").alias("i"), F.col("rating"), (F.max("j").over(team) == F.col("j")).alias("last"), F.sum("rating").over(team).alias("total"))
            off = F.when(F.col("last"), F.col("total")).otherwise(F.col("ax") + ridge * F.col("rating") - F.col("b"))
            joined = own.join(lhs, ["season", "game_date", "i"]).join(rhs, ["season", "game_date", "i"])
            out.append(joined.select("season", "game_date", F.lit(d.name).alias("design"), F.lit(t).alias("target"), F.col("i").alias("team_id"), F.abs(off).alias("off")))
    return reduce(DataFrame.unionByName, out)


def _exact(residuals: DataFrame) -> DataFrame:
    """A row for each date and team: how many equations it has, and whether all of them hold."""
    return residuals.groupBy("season", "game_date", "team_id").agg(F.count("*").alias("equations"), (F.max("off") < 1e-6).alias("exact"))


@query(f"""{_DATES_SQL} SELECT season, game_date, team_id, {len(P.DESIGNS)} AS equations, true AS exact FROM least_""")
def r10_pregame_residuals(spark, sf_dir):
    """Whether the ratings of seven designs before each date solve their normal equations."""
    games = materialize(scored(spark, sf_dir), "scored")
    ratings = materialize(P.pregame_ratings(games, ["season"], ridge=RIDGE), "pregame")
    return _exact(_residuals(games, ratings, P.DESIGNS, {"margin": F.col("home_pts") - F.col("away_pts")}, RIDGE))


@query(f"""{_DATES_SQL} SELECT season, game_date, team_id, {2 * len(SPLIT_DESIGNS)} AS equations, true AS exact FROM least_""")
def r6_split_residuals(spark, sf_dir):
    """The same for ratings of offence and defence, which have no ridge step."""
    games = materialize(scored(spark, sf_dir), "scored")
    ratings = materialize(P.pregame_ratings(games, ["season"], designs=SPLIT_DESIGNS, targets=split_targets(), ridge=0.0), "splits")
    return _exact(_residuals(games, ratings, SPLIT_DESIGNS, split_targets(), 0.0))


@query()
def r10_pregame_ratings(spark, sf_dir):
    """A row for each date and team, a column for each design."""
    return P.wide(P.pregame_ratings(scored(spark, sf_dir), ["season"], ridge=RIDGE), ["season"], "game_date", MARGINS)


@query()
def r6_offence_defence(spark, sf_dir):
    ratings = P.pregame_ratings(scored(spark, sf_dir), ["season"], designs=SPLIT_DESIGNS, targets=split_targets(), ridge=0.0)
    return P.wide(ratings, ["season"], "game_date", SPLITS)


@query()
def r11_pregame_game_features(spark, sf_dir):
    """Differences of ratings for each game, from five earlier games of the season on; a schedule in parts has ratings in each part."""
    games = materialize(scored(spark, sf_dir), "scored")
    ratings = P.pregame_ratings(games, ["season"], ridge=RIDGE, min_games=5, connected=False)
    names = list(MARGINS.values())
    return P.matchup_diffs(P.aligned(games, P.wide(ratings, ["season"], "game_date", MARGINS), ["season", "game_date"], names), names)


@query()
def r11_coefficients(spark, sf_dir):
    """Home advantage and factor coefficients of each design before each date."""
    names = {P.HOME: "home_advantage"} | {P.HOME - 1 - k: f for k, f in enumerate(P._factors(P.DESIGNS))}
    ratings = P.pregame_ratings(scored(spark, sf_dir), ["season"], ridge=RIDGE, min_games=5, connected=False).where("i < 0")
    return ratings.select("season", "game_date", "design", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("i").cast("int")).alias("coefficient"), "rating")


@query()
def r13_backfilled_splits(spark, sf_dir):
    """A table of ratings whose last seasons lack the splits, filled for those seasons only."""
    games = materialize(scored(spark, sf_dir), "scored")

    def splits(some: DataFrame) -> DataFrame:
        return P.wide(P.pregame_ratings(some, ["season"], designs=SPLIT_DESIGNS, targets=split_targets(), ridge=0.0), ["season"], "game_date", SPLITS)

    names = list(SPLITS.values())
    have = materialize(splits(games), "splits")
    existing = have.select("season", "game_date", "team_id", *[F.when(F.col("season") < 1996, F.col(n)).alias(n) for n in names])
    return P.backfilled(existing, games, "season", ["season", "game_date", "team_id"], names, splits)


@query(f"""WITH {D.HISTORY_SQL},
d AS (SELECT season, game_date, team_id, sum(margin) AS margin FROM history GROUP BY ALL),
r AS (SELECT season, game_date, team_id, sum(margin) OVER (PARTITION BY season, team_id ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS form FROM d)
SELECT g.season, g.game_id, g.game_date, least(g.home_team_id, g.away_team_id) AS team_a_id, greatest(g.home_team_id, g.away_team_id) AS team_b_id, CAST(g.home_team_id < g.away_team_id AS INT) AS team_a_is_home,
  CAST((g.home_team_id < g.away_team_id) = (g.home_pts > g.away_pts) AS INT) AS team_a_wins, CASE WHEN g.home_team_id < g.away_team_id THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (h.form - a.form) AS diff_form
FROM games g LEFT JOIN r h ON h.season = g.season AND h.game_date = g.game_date AND h.team_id = g.home_team_id LEFT JOIN r a ON a.season = g.season AND a.game_date = g.game_date AND a.team_id = g.away_team_id""")
def j5_r11_aligned_snapshots(spark, sf_dir):
    """Values known before a date put beside that date's games by equality of season, date and team; null before a team's first game."""
    games = D.games(spark, sf_dir)
    daily = D.team_history(games).groupBy("season", "game_date", "team_id").agg(F.sum("margin").alias("margin"))
    before = Window.partitionBy("season", "team_id").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
    form = daily.select("season", "game_date", "team_id", F.sum("margin").over(before).alias("form"))
    return P.matchup_diffs(P.aligned(games, form, ["season", "game_date"], ["form"]), ["form"])
