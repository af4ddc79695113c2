"""Pregame ratings against solving each date's games by hand."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.operators import pregame as P

D0 = dt.date(2024, 1, 1)
GAMES = "season long, game_id long, game_date date, home_team_id long, away_team_id long, home_pts double, away_pts double, crowd double, w double"
DESIGNS = (P.Design("plain"), P.Design("home", True), P.Design("crowd", True, ("crowd",)), P.Design("heavy", True, ("crowd",), "w"))


def schedule(n_days=40, teams=6, seed=1, season=2024):
    rnd, out = random.Random(seed), []
    for d in range(n_days):
        for _ in range(rnd.randrange(0, 3)):
            a, b = rnd.sample(range(teams), 2)
            crowd = None if d < 6 else rnd.choice([0.2, 0.5, 0.9])
            out.append((season, len(out), D0 + dt.timedelta(days=d), a, b, float(rnd.randrange(80, 120)), float(rnd.randrange(80, 120)), crowd, rnd.choice([0.5, 1.0, 2.0])))
    return out


def by_hand(games, day, design, ridge, min_games, connected):
    prior = [g for g in games if g[2] < day]
    if len(prior) < min_games:
        return None
    teams = sorted({t for g in prior for t in (g[3], g[4])})
    seen = [g[7] for g in prior if g[7] is not None]
    use = [f for f in design.factors if len(seen) >= 0.75 * len(prior) and len(set(seen)) > 1]
    columns = [*teams, *["home"] * design.home, *use]
    x = np.array([[1.0 if c == g[3] and c in teams else -1.0 if c == g[4] and c in teams else 1.0 if c == "home" else (g[7] or 0.0) if c == "crowd" else 0.0 for c in columns] for g in prior])
    w = np.array([g[8] if design.weight else 1.0 for g in prior])
    a, b = x.T @ (w[:, None] * x), x.T @ (w * np.array([g[5] - g[6] for g in prior]))
    group = {t: t for t in teams}
    for _ in teams:
        for g in prior:
            group[g[3]] = group[g[4]] = min(group[g[3]], group[g[4]])
    parts = [[t for t in teams if group[t] == k] for k in sorted(set(group.values()))]
    if connected and len(parts) > 1:
        return None
    if ridge and np.linalg.cond(a) > 1e12:
        a += ridge * np.eye(len(a))
    for part in parts:
        k = teams.index(part[-1])
        a[k], b[k] = [1.0 if c in part else 0.0 for c in columns], 0.0
    if np.linalg.cond(a) > 1e9:  # not determined: any solution will do
        return dict.fromkeys(columns)
    return dict(zip(columns, np.linalg.solve(a, b), strict=True))


@pytest.mark.parametrize(("ridge", "min_games", "connected", "block"), [(0.01, 10, True, 7), (0.0, 3, False, 1000), (0.01, 5, False, 3)])
def test_every_date_against_its_own_games(spark, ridge, min_games, connected, block):
    games = schedule() + [(*g[:1], *g[1:]) for g in schedule(25, 5, 9, 2025)]
    frame = spark.createDataFrame(games, GAMES)
    got = {}
    for r in P.pregame_ratings(frame, ["season"], designs=DESIGNS, ridge=ridge, min_games=min_games, connected=connected, block=block).collect():
        got.setdefault((r.season, r.game_date, r.design), {})[{-1: "home", -2: "crowd"}.get(r.i, r.i)] = r.rating
    want = {}
    for season in (2024, 2025):
        mine = [g for g in games if g[0] == season]
        for day in sorted({g[2] for g in mine}):
            for d in DESIGNS:
                x = by_hand(mine, day, d, ridge, min_games, connected)
                if x is not None:
                    want[season, day, d.name] = x
    assert got.keys() == want.keys() and len(want) > 50
    for k, x in want.items():
        assert got[k].keys() == x.keys()
        for c in x:
            assert x[c] is None or got[k][c] == pytest.approx(x[c], abs=1e-6), (k, c)


def test_two_targets_share_a_matrix_and_parts_sum_to_zero(spark):
    games = [(1, k, D0 + dt.timedelta(days=k), a, b, float(p), 90.0, None, 1.0) for k, (a, b, p) in enumerate([(1, 2, 100), (2, 1, 95), (3, 4, 80), (4, 3, 85), (1, 2, 99), (3, 4, 91)])]
    frame = spark.createDataFrame(games, GAMES)
    targets = {"margin": F.col("home_pts") - F.col("away_pts"), "twice": 2 * (F.col("home_pts") - F.col("away_pts"))}
    rows = P.pregame_ratings(frame, ["season"], designs=DESIGNS[:1], targets=targets, min_games=4, connected=False, ridge=0.0).collect()
    last = {(r.i, r.target): r.rating for r in rows if r.game_date == D0 + dt.timedelta(days=5)}
    for t in (1, 2, 3, 4):
        assert last[t, "twice"] == pytest.approx(2 * last[t, "margin"])
    assert last[1, "margin"] + last[2, "margin"] == pytest.approx(0) and last[3, "margin"] + last[4, "margin"] == pytest.approx(0)
    assert not P.pregame_ratings(frame, ["season"], designs=DESIGNS[:1], min_games=4, connected=True).collect()


def test_backfill_computes_only_what_is_missing(spark):
    games = spark.createDataFrame(schedule() + schedule(20, 5, 3, 2025), GAMES)
    existing = spark.createDataFrame([(2024, 1, 5.0), (2025, 1, None), (2025, 2, 7.0)], "season long, team_id long, off double")
    asked = []

    def compute(some):
        asked.append({r.season for r in some.select("season").distinct().collect()})
        return some.select("season", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("team_id")).distinct().withColumn("off", F.lit(1.5))

    got = {tuple(r) for r in P.backfilled(existing, games, "season", ["season", "team_id"], ["off"], compute).collect()}
    assert got == {(2024, 1, 5.0), (2025, 1, 1.5), (2025, 2, 7.0)} and asked == [{2025}]


def test_diffs_are_of_the_lower_id(spark):
    games = spark.createDataFrame([(1, 1, D0, 5, 2, 90.0, 80.0, None, None), (1, 2, D0, 2, 5, 70.0, 80.0, None, None)], GAMES)
    ratings = spark.createDataFrame([(1, D0, 5, 3.0, 1), (1, D0, 2, 1.0, 2)], "season long, game_date date, team_id long, x double, x_rank int")
    got = [tuple(r)[3:] for r in P.matchup_diffs(P.aligned(games, ratings, ["season", "game_date"], ["x"]), ["x"]).orderBy("game_id").collect()]
    assert got == [(2, 5, 0, 0, -2.0), (2, 5, 1, 0, -2.0)]


def test_games_of_two_teams_on_a_day_are_summed_before_they_are_spread(spark):
    rows = [(1, d, h, (h + 1 + k) % 3, float(p), 0.5 + k / 4, None if p % 3 else 1.0) for d in range(2) for h in range(3) for k in range(2) for p in range(6)]
    games = spark.createDataFrame(rows, "season int, day int, home_team_id long, away_team_id long, pts double, weight double, factor double")
    designs = (P.Design("plain"), P.Design("weighed", True, ("factor",), "weight"))
    cells, _ = P.daily_sums(games, ["season"], "day", designs, {"pts": F.col("pts")})
    plan = cells._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # the tree's last lines are run first: an aggregation stands below the first explode
    assert max(i for i, x in enumerate(plan) if "Aggregate [" in x) > max(i for i, x in enumerate(plan) if "Generate explode" in x)
    want: dict[tuple, float] = {}
    for _, d, h, a, p, w, f in rows:
        x = [(h, 1.0), (a, -1.0), (P.HOME, 1.0), (P.HOME - 1, f or 0.0)]
        for kind, weight in ((0, 1.0), (1, w)):
            for i, u in x:
                for j, v in [*x, (-100, p)]:
                    if j <= -100 or i <= j:
                        want[kind, d, i, j] = want.get((kind, d, i, j), 0.0) + weight * u * v
    got = {(r["kind"], r["day"], r["i"], r["j"]): r["value"] for r in cells.collect()}
    assert got == pytest.approx(want)
