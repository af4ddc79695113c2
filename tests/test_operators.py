"""Single operators on small frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators import joins, ratings
from courtside.operators import windows as W
from courtside.sources import loaders


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def games(spark, rows):
    return spark.createDataFrame(rows, "game_id long, season long, game_date date, home_team_id long, away_team_id long, home_pts double, away_pts double")


def test_massey_recovers_strengths(spark):
    strength, home = {1: 8.0, 2: 0.0, 3: -8.0}, 3.0
    pairs = [(1, 2), (2, 1), (2, 3), (3, 2), (1, 3), (3, 1)]
    g = games(spark, [(k, 2024, day(k), a, b, 100 + strength[a] - strength[b] + home, 100.0) for k, (a, b) in enumerate(pairs)])
    matrix, side = ratings.normal_equations(ratings.entries(g, ["season"], F.col("home_pts") - F.col("away_pts")), ["season"])
    got = {r.i: r.rating for r in ratings.solve(matrix, side, ["season"]).collect()}
    for team, value in strength.items():
        assert got[team] == pytest.approx(value, abs=1e-6)
    assert got[ratings.HOME] == pytest.approx(home, abs=1e-6)


def test_colley_matches_dense_solve(spark):
    g = games(spark, [(1, 1, day(1), 1, 2, 10.0, 5.0), (2, 1, day(2), 2, 3, 7.0, 6.0), (3, 1, day(3), 3, 1, 1.0, 4.0)])
    got = {r.i: r.rating for r in ratings.colley(g, ["season"]).collect()}
    a = np.array([[4.0, -1, -1], [-1, 4, -1], [-1, -1, 4]])
    want = np.linalg.solve(a, [1 + (2 - 0) / 2, 1 + (1 - 1) / 2, 1 + (0 - 2) / 2])
    assert [got[k] for k in (1, 2, 3)] == pytest.approx(list(want))


def test_future_rows_do_not_change_pregame_features(spark):
    rows = [(k, 1, day(k), 1 + k % 3, 1 + (k + 1) % 3, 90.0 + 7 * k % 13, 95.0) for k in range(30)]
    from courtside.sources.domain import team_history

    def features(changed):
        h = team_history(games(spark, changed))
        return {(r.team_id, r.game_id): tuple(r) for r in W.rolling_features(h, ["pf", "margin"]).where("game_id <= 15").collect()}

    assert features(rows) == features([r if r[0] <= 15 else (*r[:5], 300.0, 1.0) for r in rows])


def test_asof_is_strict_or_exact_and_carries_whole_rows(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a", 1), (1, 7, None, 2)], "k int, u int, v string, w int")
    strict = {(r.k, r.t): (r.v, r.w) for r in joins.asof(left, right, ["k"], "t", "u", ["v", "w"]).collect()}
    assert strict == {(1, 5): (None, None), (1, 10): (None, 2), (2, 1): (None, None)}
    exact = {(r.k, r.t): r.w for r in joins.asof(left, right, ["k"], "t", "u", ["v", "w"], exact=True).collect()}
    assert exact == {(1, 5): 1, (1, 10): 2, (2, 1): None}


def test_asof_in_blocks_is_asof(spark):
    rng = np.random.default_rng(2)
    left = spark.createDataFrame([(int(k) if k else None, int(t)) for k, t in zip(rng.integers(0, 3, 80), rng.permutation(80), strict=True)], "k int, t int")
    right = spark.createDataFrame([(int(k) if k else None, int(u), f"v{i}") for i, (k, u) in enumerate(zip(rng.integers(0, 3, 15), rng.permutation(80)[:15], strict=True))], "k int, u int, v string")
    for exact in (False, True):
        want, got = ([tuple(r) for r in joins.asof(left, right, ["k"], "t", "u", ["v"], exact=exact, block=b).orderBy("t").collect()] for b in (None, lambda t: F.floor(t / 7)))
        assert got == want and any(r[2] for r in got)
    assert joins.asof(left.limit(0), right, ["k"], "t", "u", ["v"], block=lambda t: F.floor(t / 7)).count() == 0


@pytest.mark.parametrize("keyed", [("team_id",), ("team_id", "season")])
def test_blocks_give_the_windows_of_whole_histories(spark, keyed):
    rng = np.random.default_rng(8)
    rows = [(int(t) if t else None, int(n) % 2, n, None if n == 3 else day(int(n) // 3 * 11), None if n % 17 == 5 else float(x)) for n, (t, x) in enumerate(zip(rng.integers(0, 3, 150), rng.integers(0, 100, 150), strict=True))]
    h = spark.createDataFrame(rows, "team_id int, season int, game_id long, game_date date, x double")
    whole = h.select("game_id", W.lagged_mean("x", 6, 2, *keyed).alias("m"), F.sum("x").over(W.expanding(*keyed)).alias("s"), (F.row_number().over(W.by(*keyed)) - 1).alias("n"))
    for block, days in ((6, 40), (9, 400), (4096, 1)):
        blocked = W.totals_before(W.in_blocks(h, 6, *keyed, days=days, block=block), {"s": F.col("x")}, *keyed)
        got = W.own_rows(blocked, "game_id", W.lagged_mean("x", 6, 2, *keyed, W.BLOCK).alias("m"), "s", F.col("__n").alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())), (block, days)


def test_blocks_bound_the_rows_of_a_hot_team(spark):
    h = spark.range(5000).select(F.lit(1).alias("team_id"), F.col("id").alias("game_id"), F.expr("date_add(DATE'2000-01-01', CAST(id AS INT))").alias("game_date"), F.col("id").cast("double").alias("x"))
    sizes = W.in_blocks(h, 20, "team_id", days=100, block=500).groupBy(W.BLOCK).count().collect()
    assert max(r["count"] for r in sizes) == 520 and sum(r["count"] for r in sizes) == 5000 + 20 * 10
    assert W.own_rows(W.in_blocks(h.limit(0), 20, "team_id"), "x").count() == 0


def test_upsert_ignores_known_keys(spark):
    target = spark.createDataFrame([("1", 10)], "game_id string, score int")
    new = spark.createDataFrame([("1", 99, 1), ("2", 20, 1), ("2", 21, 2)], "game_id string, score int, version int")
    got = joins.upsert_new(target, new, "game_id", F.col("version")).select("game_id", "score").collect()
    assert sorted(map(tuple, got)) == [("1", 10), ("2", 21)]


def test_missing_source_is_an_empty_table(spark, tmp_path):
    got = loaders.load_or_empty(spark, str(tmp_path / "none.parquet"), "a int, b string")
    assert got.columns == ["a", "b"] and got.isEmpty()


def test_documents_quoted_once_more_and_bad_ones(spark):
    raw = spark.createDataFrame([('{"k": 1}',), ('"{\\"k\\": 2}"',), ("{",), (None,)], "raw string")
    got = [(r.doc.k if r.doc else None, r.bad) for r in loaders.parsed_documents(raw, "raw", "k int").collect()]
    assert got[:2] == [(1, False), (2, False)] and got[2][1] and got[3][1]


def test_scalars(spark):
    r = spark.range(1).select(
        S.haversine_miles(F.lit(40.0), F.lit(-74.0), F.lit(34.0), F.lit(-118.0)).alias("m"), S.fee(F.lit(0.5), 0.07).alias("fee"), S.kelly(F.lit(0.4), F.lit(0.5)).alias("k"), S.normal_cdf(F.lit(1.96)).alias("n"), S.season_label(F.lit("2024-10-01").cast("date")).alias("s")
    ).first()
    assert r.m == pytest.approx(2437, abs=15) and r.fee == 0.02 and r.k == 0 and r.n == pytest.approx(0.975, abs=1e-4) and r.s == "2024-25"


def test_cusum_and_exponential_mean(spark):
    assert spark.range(1).select(W.cusum_peak(F.array(*[F.lit(x) for x in (1.0, 1.0, 0.0)]), F.lit(0.5)).alias("c")).first().c == pytest.approx(0.5)
    values = [float(i * 37 % 101) for i in range(60)]
    rows = spark.createDataFrame([(t, i, day(i), x) for t in (1, 2) for i, x in enumerate(values)], "team_id int, game_id int, game_date date, x double")
    got = W.exponential_means(rows, "x", {"e": (0.3, 2)}, "team_id", block=8).where("team_id = 2").orderBy("game_id").collect()
    for n, r in enumerate(got):
        weights = [0.7 ** (n - 1 - i) for i in range(n)]
        assert r.e is None if n < 2 else r.e == pytest.approx(sum(w * x for w, x in zip(weights, values, strict=False)) / sum(weights), rel=1e-12)


def test_zermelo_orders_teams_by_strength(spark):
    g = games(spark, [(k, 1, day(k), a, b, 2.0, 1.0) for k, (a, b) in enumerate([(1, 2), (1, 2), (2, 1), (2, 3), (3, 2), (2, 3), (1, 3)])])
    got = {r.i: r.rating for r in ratings.zermelo(ratings.pair_wins(g, ["season"], (F.col("home_pts") > F.col("away_pts")).cast("double")), ["season"]).collect()}
    assert got[1] > got[2] > got[3] and sum(got.values()) / 3 == pytest.approx(1)
