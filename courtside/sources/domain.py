"""Sports and market tables, derived from the given order, line-item and event tables.

Every definition is deterministic and integer-valued where it can be; ``*_SQL`` are the same tables for the SQL that
results are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.tables import table


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each game: date, season, two unlike teams, scores without ties, and season type."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key, home = F.col("o_orderkey"), F.col("c_nationkey").cast("long")
    home_pts = (80 + F.floor("o_totalprice") % 50).cast("long")
    away_raw = (80 + (key * 7919) % 50).cast("long")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .select(
            key.alias("game_id"),
            F.to_date("o_orderdate").alias("game_date"),
            F.year("o_orderdate").cast("long").alias("season"),
            home.alias("home_team_id"),
            ((home + 1 + key % 24) % 25).alias("away_team_id"),
            home_pts.alias("home_pts"),
            F.when(away_raw == home_pts, away_raw + 1).otherwise(away_raw).alias("away_pts"),
            F.when(F.startswith("o_orderpriority", F.lit("1")), "Playoffs").otherwise("Regular").alias("season_type"),
            (15000 + (key * 31) % 5000).alias("attendance"),
        )
    )


GAMES_SQL = """
games AS (
  SELECT game_id, game_date, season, home_team_id, away_team_id, home_pts,
         CASE WHEN away_raw = home_pts THEN away_raw + 1 ELSE away_raw END AS away_pts, season_type, attendance
  FROM (
    SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS BIGINT) AS season, CAST(c_nationkey AS BIGINT) AS home_team_id,
           (c_nationkey + 1 + o_orderkey % 24) % 25 AS away_team_id,
           CAST(80 + CAST(floor(o_totalprice) AS BIGINT) % 50 AS BIGINT) AS home_pts, 80 + (o_orderkey * 7919) % 50 AS away_raw,
           CASE WHEN starts_with(o_orderpriority, '1') THEN 'Playoffs' ELSE 'Regular' END AS season_type,
           15000 + (o_orderkey * 31) % 5000 AS attendance
    FROM orders JOIN customer ON o_custkey = c_custkey
  )
)"""


def team_history(games_: DataFrame) -> DataFrame:
    """Two rows for each game, one from each side: points for and against, margin, win."""

    def side(own: str, other: str, away: int) -> DataFrame:
        return games_.select(
            F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            "game_id",
            "game_date",
            "season",
            F.lit(away).alias("is_away"),
            F.col(f"{own}_pts").alias("pf"),
            F.col(f"{other}_pts").alias("pa"),
            (F.col(f"{own}_pts") - F.col(f"{other}_pts")).alias("margin"),
            (F.col(f"{own}_pts") > F.col(f"{other}_pts")).cast("int").alias("win"),
        )

    return side("home", "away", 0).unionByName(side("away", "home", 1))


HISTORY_SQL = (
    GAMES_SQL
    + """,
history AS (
  SELECT home_team_id AS team_id, away_team_id AS opponent_id, game_id, game_date, season, 0 AS is_away, home_pts AS pf, away_pts AS pa,
         home_pts - away_pts AS margin, CAST(home_pts > away_pts AS INT) AS win FROM games
  UNION ALL
  SELECT away_team_id, home_team_id, game_id, game_date, season, 1, away_pts, home_pts, away_pts - home_pts, CAST(away_pts > home_pts AS INT) FROM games
)"""
)


def quarters(games_: DataFrame) -> DataFrame:
    """game_id, team_id, period_label, period_score: four rows for each game and side; the last takes the remainder."""
    rows = games_.select("game_id", F.col("home_team_id").alias("team_id"), F.col("home_pts").alias("pts")).unionByName(
        games_.select("game_id", F.col("away_team_id").alias("team_id"), F.col("away_pts").alias("pts"))
    )
    part = F.floor(F.col("pts") / 4).cast("long")
    return rows.select(
        "game_id", "team_id", F.explode(F.array(*[F.struct(F.lit(f"Q{q}").alias("period_label"), (part if q < 4 else F.col("pts") - 3 * part).alias("period_score")) for q in range(1, 5)])).alias("q")
    ).select("game_id", "team_id", "q.*")


QUARTERS_SQL = (
    GAMES_SQL
    + """,
sides AS (SELECT game_id, home_team_id AS team_id, home_pts AS pts FROM games UNION ALL SELECT game_id, away_team_id, away_pts FROM games),
quarters AS (
  SELECT game_id, team_id, 'Q' || q AS period_label, CASE WHEN q < 4 THEN pts // 4 ELSE pts - 3 * (pts // 4) END AS period_score
  FROM sides, (VALUES (1), (2), (3), (4)) AS t(q)
)"""
)


def officials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("official_id")).distinct()


OFFICIALS_SQL = "officials AS (SELECT DISTINCT l_orderkey AS game_id, l_suppkey AS official_id FROM lineitem)"


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), (F.col("l_linenumber") % 2).alias("side"), F.col("l_partkey").alias("player_id"), (F.col("l_returnflag") == "R").alias("inactive")
    )


ROSTERS_SQL = "rosters AS (SELECT l_orderkey AS game_id, l_linenumber % 2 AS side, l_partkey AS player_id, l_returnflag = 'R' AS inactive FROM lineitem)"


def rating_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, as_of_date, rating: one row for each team and day of the odd orders."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return (
        orders.where("o_orderkey % 2 = 1")
        .join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(F.col("c_nationkey").cast("long").alias("team_id"), F.to_date("o_orderdate").alias("as_of_date"))
        .agg(F.round(F.avg("o_totalprice"), 4).alias("rating"))
    )


RATINGS_SQL = """
snaps AS (
  SELECT CAST(c_nationkey AS BIGINT) AS team_id, CAST(o_orderdate AS DATE) AS as_of_date, round(avg(o_totalprice), 4) AS rating
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 1 GROUP BY 1, 2
)"""


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: ticker, trade_time, price in (0, 1), result, tip-off an hour after the ticker's last trade, share of its life elapsed."""
    events = table(spark, sf_dir, "events")
    times = events.groupBy("user_id").agg(F.min("ts").alias("first_time"), (F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("tipoff"))
    seconds = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 1e6
    joined = events.join(times, "user_id")
    return joined.select(
        "event_id",
        F.col("user_id").alias("ticker"),
        F.col("ts").alias("trade_time"),
        (0.02 + 0.96 * F.least("value", F.lit(150.0)) / 150).alias("yes_price"),
        (F.col("user_id") % 2).alias("actual_win"),
        "tipoff",
        (seconds(F.col("first_time"), F.col("ts")) / seconds(F.col("first_time"), F.col("tipoff"))).alias("pct_elapsed"),
        (seconds(F.col("ts"), F.col("tipoff")) / 3600).alias("hours_to_tipoff"),
        F.get_json_object("props", "$.k").cast("long").alias("size"),
        "event_type",
    )


TAPE_SQL = """
tape AS (
  SELECT event_id, user_id AS ticker, ts AS trade_time, 0.02::DOUBLE + 0.96::DOUBLE * least(value, 150.0::DOUBLE) / 150 AS yes_price, user_id % 2 AS actual_win, tipoff,
         (date_diff('microsecond', first_time, ts) / 1e6::DOUBLE) / (date_diff('microsecond', first_time, tipoff) / 1e6::DOUBLE) AS pct_elapsed,
         date_diff('microsecond', ts, tipoff) / 1e6::DOUBLE / 3600 AS hours_to_tipoff, CAST(props->>'$.k' AS BIGINT) AS size, event_type
  FROM events JOIN (SELECT user_id, min(ts) AS first_time, max(ts) + INTERVAL 1 HOUR AS tipoff FROM events GROUP BY 1) USING (user_id)
)"""


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of three models: game_id, season, y_true, a probability label, pred_a, pred_b, pred_c."""
    y = F.col("l_extendedprice") / F.col("l_quantity") / 100
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_linenumber").alias("line"),
        F.year("l_shipdate").cast("long").alias("season"),
        y.alias("y_true"),
        (F.col("l_partkey") % 2).cast("int").alias("label"),
        (y + 10 * F.col("l_discount") - 0.5).alias("pred_a"),
        (y - 10 * F.col("l_tax") + 0.4).alias("pred_b"),
        (y + (F.col("l_partkey") % 7 - 3) / 4).alias("pred_c"),
        (0.05 + 0.9 * ((F.col("l_partkey") * 13 + F.col("l_suppkey")) % 101) / 100).alias("prob"),
    )


OOF_SQL = """
oof AS (
  SELECT l_orderkey AS game_id, l_linenumber AS line, CAST(year(l_shipdate) AS BIGINT) AS season, y AS y_true, CAST(l_partkey % 2 AS INT) AS label,
         y + 10 * l_discount - 0.5::DOUBLE AS pred_a, y - 10 * l_tax + 0.4::DOUBLE AS pred_b, y + (l_partkey % 7 - 3) / 4::DOUBLE AS pred_c,
         0.05::DOUBLE + 0.9::DOUBLE * ((l_partkey * 13 + l_suppkey) % 101) / 100 AS prob
  FROM (SELECT *, l_extendedprice / l_quantity / 100 AS y FROM lineitem)
)"""


def arenas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(n.alias("team_id"), F.col("n_name").alias("name"), (25.0 + n).alias("lat"), (-120.0 + 2 * n).alias("lon"))


ARENAS_SQL = "arenas AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS name, 25.0::DOUBLE + n_nationkey AS lat, -120.0::DOUBLE + 2 * n_nationkey AS lon FROM nation)"
