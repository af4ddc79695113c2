"""Rating systems: normal equations assembled as tables, many small solves in parallel.

Each game gives the non-zero entries of its row of the design matrix; products of entries are summed by (group, i, j),
so the matrix of a snapshot is an aggregation, and the matrices of all snapshots are running sums of daily ones. Only
the solves, one small system for each group, run in ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOME = -1


def entries(games: DataFrame, group: list[str], target: Column, weight: Column | None = None) -> DataFrame:
    """(group, game_id, w, y, i, v): +1 for the home team, -1 for the away team, 1 for home advantage."""
    cells = F.array(*[F.struct(i.alias("i"), F.lit(v).alias("v")) for i, v in ((F.col("home_team_id"), 1.0), (F.col("away_team_id"), -1.0), (F.lit(HOME).cast("long"), 1.0))])
    return games.select(*group, (F.lit(1.0) if weight is None else weight).alias("w"), target.cast("double").alias("y"), cells.alias("row"))


def normal_equations(rows: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """X'WX as (group, i, j, value) and X'Wy as (group, i, value). A row has three entries, so its products stay in its task."""
    left = rows.select(*group, "w", "y", "row", F.explode("row").alias("a"))
    matrix = left.select(*group, "w", "a", F.explode("row").alias("b")).groupBy(*group, F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("w") * F.col("a.v") * F.col("b.v")).alias("value"))
    side = left.groupBy(*group, F.col("a.i").alias("i")).agg(F.sum(F.col("w") * F.col("a.v") * F.col("y")).alias("value"))
    return matrix, side


def solve(matrix: DataFrame, side: DataFrame, group: list[str], ridge: float = 0.01, max_condition: float = 1e12) -> DataFrame:
    """(group, i, rating) of each system, with ratings that sum to zero over teams; ridge only where it is ill-conditioned."""
    both = matrix.select(*group, "i", "j", "value").unionByName(side.select(*group, "i", F.lit(None).cast("long").alias("j"), "value"))
    kinds = ", ".join(f"{g} {matrix.schema[g].dataType.simpleString()}" for g in group)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(frame["i"].unique())
        at = {n: k for k, n in enumerate(names)}
        a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
        for i, j, v in frame[["i", "j", "value"]].itertuples(index=False):
            if pd.isna(j):
                b[at[i]] += v
            else:
                a[at[i], at[int(j)]] += v
        teams = np.array([float(n != HOME) for n in names])
        a = np.vstack([np.hstack([a, teams[:, None]]), np.r_[teams, 0.0]])  # ratings sum to zero
        if np.linalg.cond(a) > max_condition:
            a[: len(names), : len(names)] += ridge * np.eye(len(names))
        x = np.linalg.lstsq(a, np.r_[b, 0.0], rcond=None)[0][: len(names)]
        return pd.DataFrame({**{g: [frame[g].iloc[0]] * len(names) for g in group}, "i": names, "rating": x})

    return both.groupBy(*group).applyInPandas(one, f"{kinds}, i long, rating double")


def colley(games: DataFrame, group: list[str]) -> DataFrame:
    """(group, i, rating): (2I + M) r = 1 + (w - l) / 2, where M counts games."""
    sides = [(F.col("home_team_id"), F.col("away_team_id"), F.col("home_pts") > F.col("away_pts")), (F.col("away_team_id"), F.col("home_team_id"), F.col("home_pts") < F.col("away_pts"))]
    rows = games.select(*group, F.explode(F.array(*[F.struct(a.alias("i"), b.alias("j"), F.when(won, 0.5).when(F.col("home_pts") == F.col("away_pts"), 0.0).otherwise(-0.5).alias("h")) for a, b, won in sides])).alias("x")).select(*group, "x.*")
    off = rows.groupBy(*group, "i", "j").agg((-F.count("*")).cast("double").alias("value"))
    own = rows.groupBy(*group, "i").agg((2 + F.count("*")).cast("double").alias("value"), (1 + F.sum("h")).alias("rhs"))
    matrix = off.unionByName(own.select(*group, "i", F.col("i").alias("j"), "value"))
    both = matrix.unionByName(own.select(*group, "i", F.lit(None).cast("long").alias("j"), F.col("rhs").alias("value")))
    kinds = ", ".join(f"{g} {games.schema[g].dataType.simpleString()}" for g in group)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(frame["i"].unique())
        at = {n: k for k, n in enumerate(names)}
        a, b = np.zeros((len(names), len(names))), np.zeros(len(names))
        for i, j, v in frame[["i", "j", "value"]].itertuples(index=False):
            if pd.isna(j):
                b[at[i]] = v
            else:
                a[at[i], at[int(j)]] = v
        return pd.DataFrame({**{g: [frame[g].iloc[0]] * len(names) for g in group}, "i": names, "rating": np.linalg.solve(a, b)})

    return both.groupBy(*group).applyInPandas(one, f"{kinds}, i long, rating double")


def running_equations(matrix: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Daily sums of a season's matrix entries as sums of all earlier days: what a pregame snapshot of each day holds."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return matrix.withColumn("before", F.sum("value").over(w))


def zermelo(wins: DataFrame, group: list[str], iterations: int = 100) -> DataFrame:
    """(group, i, rating) of Bradley-Terry strengths by Zermelo's iteration, scaled to a mean of one.

    wins: (group, i, j, w), what i won against j; aggregated per pair, so that a group has at most teams squared rows.
    """
    kinds = ", ".join(f"{g} {wins.schema[g].dataType.simpleString()}" for g in group)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*frame["i"], *frame["j"]})
        at = {n: k for k, n in enumerate(names)}
        won = np.zeros((len(names), len(names)))
        np.add.at(won, (frame["i"].map(at).to_numpy(), frame["j"].map(at).to_numpy()), frame["w"].to_numpy(float))
        met, total, r = won + won.T, won.sum(axis=1), np.ones(len(names))
        for _ in range(iterations):
            below = (met / (r[:, None] + r[None, :])).sum(axis=1)
            r = np.where(below > 0, total / np.maximum(below, 1e-12), r)
            r = r / r.mean()
        return pd.DataFrame({**{g: [frame[g].iloc[0]] * len(names) for g in group}, "i": names, "rating": r})

    return wins.groupBy(*group).applyInPandas(one, f"{kinds}, i long, rating double")


def pair_wins(games: DataFrame, group: list[str], home_share: Column) -> DataFrame:
    """(group, i, j, w): each game's share of a win on either side, summed for each ordered pair."""
    sides = F.array(F.struct(F.col("home_team_id").alias("i"), F.col("away_team_id").alias("j"), home_share.alias("w")), F.struct(F.col("away_team_id").alias("i"), F.col("home_team_id").alias("j"), (1 - home_share).alias("w")))
    return games.select(*group, F.explode(sides).alias("x")).select(*group, "x.*").groupBy(*group, "i", "j").agg(F.sum("w").alias("w"))
