"""Least-squares ratings before every date of a season, for several designs and targets.

A game's row of the design matrix has +1 for the home team, -1 for the away team, 1 for home advantage and the game's
factors. All designs without weights are parts of one matrix, those with a weight of another, and all targets share
them: so a season's games become two tables of daily sums of products, first by teams that met (an aggregation that
combines in each task), then by unknowns. A
season is cut into blocks of dates; a block gets the sum of all earlier blocks, and its matrices are updated date by date
and solved before each date is added (``applyInPandas``). A group holds one block's daily sums: at most the pairs of
teams that met on its dates, however many seasons, leagues or games there are.

Rules: a factor is left out on dates before which it is known for less than 75 % of games or has one value only (where
it is not known it counts as 0); a null target leaves the game out of that target only if all targets are null, and
counts as 0 otherwise; a date has ratings from ``min_games`` earlier games on. Every connected part of the schedule has
ratings that sum to zero (in place of the equation of its last team); with ``connected`` dates whose schedule has several
parts are left out. ``ridge`` is added to the diagonal where the matrix's condition is above 1e12, as it is whenever only
differences of teams are known.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.shared import materialize

HOME = -1
COVERAGE, CONDITION = 0.75, 1e12


@dataclass(frozen=True)
class Design:
    name: str
    home: bool = False
    factors: tuple[str, ...] = ()
    weight: str | None = None


#: The designs of a season's ratings; factors and weights are columns of the games.
DESIGNS = (
    Design("default_massey"),
    Design("location_adjusted_massey", True),
    Design("crowd_adjusted_massey", True, ("crowd_density",)),
    Design("crowd_weighted_massey", True, (), "crowd_weight"),
    Design("experience_adjusted_massey", True, ("visitor_inexperience",)),
    Design("travel_adjusted_massey", True, ("log_travel_distance", "travel_direction")),
    Design("context_adjusted_massey", True, ("crowd_density", "visitor_inexperience", "log_travel_distance", "travel_direction"), "crowd_weight"),
)


def parts_of(adjacent: np.ndarray) -> list[np.ndarray]:
    """The connected components of a boolean matrix, as ascending places."""
    left, found = set(range(len(adjacent))), []
    while left:
        edge = {min(left)}
        inside = set(edge)
        while edge:
            edge = set(np.flatnonzero(adjacent[sorted(edge)].any(axis=0)).tolist()) - inside
            inside |= edge
        found.append(np.array(sorted(inside)))
        left -= inside
    return found


def constrained(normal: np.ndarray, side: np.ndarray, n_teams: int, parts: list[np.ndarray], ridge: float) -> np.ndarray:
    """Solutions (a column for each target); the first ``n_teams`` unknowns are teams. Least squares if still singular."""
    a, b = normal.copy(), side.copy()
    if ridge and np.linalg.cond(a) > CONDITION:
        a[np.diag_indices(len(a))] += ridge
    for part in parts:
        a[part[-1]] = 0.0
        a[part[-1], part] = 1.0
        b[part[-1]] = 0.0
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def _factors(designs: Iterable[Design]) -> list[str]:
    return list(dict.fromkeys(f for d in designs for f in d.factors))


def daily_sums(games: DataFrame, group: list[str], day: str, designs: tuple[Design, ...], targets: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """((group, kind, day, i, j, value), (group, day, n and the count, least and largest value of each factor)).

    kind: which weight; j: another unknown (i <= j), or ``-100 - k`` for the k-th target.
    """
    factors, weights = _factors(designs), list(dict.fromkeys(d.weight for d in designs))
    known = games.where(F.coalesce(*targets.values()).isNotNull())
    # the games of two teams on a day are summed first: their rows differ in factors, weights and targets only
    basis = [F.lit(1.0), *[F.coalesce(F.col(f), F.lit(0.0)).cast("double") for f in factors]]
    values = [*basis, *[F.coalesce(y, F.lit(0.0)).cast("double") for y in targets.values()]]
    weight = [(F.lit(1.0) if w is None else F.greatest(F.coalesce(F.col(w), F.lit(1.0)), F.lit(1e-6))).cast("double") for w in weights]
    summed = [F.sum(w * a * values[q]).alias(f"s{k}_{p}_{q}") for k, w in enumerate(weight) for p, a in enumerate(basis) for q in range(p, len(values))]
    pairs = known.groupBy(*group, F.col(day).alias("day"), "home_team_id", "away_team_id").agg(*summed)
    cell = lambda i, v, at: F.struct(i.cast("long").alias("i"), F.lit(v).alias("v"), F.lit(at).alias("at"))
    row = [cell(F.col("home_team_id"), 1.0, 0), cell(F.col("away_team_id"), -1.0, 0), cell(F.lit(HOME), 1.0, 0)]
    row += [cell(F.lit(HOME - 1 - k), 1.0, 1 + k) for k in range(len(factors))]
    sides = [cell(F.lit(-100 - k), 1.0, len(basis) + k) for k in range(len(targets))]
    # the sums of a weight by places: those of a (in the basis), then those of b
    flat = lambda k: F.array(*[F.col(f"s{k}_{min(p, q)}_{max(p, q)}") for p in range(len(basis)) for q in range(len(values))])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), flat(k).alias("sums")) for k in range(len(weights))]))
    cells = pairs.select(*group, "day", F.array(*row).alias("row"), F.array(*sides).alias("sides"), kinds.alias("k"))
    cells = cells.select(*group, "day", "k", "row", "sides", F.explode("row").alias("a"))
    cells = cells.select(*group, "day", "k.kind", "k.sums", "a", F.explode(F.concat("row", "sides")).alias("b")).where("b.i <= -100 OR a.i <= b.i")
    value = F.col("a.v") * F.col("b.v") * F.get("sums", F.col("a.at") * len(values) + F.col("b.at"))
    cells = cells.groupBy(*group, "kind", "day", F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(value).alias("value"))
    seen = [c for k, f in enumerate(factors) for c in (F.count(f).alias(f"n_{k}"), F.min(F.col(f).cast("double")).alias(f"low_{k}"), F.max(F.col(f).cast("double")).alias(f"high_{k}"))]
    return cells, known.groupBy(*group, F.col(day).alias("day")).agg(F.count("*").alias("n"), *seen)


def pregame_ratings(
    games: DataFrame, group: list[str], day: str = "game_date", designs: tuple[Design, ...] = DESIGNS, targets: dict[str, Column] | None = None, min_games: int = 10, connected: bool = True, ridge: float = 0.01, block: int = 60
) -> DataFrame:
    """group, day, design, target, i, rating: what was known before each date.

    i: a team, or below zero a coefficient: home advantage (-1) and the factors of all designs in order (-2, -3, ...).
    games: group, day, home_team_id, away_team_id, the designs' factors and weights, and what ``targets`` (name -> value;
    the home margin if not given) are made of.
    """
    targets = targets or {"margin": F.col("home_pts") - F.col("away_pts")}
    cells, days = daily_sums(games, group, day, designs, targets)
    cells, days = materialize(cells, "daily-cells"), materialize(days, "daily-games")
    # dates are numbered inside their group by the table of days, which has a row for each date
    start = days.groupBy(*group).agg(F.min("day").alias("__start"), F.max("day").alias("__end"))
    place = F.floor(F.date_diff(F.col("day"), F.col("__start")) / block)
    later = F.sequence(F.col("block") + 1, F.floor(F.date_diff(F.col("__end"), F.col("__start")) / block))
    placed = lambda df: df.join(start, group).withColumn("block", place)
    carried = lambda df: df.where(F.col("block") < F.floor(F.date_diff(F.col("__end"), F.col("__start")) / block)).withColumn("block", F.explode(later))
    none = F.lit(None).cast(days.schema["day"].dataType).alias("day")

    c = placed(cells)
    before = carried(c.groupBy(*group, "kind", "block", "i", "j", "__start", "__end").agg(F.sum("value").alias("value"))).groupBy(*group, "kind", "block", "i", "j").agg(F.sum("value").alias("value"))
    all_cells = c.select(*group, "kind", "block", "day", "i", "j", "value").unionByName(before.select(*group, "kind", "block", none, "i", "j", "value"))

    def seen(df: DataFrame, *keys: str) -> DataFrame:
        sums = [f(name).alias(name) for name in days.columns if name not in (*group, "day") for f in [F.min if name.startswith("low_") else F.max if name.startswith("high_") else F.sum]]
        return df.groupBy(*group, "block", *keys).agg(*sums)

    d = placed(days)
    all_days = d.drop("__start", "__end").unionByName(seen(carried(seen(d, "__start", "__end"))).select("*", none).select(*[x for x in d.columns if x not in ("__start", "__end")]))
    weights = list(dict.fromkeys(x.weight for x in designs))
    all_days = all_days.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in range(len(weights))])))

    factors, names = _factors(designs), list(targets)
    kinds = ", ".join(f"{g} {games.schema[g].dataType.simpleString()}" for g in group)
    schema = f"{kinds}, {day} {days.schema['day'].dataType.simpleString()}, design string, target string, i long, rating double"

    def solve(key: tuple, cells: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        kind = key[-2]
        ids = sorted({*cells["i"], *cells["j"][cells["j"] > -100]}, key=lambda i: (i < 0, abs(i)))
        at = {i: k for k, i in enumerate(ids)}
        n_ids = sum(i >= 0 for i in ids)
        a, b = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(names)))
        n, known = 0, {k: (0, np.inf, -np.inf) for k in range(len(factors))}
        out = []
        by_day = {d: rows for d, rows in cells.groupby("day", dropna=False)}
        days = days.sort_values("day", na_position="first")
        for d in days.itertuples(index=False):
            if not pd.isna(d.day) and n >= min_games:
                teams = np.flatnonzero(np.diag(a)[:n_ids] > 0)
                parts = parts_of(a[np.ix_(teams, teams)] != 0)
                if len(parts) == 1 or not connected:
                    for design in designs:
                        if weights.index(design.weight) != kind:
                            continue
                        use = [factors.index(f) for f in design.factors]
                        use = [k for k in use if known[k][0] >= COVERAGE * n and known[k][1] < known[k][2]]
                        more = [at[HOME]] * design.home + [at[HOME - 1 - k] for k in use]
                        places = np.r_[teams, np.array(more, int)]
                        x = constrained(a[np.ix_(places, places)], b[places], len(teams), parts, ridge)
                        out += [(d.day, design.name, t, ids[p], x[r, c]) for r, p in enumerate(places) for c, t in enumerate(names)]
            new = by_day.get(d.day) if not pd.isna(d.day) else cells[cells["day"].isna()]
            if new is not None and len(new):
                side = (new["j"] <= -100).to_numpy()
                i = new["i"].map(at).to_numpy()
                np.add.at(b, (i[side], -100 - new["j"].to_numpy()[side]), new["value"].to_numpy()[side])
                i, j, v = i[~side], new["j"][~side].map(at).to_numpy(), new["value"].to_numpy()[~side]
                np.add.at(a, (i, j), v)
                off = i != j
                np.add.at(a, (j[off], i[off]), v[off])
            n += d.n
            for k in known:
                c, low, high = known[k]
                known[k] = (c + getattr(d, f"n_{k}"), np.nanmin([low, getattr(d, f"low_{k}")]), np.nanmax([high, getattr(d, f"high_{k}")]))
        frame = pd.DataFrame(out, columns=[day, "design", "target", "i", "rating"])
        for g, v in zip(group, key, strict=False):
            frame.insert(0, g, v)
        return frame

    keys = [*group, "kind", "block"]
    all_cells = materialize(all_cells, "block-cells")  # the two sides share no columns then
    return all_cells.groupBy(*keys).cogroup(all_days.groupBy(*keys)).applyInPandas(solve, schema)


def wide(ratings: DataFrame, group: list[str], day: str, columns: dict[tuple[str, str], str]) -> DataFrame:
    """(group, day, team_id) with a column of ratings for each (design, target)."""
    picked = [F.max(F.when((F.col("design") == d) & (F.col("target") == t), F.col("rating"))).alias(name) for (d, t), name in columns.items()]
    return ratings.where("i >= 0").groupBy(*group, day, F.col("i").alias("team_id")).agg(*picked)


def aligned(games: DataFrame, ratings: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """games with ``home_*`` and ``away_*`` of a (on, team_id) table of pregame values, by equality of ``on``; ranks stay out."""
    out = games
    for side in ("home", "away"):
        out = out.join(ratings.select(*on, F.col("team_id").alias(f"{side}_team_id"), *[F.col(n).alias(f"{side}_{n}") for n in names]), [*on, f"{side}_team_id"], "left")
    return out


def matchup_diffs(aligned_games: DataFrame, names: list[str]) -> DataFrame:
    """game_id, team_a_id (the lower id), team_b_id, who of them was at home and won, and ``diff_*`` of a less b."""
    a_home = F.col("home_team_id") < F.col("away_team_id")
    sign = F.when(a_home, 1.0).otherwise(-1.0)
    won = F.when(a_home, F.col("home_pts") > F.col("away_pts")).otherwise(F.col("away_pts") > F.col("home_pts"))
    diffs = [(sign * (F.col(f"home_{n}") - F.col(f"away_{n}"))).alias(f"diff_{n}") for n in names]
    return aligned_games.select(
        "season", "game_id", "game_date", F.least("home_team_id", "away_team_id").alias("team_a_id"), F.greatest("home_team_id", "away_team_id").alias("team_b_id"), a_home.cast("int").alias("team_a_is_home"), won.cast("int").alias("team_a_wins"), *diffs
    )


def backfilled(existing: DataFrame, games: DataFrame, group: str, keys: list[str], names: list[str], compute) -> DataFrame:
    """``existing`` with missing values of ``names`` computed; only groups (seasons) that miss some are computed at all.

    compute: from games to a table of keys and names. Values that are there stay.
    """
    missing = existing.where(" OR ".join(f"{n} IS NULL" for n in names)).select(group).distinct()
    new = compute(games.join(missing, group, "left_semi")).select(*keys, *[F.col(n).alias(f"__{n}") for n in names])
    joined = existing.join(new, keys, "left")
    return joined.select(*[F.coalesce(c, f"__{c}").alias(c) if c in names else F.col(c) for c in existing.columns])
