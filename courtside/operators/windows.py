"""Pregame windows: what was known about a team before each of its games.

All frames end at the row before the current one, in the order (game_date, game_id). Windows over the same partition
and order share one shuffle and one sort; each helper returns columns, so that callers put many into one ``select``.

A team's history is not one partition: ``in_blocks`` numbers its rows and deals them to blocks of bounded size, each with
the few rows before it that frames reach back to, and ``totals_before`` carries sums over whole histories from block to
block. Windows then take BLOCK as their last key, and ``own_rows`` selects what belongs to a block itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from courtside.operators.joins import beside

ORDER = ("game_date", "game_id")
#: The key of the block, for windows over rows dealt by ``in_blocks``.
BLOCK = "__block"


def by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*ORDER)


def lagged(n: int, *keys: str) -> WindowSpec:
    """The n rows before the current one."""
    return by(*keys).rowsBetween(-n, -1)


def expanding(*keys: str) -> WindowSpec:
    """All rows before the current one."""
    return by(*keys).rowsBetween(Window.unboundedPreceding, -1)


def in_blocks(df: DataFrame, reach: int, *keys: str, days: int = 512, block: int = 2048) -> DataFrame:
    """df with each row's number in its keys (__n), its block and __carried: true for copies of the ``reach`` rows before a block.

    Rows are numbered inside spans of days, and a span begins after the rows of all earlier spans, which are counted first:
    no task holds more of a key than one span or one block. Rows that tie in date and game are numbered in any order.
    Rows with a null key are a key of their own, those without a date come first.
    """
    block = max(block, reach, 1)
    dated = df.withColumn("__span", F.floor(F.unix_date(F.col("game_date").cast("date")) / days))
    counts = dated.groupBy(*keys, "__span").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__span", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    numbered = beside(dated, starts, [*keys, "__span"]).withColumn("__n", F.col("__start") + F.row_number().over(by(*keys, "__span")) - 1)
    own = F.floor(F.col("__n") / block)
    place = lambda b, carried: F.struct(b.alias(BLOCK), F.lit(carried).alias("__carried"))
    if reach:
        last = F.col("__n") % block >= block - reach
        return numbered.select(*df.columns, "__n", F.inline(F.when(last, F.array(place(own, False), place(own + 1, True))).otherwise(F.array(place(own, False)))))
    return numbered.select(*df.columns, "__n", own.alias(BLOCK), F.lit(False).alias("__carried"))


def own_rows(blocked: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, windows among them, for rows that are not carried."""
    return blocked.select("__carried", *columns).where(~F.col("__carried")).drop("__carried")


def totals_before(blocked: DataFrame, totals: dict[str, Column], *keys: str) -> DataFrame:
    """blocked with sums over all rows before by name (null if there is no value); carried rows hold no sums that count."""
    own = {n: F.when(~F.col("__carried"), c) for n, c in totals.items()}
    by_block = blocked.groupBy(*keys, BLOCK).agg(*[F.sum(c).alias(n) for n, c in own.items()])
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    brought = by_block.select(*keys, BLOCK, *[F.sum(n).over(earlier).alias(f"__before_{n}") for n in totals])
    inside = expanding(*keys, BLOCK)
    columns = []
    for n, c in own.items():
        here, before = F.sum(c).over(inside), F.col(f"__before_{n}")
        columns.append(F.coalesce(here + before, here, before).alias(n))
    return beside(blocked, brought, [*keys, BLOCK]).select(*blocked.columns, *columns)


def at_least(x: Column, value: Column, window: WindowSpec, least: int) -> Column:
    """``value`` over the window, null with fewer than ``least`` non-null x in it."""
    return F.when(F.count(x).over(window) >= least, value.over(window))


def lagged_mean(name: str, n: int, least: int, *keys: str) -> Column:
    x = F.col(name)
    return at_least(x, F.avg(x), lagged(n, *keys), least)


def lagged_std(name: str, n: int, least: int, *keys: str) -> Column:
    x = F.col(name)
    return at_least(x, F.stddev_samp(x), lagged(n, *keys), least)


def rolling_features(history: DataFrame, stats: list[str], windows: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Lagged mean (1 row at least) and standard deviation (2) of each statistic, wins of the last 20, days of rest, back-to-back flag."""
    keys = ("team_id", BLOCK)
    last = F.lag("game_date").over(by(*keys))
    rest = F.date_diff(F.col("game_date"), last)
    columns = [c for s in stats for n in windows for c in (lagged_mean(s, n, 1, *keys).alias(f"{s}_mean_{n}"), lagged_std(s, n, 2, *keys).alias(f"{s}_std_{n}"))]
    streak = F.sum("win").over(lagged(20, *keys)).alias("win_streak")
    return own_rows(in_blocks(history, max(*windows, 20), "team_id"), "team_id", "game_id", "game_date", *columns, streak, rest.alias("days_rest"), F.coalesce(rest <= 1, F.lit(False)).cast("int").alias("is_back_to_back"))


def to_games(games: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Features of team histories put beside each game, as ``home_*`` and ``away_*``: two equi-joins on (team, game)."""
    out = games
    for side in ("home", "away"):
        part = features.select(F.col("team_id").alias(f"{side}_team_id"), "game_id", *[F.col(n).alias(f"{side}_{n}") for n in names])
        out = out.join(part, [f"{side}_team_id", "game_id"], "left")
    return out


def entropy(p: Column) -> Column:
    """Shannon entropy of a Bernoulli variable in bits; 0 at the ends."""
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), F.when(p.isNotNull(), F.lit(0.0))).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def cusum_peak(values: Column, mean: Column, threshold: float = 0.05) -> Column:
    """The largest of a two-sided CUSUM over an array, each side reset at 0 and both after the threshold is passed."""

    def step(s: Column, x: Column) -> Column:
        up = F.greatest(F.lit(0.0), s["up"] + x - mean)
        down = F.least(F.lit(0.0), s["down"] + x - mean)
        peak = F.greatest(s["peak"], up, -down)
        passed = (up > threshold) | (-down > threshold)
        return F.struct(F.when(passed, 0.0).otherwise(up).alias("up"), F.when(passed, 0.0).otherwise(down).alias("down"), peak.alias("peak"))

    zero = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.lit(0.0).alias("peak"))
    return F.aggregate(values, zero, step, lambda s: s["peak"])


def exponential_means(history: DataFrame, name: str, means: dict[str, tuple[float, int]], key: str, block: int = 256) -> DataFrame:
    """history with exponentially weighted means of ``name`` over all rows before, by name of result: (alpha, least rows).

    Weights (1 - alpha)^age are normalised. Rows are numbered in each key and dealt to blocks; in a block they are sums of
    scaled values, and what the blocks before leave is a sum over the last few block totals: further ones weigh less than
    a double can show (``block`` * number of totals rows at least).
    """
    numbered = in_blocks(history, 0, key, block=block).withColumn("__pos", F.col("__n") % block)
    weight = lambda q, power: F.pow(F.lit(q), power)
    blocks = numbered.groupBy(key, "__block").agg(*[F.sum(F.col(name) * weight(1 - a, block - 1 - F.col("__pos"))).alias(f"__total_{m}") for m, (a, _) in means.items()])
    before = Window.partitionBy(key).orderBy("__block")
    carried = []
    for m, (a, _) in means.items():
        lags, reach = [], max(1, -(-600 // block))
        while (1 - a) ** (block * reach) > 1e-18:
            reach += 1
        for k in range(1, reach + 1):
            lags.append(F.coalesce(F.lag(f"__total_{m}", k).over(before), F.lit(0.0)) * (1 - a) ** (block * (k - 1)))
        carried.append(sum(lags[1:], lags[0]).alias(f"__carry_{m}"))
    joined = numbered.join(blocks.select(key, "__block", *carried), [key, "__block"])
    inside = Window.partitionBy(key, "__block").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for m, (a, least) in means.items():
        q = 1 - a
        local = F.coalesce(F.sum(F.col(name) * weight(q, -F.col("__pos"))).over(inside), F.lit(0.0)) * weight(q, F.col("__pos") - 1)
        total = local + F.col(f"__carry_{m}") * weight(q, F.col("__pos"))
        out.append(F.when(F.col("__n") >= least, total * a / (1 - weight(q, F.col("__n")))).alias(m))
    return joined.select(*history.columns, *out)
