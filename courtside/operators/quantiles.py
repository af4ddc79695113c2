"""Exact quantiles and ranks of whole columns without gathering their values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.shared import materialize


def _place(x, a: float, b: float, buckets: int, by_size: bool):
    """The part, of ``buckets``, of the range from a to b that x lies in; by_size: parts of equal ratio, for values of many sizes."""
    if by_size:
        spread = lambda v: math.copysign(math.log1p(abs(v)), v)
        low, high = spread(a), spread(b)
        if low < high:
            x = F.signum(x) * F.log1p(F.abs(x))
            return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((x - low) / (high - low) * buckets).cast("int")))
    # halves, so that the width of a range is no larger than a double can hold
    return F.least(F.lit(buckets - 1), F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * buckets).cast("int"))


def exact_quantiles_of(df: DataFrame, values: dict[str, Column], probs: list[float], buckets: int = 1024) -> dict[str, list[float | None]]:
    """For each named column the quantiles that ``percentile`` gives (linear between ranks); None without values.

    The columns are written once and values counted by ranges, for all columns at once, which combines in each task; each
    round goes on with the range that holds a rank, cut in ``buckets`` parts, until all of its values are equal. At most
    that many rows for each rank come to the driver. Every round sets a range's ends apart, so that it ends; every second
    one cuts by ratios. Infinite values and NaN (the largest of all) are counted apart.
    """
    names = list(values)
    x = materialize(df.select(*[values[n].cast("double").alias(f"c{k}") for k, n in enumerate(names)]), "quantile-columns")
    inf = F.lit(float("inf"))
    told = []
    for k in range(len(names)):
        c = F.col(f"c{k}")
        finite = ~F.isnan(c) & (F.abs(c) < inf)
        told.append(F.struct(F.count_if(finite).alias("n"), F.min(F.when(finite, c)).alias("low"), F.max(F.when(finite, c)).alias("high"), F.count_if(c == -inf).alias("under"), F.count_if((c == inf) & ~F.isnan(c)).alias("over"), F.count(c).alias("all")).alias(f"c{k}"))
    ends = x.agg(*told).first()
    found: list[dict[int, float]] = [{} for _ in names]
    places: list[list[float]] = []
    open_: dict[tuple[int, float, float, int], set[int]] = {}  # (column, least, largest, finite values below): ranks in it
    for k in range(len(names)):
        e = ends[f"c{k}"]
        places.append([p * (e["all"] - 1) for p in probs] if e["all"] else [])
        for r in {r for a in places[k] for r in (int(a), min(int(a) + 1, e["all"] - 1))}:
            at = r - e["under"]
            if at < 0:
                found[k][r] = -math.inf
            elif at >= e["n"]:
                found[k][r] = math.inf if at < e["n"] + e["over"] else math.nan
            else:
                open_.setdefault((k, e["low"], e["high"], 0), set()).add(r)
    turn = 0
    while open_:
        for (k, a, b, _), ranks in open_.items():
            if a == b:
                found[k] |= dict.fromkeys(ranks, a)
        ranges = [r for r in open_ if r[1] < r[2]]
        if not ranges:
            break
        parts = [F.when(F.col(f"c{k}").between(a, b), F.struct(F.lit(i).alias("range"), _place(F.col(f"c{k}"), a, b, buckets, turn % 2 == 1).alias("part"), F.col(f"c{k}").alias("x"))) for i, (k, a, b, _) in enumerate(ranges)]
        counted = x.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).groupBy("p.range", "p.part").agg(F.count("*").alias("n"), F.min("p.x").alias("a"), F.max("p.x").alias("b")).collect()
        next_: dict[tuple[int, float, float, int], set[int]] = {}
        for i, r in enumerate(ranges):
            k, below = r[0], r[3]
            for row in sorted((c for c in counted if c["range"] == i), key=lambda c: c["part"]):
                first = below + ends[f"c{k}"]["under"]
                inside = {q for q in open_[r] if first <= q < first + row["n"]}
                if inside:
                    next_.setdefault((k, row["a"], row["b"], below), set()).update(inside)
                below += row["n"]
        open_, turn = next_, turn + 1
    out: dict[str, list[float | None]] = {}
    for k, name in enumerate(names):
        n = ends[f"c{k}"]["all"]
        sides = [(a, found[k][int(a)], found[k][min(int(a) + 1, n - 1)]) for a in places[k]]
        out[name] = [x if x == y or a == int(a) else (int(a) + 1 - a) * x + (a - int(a)) * y for a, x, y in sides] or [None] * len(probs)
    return out


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], buckets: int = 1024) -> list[float | None]:
    """``exact_quantiles_of`` for one column."""
    return exact_quantiles_of(df, {"x": value}, probs, buckets)["x"]


def cumulative_counts(df: DataFrame, value: Column) -> DataFrame:
    """x, n, below: each distinct value (nulls and NaN left out), its rows and the rows with smaller values.

    Values are counted first, the distinct ones laid out by ranges; windows run inside a range, and over one row for each.
    """
    counted = df.select(value.cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").groupBy("x").agg(F.count("*").alias("n"))
    laid = materialize(counted.repartitionByRange("x").withColumn("__part", F.spark_partition_id()), "counted-values")
    sums = laid.groupBy("__part").agg(F.sum("n").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    joined = laid.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, "__part")
    return joined.select("x", "n", (F.col("__before") + F.col("__in")).alias("below"))
