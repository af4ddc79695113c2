"""Joins that Spark has no single keyword for: as-of, range-to-bin, lookup with fallback, change sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of ``other``, which has one row for each of its keys; null keys meet."""
    renamed = other.select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, on, "left").drop(*[f"__key_{i}" for i in range(len(keys))])


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], exact: bool = False, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the last right row of its key before its time (or at it, with ``exact``).

    Both sides go into one sorted window, so the cost is one shuffle on the keys and a key's rows are read once; the
    whole right row is carried, so that nulls in single values stay with their row. ``block`` (a column function that
    never falls as time rises, such as the month) splits a key's rows: windows then end with a block, and the last right row
    of the blocks before is brought to it, one row for each block.
    """
    kind = 0 if exact else 2
    lefts = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__k"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(_struct(right, values + [right_time])).alias("__right"))
    rights = right.select(*keys, F.col(right_time).alias("__t"), F.lit(kind).alias("__k"), F.lit(None).cast(_struct(left, left.columns)).alias("__left"), F.struct(*values, right_time).alias("__right"))
    rows, split, brought = lefts.unionByName(rights), list(keys), F.lit(None)
    if block is not None:
        rows, split = rows.withColumn("__block", block(F.col("__t"))), [*keys, "__block"]
        last = rows.groupBy(*split).agg(F.max_by("__right", F.when(F.col("__k") == kind, F.col("__t"))).alias("__last"))
        earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        rows = beside(rows, last.select(*split, F.last("__last", ignorenulls=True).over(earlier).alias("__brought")), split)
        brought = F.col("__brought")
    window = Window.partitionBy(*split).orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__found", F.coalesce(F.last("__right", ignorenulls=True).over(window), brought)).where("__k = 1")
    return found.select("__left.*", *[F.col(f"__found.{v}").alias(v) for v in [*values, right_time]])


def _struct(df: DataFrame, names: list[str]) -> str:
    return "struct<" + ",".join(f"{n}:{df.schema[n].dataType.simpleString()}" for n in names) + ">"


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the last in the given order."""
    window = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def upsert_new(target: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """Insert-only by key: rows of keys present already are ignored, new ones are deduplicated, the last one stays."""
    fresh = keep_last(new, [key], *order).join(target.select(key).distinct(), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def in_bins(df: DataFrame, value: str, edges: list[float], closed: str = "left") -> Column:
    """The number of the bin of ``value``: [a, b) or, closed right, (a, b]; null outside."""
    x, out = F.col(value), F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (x >= edges[i]) & (x < edges[i + 1]) if closed == "left" else (x > edges[i]) & (x <= edges[i + 1])
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out
