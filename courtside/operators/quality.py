"""Table quality: coercion, leaks of header rows, duplicates, profiles and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numeric_where_mostly(df: DataFrame, columns: list[str], share: float = 0.5) -> DataFrame:
    """String columns as doubles where more than ``share`` of their non-null values parse: one aggregation, one projection."""
    parsed = {c: F.col(c).try_cast("double") for c in columns}
    found = df.agg(*[(F.count(parsed[c]) / F.greatest(F.count(c), F.lit(1))).alias(c) for c in columns]).first()
    return df.select(*[parsed[c].alias(c) if c in parsed and found[c] > share else F.col(c) for c in df.columns])


def all_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])


def null_share(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns]) / len(columns)


def header_leak(columns: list[str]) -> Column:
    """Rows in which a value is its own column's name."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.upper(F.col(c).cast("string")) == c.upper(), F.lit(False)) for c in columns])


def valid_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have no duplicate, at most half nulls and no header leak. Duplicates are counted by a hash of the row, so a common one is not gathered."""
    key = F.xxhash64(*columns)
    single = df.groupBy(key.alias("__h")).agg(F.count("*").alias("__n")).where("__n = 1")
    return df.withColumn("__h", key).join(single, "__h", "left_semi").where((null_share(columns) <= 0.5) & ~header_leak(columns)).drop("__h")


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """(keys, column, a, b, same): cell by cell; both null is the same."""
    a, b = (d.unpivot(keys, values, "column", n) for d, n in ((left, "a"), (right, "b")))
    same = (F.col("a").isNull() & F.col("b").isNull()) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    return a.join(b, [*keys, "column"], "full_outer").withColumn("same", same)


def latest_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
