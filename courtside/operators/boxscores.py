"""Box scores: categories put side by side, game rows from both teams, ids and names resolved by lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_name(name: str) -> str:
    """A column name in lower case, with signs spelt out."""
    out = name.strip().lower()
    for sign, word in (("+/-", "plus_minus"), ("%", "pct"), ("/", "_"), (" ", "_")):
        out = out.replace(sign, word)
    return out


def normalized(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(normalized_name(c)) for c in df.columns])


def joined_categories(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The first category's rows with the columns of the others; a column that an earlier category has is left out."""

    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(*keys, *[c for c in b.columns if c not in a.columns]), keys, "left")

    return reduce(add, parts)


def game_rows(box: DataFrame, key: str, is_home: Column) -> DataFrame:
    """One row for each game: its home row and its away row side by side, prefixed; games without one of them are left out."""
    side = lambda which, prefix: box.where(which).select(F.col(key), *[F.col(c).alias(f"{prefix}_{c}") for c in box.columns if c != key])
    return side(is_home, "home").join(side(~is_home, "away"), key)


def named_ids(names: DataFrame, dimension: DataFrame, name: str, label: str, id_: str) -> DataFrame:
    """Distinct ``name`` values with the id whose label equals them or, else, contains them or is contained (the least such id).

    Only names without an equal label meet all labels; the dimension is one of teams, at most some thousands of rows.
    """
    distinct = names.select(name).distinct()
    exact = distinct.join(dimension.select(F.lower(label).alias("__l"), F.col(id_).alias("__exact")), F.lower(name) == F.col("__l"), "left").drop("__l")
    small = dimension.select(F.lower(label).alias("__label"), F.col(id_).alias("__id"))
    if dimension.count() <= 10_000:
        small = F.broadcast(small)
    loose = exact.where("__exact IS NULL").join(small, F.lower(name).contains(F.col("__label")) | F.col("__label").contains(F.lower(name))).groupBy(name).agg(F.min("__id").alias("__loose"))
    return exact.join(loose, name, "left").select(name, F.coalesce("__exact", "__loose").alias(id_))


def unique_lookup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key that has one only, so that a join on the keys can't add rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(value).alias(value)).where("__n = 1").drop("__n")


def student_t_cdf(t: Column, df: int) -> Column:
    """Student's t distribution function for a whole number of degrees of freedom: the finite series in cos and sin of atan(t / sqrt(df))."""
    theta = F.atan(t / df**0.5)
    cos2, sin, cos = F.pow(F.cos(theta), F.lit(2)), F.sin(theta), F.cos(theta)
    term, total = F.lit(1.0), F.lit(0.0)
    if df % 2:
        for k in range(1, (df - 1) // 2 + 1):
            term = cos if k == 1 else term * cos2 * (2 * k - 2) / (2 * k - 1)
            total = total + term
        area = 2 / 3.141592653589793 * (theta + sin * total)
    else:
        for k in range(df // 2):
            term = F.lit(1.0) if k == 0 else term * cos2 * (2 * k - 1) / (2 * k)
            total = total + term
        area = sin * total
    return 0.5 + area / 2
