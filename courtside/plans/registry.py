"""All queries of the library and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "w1_rolling_features"


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its own name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    from courtside.plans import boxscores, evaluation, features, importance, livestreams, market, models, pregame, pricing, qualification, ratingpages, ratings, scoring, selection, streams, tables  # noqa: F401


load()
