"""Ratings that differ by exactly the limit do not differ, whatever the last bit of a double."""

import random
from datetime import date, timedelta

import duckdb
from pyspark.sql import functions as F

from courtside.plans import registry
from courtside.sources import domain as D


def test_difference_of_exactly_one(spark, tmp_path):
    # r + 1 passes 2^17, where doubles are coarser: the difference is more than 1 for some of these, less for others
    prices = [131071.0 + k / 61 for k in range(60)]
    assert any(round(p, 4) + 1 - round(p, 4) > 1 for p in prices)
    spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    rows = [(2 * k + 1, 1, p, date(1995, 1, 1) + timedelta(days=k)) for k, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.QUERIES["j17_rating_audit"](spark, str(tmp_path)).collect()
    assert {r["flags"] for r in got} == {""} and len(got) == 60
    duck = duckdb.connect()
    for t in ("orders", "customer"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted((r["team_id"], r["day"], r["flags"]) for r in got) == sorted(duck.execute(registry.SQL["j17_rating_audit"]).fetchall())


def test_a_rating_is_averaged_once_for_both_tables(spark, monkeypatch):
    # an average that comes out otherwise each time it is taken, as one on a rounding tie may
    drawn = F.udf(lambda: random.uniform(0, 1e6), "double").asNondeterministic()
    days = spark.range(60).select(F.lit(1).cast("long").alias("team_id"), F.date_add(F.lit(date(1995, 1, 1)), F.col("id").cast("int")).alias("as_of_date"))
    monkeypatch.setattr(D, "rating_snapshots", lambda *_: days.withColumn("rating", F.round(drawn(), 4)))
    assert {r["flags"] for r in registry.QUERIES["j17_rating_audit"](spark, "").collect()} == {""}


def test_days_whose_rating_is_null_are_there(spark, tmp_path):
    spark.createDataFrame([(k, k) for k in range(1, 21)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    prices = [None, float("nan"), float("inf"), 7.25]
    rows = [(2 * k + 1, k % 20 + 1, prices[k // 20], date(1995, 1, 1) + timedelta(days=k // 20)) for k in range(80)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r["team_id"], r["day"], r["flags"]) for r in registry.QUERIES["j17_rating_audit"](spark, str(tmp_path)).collect())
    assert (1, date(1995, 1, 1), "") in got and (4, date(1995, 1, 1), "no_a") in got
    duck = duckdb.connect()
    for t in ("orders", "customer"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(duck.execute(registry.SQL["j17_rating_audit"]).fetchall())
