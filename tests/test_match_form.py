"""The form before a match: windows see ten games of a team's day at most, and the SQL's rows come out."""

import os

import duckdb
from pyspark.sql import functions as F

from courtside.plans import scoring as P

SF = "/root/testdata/sf0.001"


def test_form_windows_see_ten_games_of_a_day(spark, tmp_path, monkeypatch):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    n = orders.agg(F.max("o_orderkey")).first()[0] + 1
    more = orders.crossJoin(spark.range(12).withColumnRenamed("id", "i")).withColumn("o_orderkey", (F.col("o_orderkey") + F.col("i") * n).cast(orders.schema["o_orderkey"].dataType)).drop("i")
    few_days = F.date_add(F.to_date(F.lit("1997-12-01")), (F.col("o_orderkey") % 40).cast("int")).cast(orders.schema["o_orderdate"].dataType)
    more.withColumn("o_orderdate", few_days).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    os.symlink(f"{SF}/customer.parquet", f"{tmp_path}/customer.parquet")
    most, deal = [], P.W.in_blocks
    monkeypatch.setattr(P.W, "in_blocks", lambda df, *a, **b: most.append(df.groupBy("team_id", "game_date").count().agg(F.max("count")).first()[0]) or deal(df, *a, **b))
    got = {r.game_id: (r.home_pf, r.home_pa, r.away_pf, r.away_pa) for r in P._form(spark, str(tmp_path)).collect()}
    assert most == [10]
    db = duckdb.connect()
    for t, path in (("orders", f"{tmp_path}/orders.parquet/*.parquet"), ("customer", f"{SF}/customer.parquet")):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want = {r[0]: r[1:] for r in db.execute(f"WITH {P._FORM_SQL} SELECT game_id, hf, ha, af, aa FROM d").fetchall()}
    assert got.keys() == want.keys() and len(got) > 10_000
    assert all(x == y or abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
