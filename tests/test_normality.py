"""Normality tests against a published example and sums over sorted values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.operators import normality as N

RNG = np.random.default_rng(3)


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_published_example(spark):
    # cholesterol of 62 persons, as D'Agostino, Belanger and D'Agostino (1990) give it: scores 3.14 and 2.21, K squared 14.75
    n = F.lit(62.0)
    s, k = spark.range(1).select(N.skew_z(n, F.lit(1.02)), N.kurtosis_z(n, F.lit(1.58))).first()
    assert (s, k, s * s + k * k) == (pytest.approx(3.14, abs=0.01), pytest.approx(2.21, abs=0.01), pytest.approx(14.75, abs=0.1))


def test_tail_of_the_normal(spark):
    zs = [0.0, 0.3, 1.0, 2.49, 2.5, 4.0, 9.0, 30.0]
    got = [r[0] for r in column(spark, zs).select(N.normal_tail(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) / 2 for z in zs], rel=1e-9)


@pytest.mark.parametrize("rounded", [False, True])
def test_anderson_darling_equals_the_sum_over_sorted_values(spark, rounded):
    x = RNG.normal(50, 4, 700)
    x = np.sort(np.round(x) if rounded else x)
    z = (x - x.mean()) / x.std(ddof=1)
    upper = np.array([math.erfc(v / math.sqrt(2)) / 2 for v in z])
    lower = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in z])
    i = np.arange(1, len(x) + 1)
    want = -len(x) - ((2 * i - 1) * (np.log(lower) + np.log(upper[::-1]))).mean()
    got = N.anderson_darling(column(spark, x), F.col("x")).first()
    assert got["ad"] == pytest.approx(want, rel=1e-8) and got["rejected"] == (want > got["critical"])


def test_what_is_and_is_not_normal(spark):
    for values, normal in ((RNG.normal(0, 1, 5000), True), (RNG.exponential(1, 5000), False), (RNG.random(5000), False)):
        df = column(spark, values)
        m = N.moment_tests(df, F.col("x")).first()
        assert (m["k2_p"] > 0.01, m["jb_p"] > 0.01) == (normal, normal)
        assert N.anderson_darling(df, F.col("x")).first()["rejected"] != normal


def test_few_equal_and_missing_values(spark):
    rows = [("few", 1.0), ("few", 2.0), ("same", 3.0), *[("same", 3.0)] * 9, ("none", None), *[("gaps", v) for v in (None, math.nan, *map(float, range(9)))]]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in N.moment_tests(df, F.col("x"), "g").collect()}
    assert [got[g]["k2"] for g in ("few", "same", "none")] == [None] * 3 and got["gaps"]["n"] == 9 and got["gaps"]["k2"] > 0
    for g in ("few", "same", "none"):
        assert N.anderson_darling(df.where(F.col("g") == g), F.col("x")).first()["ad"] is None
    assert N.anderson_darling(df.limit(0), F.col("x")).first()["n"] == 0
    assert N.anderson_darling(column(spark, [math.inf, *range(10)]), F.col("x")).first()["ad"] is None
