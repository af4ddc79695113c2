"""Quantiles against Spark's own percentile: heavy tails, ties, infinities, NaN, nulls, several columns at once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from courtside.operators.quantiles import cumulative_counts, exact_quantiles, exact_quantiles_of

PROBS = [0.0, 0.05, 1 / 3, 0.5, 0.75, 0.999, 1.0]
_RND = random.Random(3)
COLUMNS = {
    "even": [float(k) for k in range(500)],
    "ties": [_RND.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(500)],
    "sizes": [10.0 ** _RND.uniform(-300, 300) * _RND.choice([-1, 1]) for _ in range(500)],
    "ends": [-1.7e308, 1.7e308, *[float(k) for k in range(498)]],
    "one": [3.0] * 500,
    "nulls": [None] * 400 + [_RND.gauss(0, 1) for _ in range(100)],
    "close": [1.0 + k * 2.0**-52 for k in range(500)],
}


def same(a, b):
    return (a is None and b is None) or (math.isnan(a) and math.isnan(b)) or a == b or a == pytest.approx(b, rel=1e-12)


def test_all_columns_at_once_as_percentile_gives_them(spark):
    frame = spark.createDataFrame(list(zip(*COLUMNS.values(), strict=True)), ", ".join(f"{c} double" for c in COLUMNS))
    got = exact_quantiles_of(frame, {c: F.col(c) for c in COLUMNS}, PROBS, buckets=16)
    want = frame.agg(*[F.percentile(c, F.array(*map(F.lit, PROBS))).alias(c) for c in COLUMNS]).first()
    for c in COLUMNS:
        assert all(map(same, got[c], want[c])), c


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, math.inf], [-math.inf, 1.0, math.inf, math.inf], [math.nan, 1.0, 2.0], [math.inf, math.inf], [math.nan], [-math.inf, math.nan]])
def test_infinities_and_nan_end(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(frame, F.col("x"), [0.0, 0.5, 1.0])
    n = len(values)
    order = sorted(values, key=lambda v: (math.isnan(v), v))
    for p, v in zip([0.0, 0.5, 1.0], got, strict=True):
        a = p * (n - 1)
        x, y = order[int(a)], order[min(int(a) + 1, n - 1)]
        assert same(v, x if a == int(a) or x == y else (x + y) / 2)


def test_no_values(spark):
    frame = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(frame, F.col("x"), [0.5]) == [None]
    assert exact_quantiles(frame.where("false"), F.col("x"), [0.5, 1.0]) == [None, None]


def test_cumulative_counts(spark):
    values = [_RND.randrange(50) / 7 for _ in range(2000)] + [None, math.nan]
    got = sorted(tuple(r) for r in cumulative_counts(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v")).collect())
    real = [v for v in values if v is not None and not math.isnan(v)]
    assert got == [(v, real.count(v), sum(w < v for w in real)) for v in sorted(set(real))]
