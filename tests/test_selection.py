"""Selection from sums of products against reading the rows; the t fit against a grid and a numeric integral."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.operators import selection as L

RNG = np.random.default_rng(7)
N = 600
X = RNG.normal(size=(N, 4))
SEASON = RNG.integers(0, 4, N)
Y = 2 * X[:, 0] - X[:, 2] + 0.3 * RNG.normal(size=N)
NAMES = ["a", "b", "c", "d", "y"]


def frame(spark):
    rows = [(int(s), *map(float, x), float(y)) for s, x, y in zip(SEASON, X, Y, strict=True)] + [(1, None, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "season int, a double, b double, c double, d double, y double")


def by_rows(use):
    squares = 0.0
    for s in range(4):
        a = np.c_[np.ones(N), X[:, use]]
        b = np.linalg.lstsq(a[SEASON != s], Y[SEASON != s], rcond=None)[0]
        squares += ((a[SEASON == s] @ b - Y[SEASON == s]) ** 2).sum()
    return math.sqrt(squares / N)


def test_forward_selection_equals_refitting_on_the_rows(spark):
    sums = L.grams(frame(spark), NAMES, "season")
    log = L.forward_selection(sums, NAMES, ["b"], ["c", "d", "a"], "y", gain=0.01, patience=2)
    assert [k for *_, k in log] == [True, True, False, True]
    for (_, _, error, _), use in zip(log, ([1], [1, 2], [1, 2, 3], [1, 2, 0]), strict=True):
        assert error == pytest.approx(by_rows(use), rel=1e-6)
    assert len(L.forward_selection(sums, NAMES, ["a", "c"], ["b", "d"], "y", gain=0.01, patience=1)) == 2


def test_diverse_models_are_different_ones(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(800):
        y, e, g = rnd.gauss(0, 1), rnd.gauss(0, 0.3), rnd.gauss(0, 0.3)
        rows.append((y, y + e, y + e + rnd.gauss(0, 0.001), y + g, y + rnd.gauss(0, 9)))
    got = L.diverse_models(spark.createDataFrame(rows, "y double, a double, twin double, other double, bad double"), ["a", "twin", "other", "bad"], "y", max_corr=0.98, max_ratio=1.3)
    names = [m for _, m, _, _ in got]
    assert len(names) == 2 and "other" in names and "bad" not in names and names[0] != names[1]
    assert L.diverse_models(spark.createDataFrame([], "y double, a double"), ["a"], "y") == []


def test_student_fit_is_no_worse_than_a_grid(spark):
    nu, scale = 4.0, 1.7
    r = scale * RNG.standard_t(nu, 4000)
    got_nu, got_scale, likelihood = L.student_fit(spark.createDataFrame([(float(v),) for v in r], "r double"), "r")

    def ll(n, s):
        return len(r) * (math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(math.pi * n * s * s)) - (n + 1) / 2 * np.log1p(r * r / (n * s * s)).sum()

    best = max(ll(n, s) for n in np.arange(2, 9, 0.1) for s in np.arange(1.4, 2.1, 0.02))
    assert likelihood == pytest.approx(ll(got_nu, got_scale), abs=0.1) and likelihood > best - 0.05
    assert got_nu == pytest.approx(nu, rel=0.25) and got_scale == pytest.approx(scale, rel=0.08)
    assert math.isnan(L.student_fit(spark.createDataFrame([], "r double"), "r")[0])


@pytest.mark.parametrize("nu", [0.7, 1.0, 3.5, 40.0])
def test_exceedance_of_any_degrees(spark, nu):
    points = [-8.0, -1.5, -0.01, 0.0, 0.3, 1.0, 2.5, 12.0]
    got = [r.p for r in spark.createDataFrame([(t,) for t in points], "t double").select(L.student_above(F.col("t"), nu).alias("p")).collect()]
    u = (np.arange(400_000) + 0.5) / 400_000 * (math.pi / 2)  # t = tan(u): a finite range
    for t, p in zip(points, got, strict=True):
        angle = np.arctan(abs(t)) + (math.pi / 2 - np.arctan(abs(t))) * (u / (math.pi / 2))
        x = np.tan(angle)
        density = np.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + x * x / nu) ** (-(nu + 1) / 2)
        above = (density * (1 + x * x)).mean() * (math.pi / 2 - np.arctan(abs(t)))
        assert p == pytest.approx(above if t >= 0 else 1 - above, abs=2e-4)


def test_planted_clusters_are_found(spark):
    base = RNG.normal(size=(500, 3))
    cols = {f"{'uvw'[s]}{k}": base[:, s] + 0.25 * RNG.normal(size=500) for s, size in enumerate([5, 3, 2]) for k in range(size)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.stack(list(cols.values()), axis=1)], ", ".join(f"{c} double" for c in cols))
    assert L.cluster_features(df, list(cols), seeds=4) == {c: f"{c[0]}0" for c in cols}
    assert L.cluster_features(df, ["u0", "v0"]) == {"u0": "u0", "v0": "u0"}


def test_silhouettes_by_hand():
    got = L.silhouettes(np.array([[0.0], [1.0], [10.0]]), np.array([0, 0, 1]))
    assert got.tolist() == pytest.approx([0.9, 8 / 9, 0.0])
