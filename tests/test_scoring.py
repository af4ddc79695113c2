"""Ensembles against numpy on the same rows; scores before and after the table is written."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.operators import scoring as M
from courtside.shared import fresh_path

RNG = np.random.default_rng(11)
N = 900
X = RNG.normal(size=(N, 3)) * [1, 5, 0.2] + [3, -40, 7]
Y = 2 * X[:, 0] - 0.3 * X[:, 1] + X[:, 2] + RNG.normal(size=N)
SEASON = RNG.integers(0, 3, N)
X[RNG.random((N, 3)) < 0.1] = np.nan
SPECS = [M.Spec("all", ("a", "b", "c"), True, 0.5), M.Spec("two", ("b", "a"), False, 0.3), M.Spec("one", ("c",), True, 0.2), M.Spec("b", ("b",), False, 0.4)]


def frame(spark, target=Y):
    rows = []
    for k, (x, s, y) in enumerate(zip(X, SEASON, target, strict=True)):
        gap = (None, math.nan, 1e6, -1e6)[k % 4]  # all of these are missing values
        rows.append((k, int(s), float(y), *[gap if math.isnan(v) else float(v) for v in x]))
    return spark.createDataFrame(rows, "id int, season int, y double, a double, b double, c double")


def by_hand(task="regression", target=Y):
    """(mean, std, number of models, missing, low weight) of each row."""
    medians = np.nanmedian(X, axis=0)
    full = np.where(np.isnan(X), medians, X)
    preds, weights = [], []
    for s in SPECS:
        at = ["abc".index(f) for f in s.features]
        a = np.c_[np.ones(N), full[:, at]]
        preds.append(a @ np.linalg.lstsq(a, target, rcond=None)[0])
        share = np.isnan(X[:, at]).mean(axis=1)
        weights.append(s.weight * np.where(s.scaled & (share > 0.05), np.maximum(0.1, 1 - 3 * share), 1.0))
    out = []
    for p, w, x in zip(np.array(preds).T, np.array(weights).T, X, strict=True):
        m = np.median(p)
        mad = np.median(abs(p - m))
        keep = abs(p - m) <= 3 * mad
        if mad == 0 or keep.sum() < 2:
            keep[:] = True
        missing = sum(np.isnan(x["abc".index(f)]) for s in SPECS for f in s.features) / 7
        out.append((p[keep] @ w[keep] / w[keep].sum(), p[keep].std(), keep.sum(), missing))
    return out


def test_scores_equal_numpy_and_survive_the_table(spark):
    rows = frame(spark)
    path = fresh_path(spark, "ensembles")
    M.fit_ensemble(rows, "y", "season", SPECS).write.parquet(path)
    got = M.score(rows, M.load_ensembles(spark, path)["y"]).orderBy("id").collect()
    want = by_hand()
    assert len(got) == N and len({r["score"]["n_models"] for r in got}) > 1
    for r, (mean, std, n, missing) in zip(got, want, strict=True):
        s = r["score"]
        assert (s["mean"], s["std"], s["missing"]) == pytest.approx((mean, std, missing), rel=1e-7, abs=1e-9)
        assert s["n_models"] == n
    assert any(r["score"]["low_weight"] for r in got) and not all(r["score"]["low_weight"] for r in got)


def test_scores_do_not_depend_on_the_batch(spark):
    rows = frame(spark)
    ensemble = M.fit_ensemble(rows, "y", "season", SPECS).first()
    whole = {r["id"]: r["score"] for r in M.score(rows, ensemble).collect()}
    part = M.score(rows.where("id < 5").withColumn("score", F.lit("clash")).withColumn("__x", F.lit(1)), ensemble).collect()
    assert {r["id"]: r["score"] for r in part} == {k: whole[k] for k in range(5)}
    assert M.score(rows.limit(0), ensemble).count() == 0
    with pytest.raises(ValueError, match="lacks c"):
        M.score(rows.drop("c"), ensemble)


def test_open_weights_are_inverse_held_out_errors(spark):
    specs = [M.Spec("good", ("a", "b", "c")), M.Spec("poor", ("c",))]
    models = M.fit_ensemble(frame(spark), "y", "season", specs).first()["models"]
    full = np.where(np.isnan(X), np.nanmedian(X, axis=0), X)
    for m, use in zip(models, ([0, 1, 2], [2]), strict=True):
        a, squares = np.c_[np.ones(N), full[:, use]], 0.0
        for s in range(3):
            b = np.linalg.lstsq(a[SEASON != s], Y[SEASON != s], rcond=None)[0]
            squares += ((a[SEASON == s] @ b - Y[SEASON == s]) ** 2).sum()
        assert m["weight"] == pytest.approx(N / squares, rel=1e-5)


def test_probabilities_are_clipped_and_calibrated(spark):
    p = 1 / (1 + np.exp(-(Y - Y.mean()) / 2))
    label = (RNG.random(N) < p).astype(float)
    rows = frame(spark, label)
    ensemble = M.fit_ensemble(rows, "y", "season", SPECS[:2], task="classification", calibrated=True).first()
    knots = ensemble["calibration"]
    assert 2 <= len(knots) <= 1001 and all(a["x"] <= b["x"] and a["y"] <= b["y"] for a, b in zip(knots, knots[1:], strict=False))
    got = [r["score"]["mean"] for r in M.score(rows, ensemble).orderBy("id").collect()]
    raw = [r["score"]["mean"] for r in M.score(rows, ensemble.__class__(**{**ensemble.asDict(), "calibration": None})).orderBy("id").collect()]
    assert min(raw) >= 0.01 and max(raw) <= 0.99
    assert got == pytest.approx(np.interp(raw, [k["x"] for k in knots], [k["y"] for k in knots]), abs=1e-9)
    assert np.mean((np.array(got) - label) ** 2) <= np.mean((np.array(raw) - label) ** 2) + 1e-4


def test_constant_features_and_empty_ones(spark):
    rows = frame(spark).withColumn("c", F.lit(4.0))
    ensemble = M.fit_ensemble(rows, "y", "season", [M.Spec("m", ("a", "c"), True)]).first()
    assert [t["coefficient"] for t in ensemble["models"][0]["terms"] if t["feature"] == "c"] == [0.0]
    assert M.score(rows, ensemble).where("score.mean IS NULL OR isnan(score.mean)").count() == 0
    with pytest.raises(ValueError, match="no training values for c"):
        M.fit_ensemble(rows.withColumn("c", F.lit(None).cast("double")), "y", "season", [M.Spec("m", ("c",))])


def test_total_of_two_halves(spark):
    r = RNG.normal(size=(300, 2)) @ [[1, 0.4], [0, 1]]
    s = abs(RNG.normal(size=(300, 2)))
    got = M.synthetic_total(spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(r, s, strict=True)], "r1 double, r2 double, s1 double, s2 double"), "r1", "r2", "s1", "s2")
    cov = np.cov(r.T)
    assert (got["cov"], got["variance"], got["rho"]) == pytest.approx((cov[0, 1], cov.sum(), np.corrcoef(s.T)[0, 1]))
