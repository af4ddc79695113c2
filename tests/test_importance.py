"""Importance by closed forms against columns that are really dealt anew, and tiers against enumeration."""

import itertools

import numpy as np
import pytest

from courtside.operators import importance as I
from courtside.operators.selection import grams


def _table(rng, n=400):
    u, v = rng.normal(size=n), rng.normal(size=n)
    x = np.stack([u + 0.3 * rng.normal(size=n), u + 0.3 * rng.normal(size=n), v + 0.3 * rng.normal(size=n)], axis=1)
    return x, 2 * u - v + 0.5 * rng.normal(size=n) + 3, np.arange(n) % 4


@pytest.fixture(scope="module")
def planted(spark):
    x, y, season = _table(np.random.default_rng(7))
    rows = [(int(s), *map(float, r), float(t)) for s, r, t in zip(season, x, y, strict=True)]
    sums = grams(spark.createDataFrame(rows, "season int, a double, b double, c double, y double"), ["a", "b", "c", "y"], "season")
    return x, y, season, sums


def _really_dealt(x, y, season, use, moved, times=3000):
    rng, out = np.random.default_rng(1), {}
    for s in np.unique(season):
        test = season == s
        design = lambda m: np.column_stack([np.ones(len(m)), m])
        b = np.linalg.lstsq(design(x[~test][:, use]), y[~test], rcond=None)[0]
        base = ((y[test] - design(x[test][:, use]) @ b) ** 2).mean()
        losses = []
        for _ in range(times):
            dealt, order = x[test].copy(), rng.permutation(test.sum())
            dealt[:, moved] = dealt[order][:, moved]
            losses.append(((y[test] - design(dealt[:, use]) @ b) ** 2).mean() - base)
        out[s] = np.mean(losses) / y[test].var()
    return out


def test_permuted_is_the_mean_of_many_dealings(planted):
    x, y, season, sums = planted
    got = {(n, s): v for n, s, v in I.permuted(sums, ["a", "b", "c"])}
    for k, n in enumerate("abc"):
        for s, v in _really_dealt(x, y, season, [0, 1, 2], [k]).items():
            assert got[n, s] == pytest.approx(v, rel=0.03, abs=0.003)


def test_clusters_move_together_and_desubstituted_alone(planted):
    x, y, season, sums = planted
    clusters = {"a": "u", "b": "u", "c": "v"}
    got = {(n, s): v for n, s, v in I.permuted_clusters(sums, ["a", "b", "c"], clusters)}
    for s, v in _really_dealt(x, y, season, [0, 1, 2], [0, 1]).items():
        assert got["u", s] == pytest.approx(v, rel=0.03)
    alone = {(n, s): v for n, s, v in I.desubstituted(sums, ["a", "b", "c"], clusters)}
    for s, v in _really_dealt(x, y, season, [0, 2], [0]).items():
        assert alone["a", s] == pytest.approx(v, rel=0.03)


def test_residualised_equals_residual_columns(planted):
    x, y, season, sums = planted
    r = x.copy()
    for k, others in ((0, [2]), (1, [2]), (2, [0, 1])):
        r[:, k] = x[:, k] - x[:, others] @ np.linalg.lstsq(x[:, others], x[:, k], rcond=None)[0]
    got = {(n, s): v for n, s, v in I.residualised(sums, ["a", "b", "c"], {"a": "u", "b": "u", "c": "v"})}
    for s, v in _really_dealt(r, y, season, [0, 1, 2], [2]).items():
        assert got["c", s] == pytest.approx(v, rel=0.03)


def test_components_equal_components_of_the_rows(planted):
    x, y, season, sums = planted
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    _, _, w = np.linalg.svd(z, full_matrices=False)
    by_feature, parts = I.principal(sums, ["a", "b", "c"], share=0.95)
    k = len({n for n, _, _ in parts})
    pc = z @ w[:k].T
    want = {c: _really_dealt(pc, y, season, list(range(k)), [c]) for c in range(k)}
    for n, s, v in parts:
        assert v == pytest.approx(want[int(n[3:])][s], rel=0.05, abs=0.01)
    for n, s, v in by_feature:
        assert v == pytest.approx(sum(abs(w[c]["abc".index(n)]) * dict((m, q) for m, t, q in parts if t == s)[f"PC_{c}"] for c in range(k)))


def test_equal_columns_each_get_importance_again(spark):
    x, y, season = _table(np.random.default_rng(3))
    rows = [(int(s), float(r[0]), float(r[0]), float(r[2]), float(t)) for s, r, t in zip(season, x, y, strict=True)]
    sums = grams(spark.createDataFrame(rows, "season int, a double, b double, c double, y double"), ["a", "b", "c", "y"], "season")
    clusters = {"a": "u", "b": "u", "c": "v"}
    mean = lambda rows, n: np.mean([v for m, _, v in rows if m == n])
    plain, alone = I.permuted(sums, ["a", "b", "c"]), I.desubstituted(sums, ["a", "b", "c"], clusters)
    assert mean(alone, "a") == pytest.approx(mean(alone, "b"))
    assert mean(plain, "a") < 0.7 * mean(alone, "a")  # a twin stands in for half of it
    assert mean(I.permuted_clusters(sums, ["a", "b", "c"], clusters), "u") == pytest.approx(mean(alone, "a"), rel=1e-6)


def test_constant_features_and_flat_targets(spark):
    df = spark.createDataFrame([(s, 1.0, float(i), 5.0 if s == 2 else float(2 * i)) for s in range(3) for i in range(5)], "season int, a double, b double, y double")
    got = I.permuted(grams(df, ["a", "b", "y"], "season"), ["a", "b"])
    assert {s for _, s, _ in got} == {0, 1}
    assert all(v == pytest.approx(0, abs=1e-9) for n, _, v in got if n == "a")
    assert I.permuted({}, ["a"]) == [] and I.single_scores({}, ["a"]) == []


@pytest.mark.parametrize("values", [[0.5, -0.1, 0.3, 0.2], [1.0, 1.0, -1.0, 2.0, 0.0, -3.0], [-1.0, -2.0, -3.0, -4.0, 5.0], [1.0, 2.0]])
def test_signed_rank_by_enumeration(spark, values):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(values,)], "v array<double>").select(I.signed_rank_p(F.col("v"))).first()[0]
    kept = [v for v in values if v]
    if len(kept) < 4:
        assert got is None
        return
    ranks = [sum(abs(o) < abs(v) for o in kept) + (sum(abs(o) == abs(v) for o in kept) + 1) / 2 for v in kept]
    seen = sum(r for r, v in zip(ranks, kept, strict=True) if v > 0)
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(kept))]
    assert got == pytest.approx(np.mean([s >= seen for s in sums]))


def test_bootstrap_bounds_are_near_those_of_other_drawings(spark):
    from pyspark.sql import functions as F

    values = [float(v) for v in np.random.default_rng(5).normal(1, 1, 12)]
    low, high = spark.createDataFrame([(values,)], "v array<double>").select(I.bootstrap_bounds(F.col("v"))).first()[0]
    means = np.random.default_rng(6).choice(values, size=(20000, 12)).mean(axis=1)
    assert low == pytest.approx(np.percentile(means, 2.5), abs=0.08) and high == pytest.approx(np.percentile(means, 97.5), abs=0.08)


def test_tiers(spark):
    good, bad = [0.3, 0.4, 0.2, 0.5, 0.3], [-0.3, -0.4, 0.1, -0.5, -0.3]
    rows = [("sfi", f, k, v) for f, vs in (("all", good), ("none", bad), ("some", good), ("few", good[:3])) for k, v in enumerate(vs)]
    rows += [("desub", f, k, v) for f, vs in (("all", good), ("none", bad), ("some", bad)) for k, v in enumerate(vs)] + [("desub", "blank", 0, None)]
    got = {r["feature"]: (r["n_methods"], r["n_passed"], r["tier"]) for r in I.feature_tiers(spark.createDataFrame(rows, "method string, feature string, fold int, value double"), draws=200).collect()}
    assert got == {"all": (2, 2, "ACCEPTED"), "none": (2, 0, "REJECTED"), "some": (2, 1, "NEEDS SPECIFICATION"), "few": (1, 0, "REJECTED"), "blank": (0, 0, "UNKNOWN")}
    assert I.feature_tiers(spark.createDataFrame([], "method string, feature string, fold int, value double")).count() == 0
