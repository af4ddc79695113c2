"""Logistic fits against the gradient at the solution, and the three tests on planted features."""

import math

import numpy as np
import pytest

from courtside.operators import qualification as Q
from courtside.operators.importance import covariances
from courtside.operators.selection import grams


def _planted(n=1500, seed=4):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    bent = rng.normal(size=n)
    chance = lambda eta: (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    return a, b, bent, chance(1.2 * a), chance(1.5 * bent * bent - 1.5), np.arange(n) % 5


@pytest.fixture(scope="module")
def table(spark):
    a, b, bent, y, curved, s = _planted()
    rows = [(int(t), int(v), int(c), float(i), float(i) + 0.01 * float(j), float(j), float(k)) for t, v, c, i, j, k in zip(s, y, curved, a, b, bent, strict=True)]
    return spark.createDataFrame(rows, "season int, label int, curved int, a double, near double, b double, bent double").repartition(4).persist()


def test_gradient_is_zero_at_the_solution(table):
    rows = table.toPandas()
    fits = Q.fit_logits(table, "label", "season", [Q.Design("all", ("a", "b"), (0.1, 0.0), (2.0, 1.0)), Q.Design("no 3", ("a", "b"), (0.0, 0.0), (1.0, 1.0), 3)])
    for name, mean, sd, part in (("all", (0.1, 0.0), (2.0, 1.0), rows), ("no 3", (0.0, 0.0), (1.0, 1.0), rows[rows.season != 3])):
        fit = fits[name]
        x = np.column_stack([np.ones(len(part)), (part[["a", "b"]].to_numpy() - mean) / sd])
        p = 1 / (1 + np.exp(-x @ np.array(fit.coefficients)))
        assert fit.converged
        assert np.abs(x.T @ (part.label - p)).max() < 1e-6
        assert fit.errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x))), rel=1e-6)


def test_separated_classes_and_no_rows_do_not_converge(spark):
    df = spark.createDataFrame([(0, int(i > 4), float(i), None) for i in range(10)], "season int, label int, x double, empty double")
    fits = Q.fit_logits(df, "label", "season", [Q.Design("x", ("x",), (0.0,), (1.0,)), Q.Design("empty", ("empty",), (0.0,), (1.0,))])
    assert not fits["x"].converged and not fits["empty"].converged
    assert all(math.isnan(e) for e in fits["empty"].errors)


def test_the_three_tests(table):
    got = {r["feature"]: r for r in Q.qualify(table, ["a", "near", "b", "bent"], "label", "season").collect()}
    assert sum(got[f]["passes_vif"] for f in ("a", "near")) == 1
    signal = next(f for f in ("a", "near") if got[f]["passes_vif"])
    assert got[signal]["passes_linearity"] and got[signal]["passes_stability"] and got[signal]["qualifies"] and got[signal]["sign_consistency"] == 1 and got[signal]["folds"] == 5
    curved = {r["feature"]: r for r in Q.qualify(table, ["a", "bent"], "curved", "season").collect()}
    assert not curved["bent"]["passes_linearity"] and not curved["bent"]["qualifies"]
    gone = got["near" if signal == "a" else "a"]
    assert gone["vif"] is None and not gone["qualifies"]


def test_a_sign_that_turns_is_not_stable(spark):
    rng = np.random.default_rng(9)
    rows = []
    for season in range(4):
        x = rng.normal(size=300)
        y = rng.random(300) < 1 / (1 + np.exp(-(1 if season < 2 else -1) * x))
        rows += [(season, int(v), float(u)) for u, v in zip(x, y, strict=True)]
    got = Q.qualify(spark.createDataFrame(rows, "season int, label int, x double"), ["x"], "label", "season").first()
    assert got["sign_consistency"] == 0.5 and not got["passes_stability"] and not got["qualifies"]


def test_nulls_are_left_out_and_few_rows_do_not_qualify(spark, table):
    extra = spark.createDataFrame([(1, None, 0, 9.0, 9.0, 9.0, 9.0), (None, 1, 0, 9.0, 9.0, 9.0, 9.0), (1, 1, 0, None, 9.0, 9.0, 9.0)], table.schema)
    names = ["a", "b", "bent"]
    same = lambda df: sorted(map(str, Q.qualify(df, names, "label", "season").select("feature", "folds", "qualifies").collect()))
    assert same(table.unionByName(extra)) == same(table)
    none = Q.qualify(table.limit(50), names, "label", "season").collect()
    assert [r["feature"] for r in none] == names and not any(r["qualifies"] for r in none)
    assert not any(r["qualifies"] for r in Q.qualify(table.limit(0), names, "label", "season").collect())


def test_inflation_by_regression_on_the_others(table):
    rows = table.toPandas()
    sums = grams(table, ["a", "b", "bent"], "season")
    got = Q.variance_inflation(covariances(sum(sums.values()))[1:, 1:])
    for k, (f, others) in enumerate((("a", ["b", "bent"]), ("b", ["a", "bent"]), ("bent", ["a", "b"]))):
        x = np.column_stack([np.ones(len(rows)), rows[others]])
        residual = rows[f] - x @ np.linalg.lstsq(x, rows[f], rcond=None)[0]
        assert got[k] == pytest.approx(rows[f].var(ddof=0) / (residual**2).mean(), rel=1e-6)
    assert np.isinf(Q.variance_inflation(np.array([[1.0, 1.0], [1.0, 1.0]]))).all()
    assert Q.thin_out(np.diag([1.0, 0.0, 2.0]), ["a", "flat", "b"])[0] == ["a", "b"]
    assert Q.thin_out(np.array([[1.0, 1.0, 0], [1.0, 1.0, 0], [0, 0, 1.0]]), ["a", "twin", "b"])[0] == ["twin", "b"]


def test_folds_begin_at_the_fit_of_all_seasons(spark, table, monkeypatch):
    rounds = []
    fit = Q.fit_logits

    def watched(*args, **kwargs):
        got = fit(*args, **kwargs)
        rounds.append(max(f.rounds for f in got.values()))
        return got

    monkeypatch.setattr(Q, "fit_logits", watched)
    sums = grams(table, ["a", "b"], "season")
    got = Q.coefficient_stability(table, ["a", "b"], "label", "season", sums)
    assert len(rounds) == 2 and rounds[1] < rounds[0]  # the folds of all features took fewer rounds than one fit from zeros
    rows = table.toPandas()
    for s, (name, b) in enumerate((n, got[n][s]) for n in ("a", "b") for s in range(5)):
        part = rows[rows.season != s % 5]
        design = Q.Design("x", (name,), (part[name].mean(),), (part[name].std(ddof=0) + 1e-10,), s % 5)
        assert b == pytest.approx(fit(table, "label", "season", [design])["x"].coefficients[1], abs=1e-9)


@pytest.mark.parametrize("seasons", [["1996", "1997"], [None, "1997"]])
def test_seasons_may_be_texts(spark, seasons):
    rng = np.random.default_rng(2)
    rows = [(seasons[i % 2], int(rng.random() < 0.5), float(x)) for i, x in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "season string, label int, x double")
    got = Q.fit_logits(df, "label", "season", [Q.Design("no", ("x",), (0.0,), (1.0,), "1996"), Q.Design("all", ("x",), (0.0,), (1.0,))])
    only = Q.fit_logits(df.where("season = '1997'"), "label", "season", [Q.Design("x", ("x",), (0.0,), (1.0,))])["x"]
    assert got["no"].coefficients == pytest.approx(only.coefficients)
    assert (got["all"].coefficients == pytest.approx(only.coefficients)) == (seasons[0] is None)
