"""Correlations of many columns from one reading of a table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.operators import selection as L
from courtside.plans import registry
from courtside.plans import selection as plan


def test_moments_agree_with_single_correlations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[:, 1] += x[:, 0]
    x[:, 2] = 1e7 + x[:, 2] / 100  # far from zero beside its deviation
    rows = [(None if k % 5 == 4 else k % 5, *[None if (k + 3 * c) % 11 == 0 else float(v) for c, v in enumerate(r)], 2.0) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double").repartition(3)
    names = ["a", "b", "c"]
    got = L.moments(df, [*names, "d"], "g")
    assert set(got) == {None, 0, 1, 2, 3}
    want = df.groupBy("g").agg(*[F.corr(p, q).alias(f"{p}{q}") for p, q in (("a", "b"), ("a", "c"), ("b", "c"))]).collect()
    for r in want:
        for p, q in (("a", "b"), ("a", "c"), ("b", "c")):
            assert got[r["g"]].corr(names.index(p), names.index(q)) == pytest.approx(r[f"{p}{q}"], abs=1e-6)
        assert got[r["g"]].corr(0, 3) is None
    whole = sum(list(got.values())[1:], list(got.values())[0])
    assert whole.corr(0, 1) == pytest.approx(df.agg(F.corr("a", "b")).first()[0], abs=1e-9)
    assert np.isfinite(whole.mean).all()
    assert L.moments(df.limit(0), names, "g") == {}


def test_clusters_write_no_copy_of_the_table(spark, monkeypatch):
    def no(*_):
        raise AssertionError("the features were written")

    monkeypatch.setattr(plan, "materialize", no)
    for name in ("m4_feature_clusters", "m19_clustered_importance"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
