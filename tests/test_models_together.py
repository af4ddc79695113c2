"""Models of single features are fitted together, not one by one."""

from courtside.plans import models, registry


def test_no_fit_for_each_model(spark, monkeypatch):
    def no(*_, **__):
        raise AssertionError("a model was fitted alone")

    want = {r["feature"]: r for r in registry.QUERIES["m8_single_feature_scores"](spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(models, "LogisticRegression", no)
    got = {r["feature"]: r for r in registry.QUERIES["m8_single_feature_scores"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and sorted(got) == ["pred_a", "pred_b", "pred_c", "prob"]
    assert all(0.4 < r["accuracy"] < 0.6 for r in got.values())
