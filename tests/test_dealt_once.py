"""All features are dealt anew by one join."""

from courtside.plans import registry


def test_one_join_deals_all_features(spark):
    got = registry.QUERIES["m7_permutation_importance"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("Join") == 1
    assert sorted(r["feature"] for r in got.collect()) == ["pred_a", "pred_b", "pred_c", "prob"]
