"""What near-dedup joins of differences, and what the quality rules shuffle of texts."""

from pyspark.sql import functions as F

from courtside.llm import near_dups as N
from courtside.llm import quality_rules as Q


def test_only_differences_that_two_components_share_are_joined(spark, monkeypatch):
    told = {}
    write = N.materialize

    def watched(df, name):
        told[name] = write(df, name)
        return told[name]

    monkeypatch.setattr(N, "materialize", watched)
    base = list(range(1000, 1100))
    # 1 is the pivot; 2 to 4 differ from it by the same element, 5 and 6 by elements of which they share all but one
    sets = {1: base, **{i: [*base, 1, 10 + i] for i in (2, 3, 4)}, 5: [*base, *range(100, 130)], 6: [*base, *range(101, 131)]}
    component = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
    members = spark.createDataFrame([(1, 100, i, len(s), component[i]) for i, s in sets.items()], "p long, np long, x long, nx long, c long")
    pairs = N._sharing(members, spark.createDataFrame(list(sets.items()), "doc_id long, shingles array<long>"), 85)
    assert [(r.a, r.b) for r in pairs.collect()] == [(5, 6)]
    joined = {r.e for r in told["rare-differences"].collect()}
    assert joined and joined <= set(range(101, 130))


def test_texts_of_labelled_documents_are_not_shuffled(spark, monkeypatch):
    plans = {}
    write = Q.materialize

    def watched(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(Q, "materialize", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good, bad = "a fine text of many words in lines of their own kind . " * 6, "### $$$ " * 60
        docs = spark.createDataFrame([(i, (bad if i % 2 else good) + " ".join(f"w{i}x{k}" for k in range(60)), "x") for i in range(60)], "doc_id long, text string, more string")
        labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
        kept = Q.judge_quality(docs, labels, F.col("quality") == 0, keep=("more",)).where("kept").select("doc_id")
        beside = Q.judge_quality(docs, labels, F.col("quality") == 0).where("kept").select("doc_id")
        assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in beside.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans["text-stats"] and "SortMergeJoin" not in plans["text-stats"]
