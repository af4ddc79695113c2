"""Rounds of the line join are written one by one."""

from courtside.llm import line_dedup as L


def test_no_plan_holds_the_joins_of_all_rounds(spark, monkeypatch):
    plans = {}
    write = L.materialize

    def watched(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(L, "materialize", watched)
    base = "the quick brown fox jumps over the lazy dog"
    lines = [base[:20] + c + base[21:] for c in "abcdefgh"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    pairs = L.similar_lines(df, edits=((20, 1),), hot=1)
    first = {(r["a"], r["b"]) for r in pairs.collect()}
    hashes = [r[0] for r in df.selectExpr("xxhash64(text)").collect()]
    assert {tuple(sorted((hashes[0], h))) for h in hashes[1:]} <= first
    assert len(plans["round-pairs"]) > 1
    assert all("Join" not in p for p in plans["line-pairs"])
    # keys of one line go before rows with the hashes of earlier segments are counted
    assert "earlier" not in plans["several-lines"][0] and len(plans["several-rows"]) == 1
