"""The Merkle manifest against hashing by hand: nulls, ties, repeated rows, lone leaves, many groups."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from courtside.llm import queries
from courtside.llm.manifest import digest_of, folded, proof_digest, proofs
from courtside.llm.ranks import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(top, siblings of each node level by level as (left, right))."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, members in enumerate(below):
            run, d = runs[k // 16], k % 16
            for i in members:
                paths[i].append(("".join(run[:d]), "".join(run[d + 1 :])))
        below = [sum(below[i : i + 16], []) for i in range(0, len(below), 16)]
        nodes = [h("".join(run)) for run in runs]
    return nodes[0], paths


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[3], []).append(d)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, rows = [], []
    for k in keys:
        groups[k].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        tops.append(climb([leaf(d) for d in groups[k]]))
    root, above = climb([t for t, _ in tops])
    for k, (top, paths), up in zip(keys, tops, above, strict=True):
        for d, path in zip(groups[k], paths, strict=True):
            path = path + up
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            text = d[1] and "".join(c.lower() if c.isascii() else c for c in d[1])
            at = leaf((d[0], text, *d[2:])) if tampered else leaf(d)
            for left, right in path:
                at = h(left + at + right)
            rows.append((d[0], leaf(d), top, root, h("".join(a + b for a, b in path)), at, at == root))
    return sorted(rows, key=repr)


def run(spark, docs, monkeypatch):
    frame = spark.createDataFrame(docs, DOCS).withColumn("leaf", F.lit("clash"))
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    return sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, "").collect()), key=repr)


def test_manifest_against_hashing_by_hand(spark, monkeypatch):
    rnd = random.Random(5)
    docs = [(i, f"Text {i} Ünï {'A' * (i % 7)}", rnd.choice(["en", None]), rnd.choice(["hot", "hot", "hot", "b", "ä", None]), i) for i in range(700)]
    docs += [(900 + i, "x", "en", f"s{i:02}", None) for i in range(40)]  # lone leaves
    docs += [(5, None, None, "hot", None), (5, "", "en", "hot", 0), (None, "Null id", "en", "hot", 7), (None, None, None, None, None)]
    docs += [(7, "Twice", "en", "b", 5)] * 3 + [(1000, "Long " * 50_000, "en", "b", 1)]
    got = run(spark, docs, monkeypatch)
    assert got == brute(docs)
    assert {r[6] for r in got} == {True, False}


def test_one_row_and_none(spark, monkeypatch):
    one = [(10, "ABC", "en", None, 3)]
    got = run(spark, one, monkeypatch)
    assert got == brute(one) and got[0][2] == got[0][1] == got[0][3]
    assert run(spark, [], monkeypatch) == []


def test_any_column_may_be_changed_and_is_noticed(spark):
    frame = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 3}", 2) for i in range(100)], DOCS)
    leaves = frame.select("doc_id", "source", digest_of(F.col("doc_id"), F.col("text")).alias("digest"))
    found = proofs(leaves, "source", ["doc_id"])
    assert found.where(folded(F.col("digest"), F.col("path")) == F.col("root")).count() == 100
    assert found.where(folded(F.sha2("digest", 256), F.col("path")) == F.col("root")).count() == 0
    assert found.select(proof_digest(F.col("path"))).distinct().count() == 100


def test_ranks_of_groups_over_many_tasks(spark):
    rows = [(k % 3 if k % 7 else None, k * 37 % 101) for k in range(2000)] + [(9, 1)] * 500
    frame = spark.createDataFrame(rows, "k int, v int").repartition(9)
    got = ranked(frame, "k", ["v"]).collect()
    keys = sorted({r[0] for r in rows}, key=lambda k: (k is not None, k or 0))
    for g, k in enumerate(keys):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.p)
        assert [r.p for r in mine] == list(range(len(mine))) and {(r.g, r.n) for r in mine} == {(g, len(mine))}
        assert [r.v for r in mine] == sorted(r[1] for r in rows if r[0] == k)


def test_requests_with_their_paths_are_never_broadcast(spark):
    frame = spark.createDataFrame([(i, f"t{i}", "en", "hot" if i < 300 else f"s{i}", 2) for i in range(320)], DOCS)
    found = proofs(frame.select("doc_id", "source", digest_of(F.col("doc_id")).alias("digest")), "source", ["doc_id"])
    assert len(found.collect()) == 320
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_many_groups_are_not_broadcast(spark):
    frame = spark.createDataFrame([(k // 2 if k else None, k) for k in range(24_000)], "k int, v int").repartition(5)
    found = ranked(frame, "k", ["v"])
    got = sorted((r.v, r.g, r.n, r.p) for r in found.collect())
    assert got == [(k, 0 if k == 0 else k // 2 + 1, 1 if k < 2 else 2, k % 2 if k > 1 else 0) for k in range(24_000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
