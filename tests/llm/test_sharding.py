"""Shards: the law of their keys, gapless slots, whole records, hot keys, odd rows."""

import collections
import zlib

from pyspark.sql import functions as F

from courtside.llm import queries
from courtside.llm.sharding import read_shards, shard_of, with_slots, write_shards

DOCS = "doc_id long, text string, shard string, record string"


def shards_of(spark, docs, path, **more):
    frame = spark.createDataFrame(docs, DOCS)
    write_shards(frame, str(path), **more)
    return with_slots(read_shards(spark, str(path), frame.schema)).collect()


def test_records_are_whole_and_slots_gapless(spark, tmp_path):
    docs = [(i, f"text {i} ü", "clash", None) for i in range(3000)] + [(None, None, None, None), (5, "", "x", "y"), (5, "", "x", "y"), (8, "long " * 100_000, "a", "b")]
    got = shards_of(spark, docs, tmp_path / "a", bucket_bytes=4000)
    assert collections.Counter(tuple(r.record) for r in got) == collections.Counter(docs)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.25 * min(map(len, slots.values()))


def test_orders_are_shuffled_and_seeded(spark, tmp_path):
    docs = [(i, "t", "", "") for i in range(4000)]
    spark.createDataFrame(docs, DOCS).repartition(1).sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in"))

    def order(name, seed):
        write_shards(frame, str(tmp_path / name), seed=seed, bucket_bytes=1500)
        return [r.id for r in with_slots(read_shards(spark, str(tmp_path / name), frame.schema)).where("shard = 3").orderBy("slot").select(F.col("record.doc_id").alias("id")).collect()]

    a, b, c = order("a", 1), order("b", 1), order("c", 2)
    assert a == b and sorted(a) != a and a != c
    up = sum(x < y for x, y in zip(a, a[1:], strict=False))
    assert 0.4 < up / len(a) < 0.6


def test_a_hot_key_is_dealt_to_many_buckets(spark, tmp_path):
    got = shards_of(spark, [(7, f"text {i % 3}", "", "") for i in range(2000)] + [(i, "t", "", "") for i in range(1000)], tmp_path / "a", bucket_bytes=1000)
    hot = [r for r in got if r.record.doc_id == 7]
    assert len({r.shard for r in hot}) == 1
    sizes = collections.Counter((r.shard, r.bucket) for r in got)
    assert len(sizes) > 15 and max(sizes.values()) < 250


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (1, 4, 8):
        moved = spark.range(5000).select(shard_of(F.col("id"), n, 20).alias("a"), shard_of(F.col("id"), n + 1, 20).alias("b")).collect()
        assert all(r.b in (r.a, n) for r in moved)
        counts = collections.Counter(r.b for r in moved)
        assert set(counts) == set(range(n + 1)) and max(counts.values()) < 1.3 * min(counts.values())


def test_query_and_empty_table(spark, monkeypatch):
    docs = [(i, None if i % 9 == 0 else f"é {i}") for i in range(200)]
    for rows in (docs, []):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        monkeypatch.setattr(queries, "table", lambda *_, f=frame: f)
        got = queries.op13_sharding(spark, "").collect()
        want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
        assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
