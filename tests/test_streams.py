"""Streams with state: books against a batch twin after restarts, late rows, batches written once."""

import datetime as dt
import random

from pyspark.sql import functions as F

from courtside.streaming import book as B
from courtside.streaming.market import trade_bars
from courtside.streaming.runs import rows_too_late, run_in_slices, with_rocksdb, write_batches

T0 = dt.datetime(2024, 1, 1)


def feed_of(spark, rows):
    return spark.createDataFrame([(t, a, s, T0, kind, levels) for t, a, s, kind, levels in rows], B.FEED)


def play(spark, tmp_path, *slices):
    with with_rocksdb(spark):
        return run_in_slices(spark, [feed_of(spark, s) for s in slices], B.book_changes, f"file://{tmp_path}/book")[0]


def test_book_state_survives_restarts(spark, tmp_path):
    first = [
        (1, 1, 10, "snapshot", [("yes", 40, 5), ("no", 50, 7), ("yes", 9, 0)]),
        (1, 2, 11, "delta", [("yes", 42, 3)]),
        (1, 3, 11, "delta", [("yes", 42, 3)]),
        (2, 1, 5, "delta", [("yes", 10, 1)]),
    ]
    second = [(1, 4, 12, "delta", [("yes", 42, -9)]), (1, 5, 14, "delta", [("yes", 60, 1)]), (2, 2, 6, "snapshot", [("yes", 30, 1), ("no", 80, 2)])]
    third = [(1, 6, 15, "delta", [("yes", 61, 1)]), (2, 3, 7, "delta", [("no", 80, -2)]), (3, 1, 1, "snapshot", [])]
    changes = play(spark, tmp_path, first, second, third)
    tops = {(r.ticker, r.arrival): (r.status, r.bid, r.ask) for r in changes.where("side IS NULL").collect()}
    assert tops == {
        (1, 1): ("snapshot", 40, 50), (1, 2): ("applied", 42, 50), (1, 3): ("duplicate", 42, 50), (2, 1): ("gap", None, None),
        (1, 4): ("applied", 40, 50), (1, 5): ("gap", 40, 50), (2, 2): ("snapshot", None, None),
        (1, 6): ("gap", 40, 50), (2, 3): ("applied", 30, None), (3, 1): ("snapshot", None, None),
    }
    assert {tuple(r) for r in B.book_after(changes).collect()} == {(1, "yes", 40, 5), (1, "no", 50, 7), (2, "yes", 30, 1)}


def test_random_books_equal_their_batch_twin(spark, tmp_path):
    rnd, rows = random.Random(4), []
    for ticker in range(12):
        seq = 0
        for arrival in range(1, 90):
            seq += rnd.choice([0, 1, 1, 1, 1, 1, 1, 1, 1, 2]) if arrival > 1 else 1
            whole = rnd.random() < 0.05 or arrival == 1
            if whole:
                seq += 1
            levels = {(rnd.choice(["yes", "no"]), rnd.randrange(1, 12)): rnd.randrange(1, 9) if whole else rnd.randrange(-6, 7) for _ in range(rnd.randrange(1, 4))}
            rows.append((ticker, arrival, seq, "snapshot" if whole else "delta", [(s, p, n) for (s, p), n in levels.items()]))
    # the numbers of a feed never fall, and a snapshot has a number of its own
    feed = feed_of(spark, rows)
    want = {tuple(r) for r in B.replayed(feed).collect()}
    changes = play(spark, tmp_path, [r for r in rows if r[1] < 30], [r for r in rows if 30 <= r[1] < 31], [r for r in rows if r[1] >= 31])
    assert {tuple(r) for r in B.book_after(changes).collect()} == want and len(want) > 20


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    trade = "event_id long, trade_time timestamp, ticker string, yes_price double, size long"
    row = lambda i, hours, price: (i, T0 + dt.timedelta(hours=hours), "t", price, 1)
    slices = [[row(1, 1, 0.2), row(2, 5, 0.4)], [row(3, 60, 0.5)], [row(4, 3, 0.9), row(5, 58, 0.6)], [row(6, 200, 0.1)]]

    def bars(arriving):
        return trade_bars(arriving.withWatermark("trade_time", "10 hours"), [F.window("trade_time", "1 day").alias("window"), "ticker"])

    got, progress = run_in_slices(spark, [spark.createDataFrame(s, trade) for s in slices], bars, f"file://{tmp_path}/bars")
    rows = sorted((r.window.start.day, r.n, r.open, r.close, r.high) for r in got.collect())
    assert rows == [(1, 2, 0.2, 0.4, 0.4), (3, 2, 0.6, 0.5, 0.6)]
    assert rows_too_late(progress) == 1
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # closed days are gone from the state


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 3).alias("kind")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, kind long").parquet(f"{tmp_path}/in")
    write_batches(stream(), f"{tmp_path}/out", "kind")
    for commit in (tmp_path / "out-state" / "commits").iterdir():
        if commit.name.strip(".").startswith("0"):
            commit.unlink()  # as after a crash between writing and committing
    write_batches(stream(), f"{tmp_path}/out", "kind")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
