"""Order books kept in the state of a stream.

A feed has one message a row: ticker, seq, ts, kind ('snapshot' or 'delta'), and levels, an array of (side, price, size).
A snapshot's levels replace the book, a delta's sizes are added to their levels; a level at or below zero is gone. Deltas
must follow each other by one: an earlier number is a duplicate and changes nothing, and after a gap the book waits for
the next snapshot. Without a book deltas are gaps as well.

Messages of a ticker are taken by arrival (``arrival``) within a micro-batch, and batches in their order. State is one value
for each ticker, its last number and its levels, so a ticker's memory is its book (two prices for each cent at most), whatever
its history; it is read once and written once in a micro-batch, as each call to the state store costs more than a message.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FEED = "ticker long, arrival long, seq long, ts timestamp, kind string, levels array<struct<side: string, price: int, size: long>>"
#: One row with side null for each message (what it did, and the top of the book after it), one for each level changed.
CHANGES = "ticker long, arrival long, seq long, ts timestamp, status string, side string, price int, size long, bid int, ask int"


def top_of(levels: dict[tuple[str, int], int]) -> tuple[int | None, int | None]:
    """(bid, ask) in cents: the best yes price, and 100 less the best no price; neither if the book is crossed."""
    bid = max((p for s, p in levels if s == "yes"), default=None)
    no = max((p for s, p in levels if s == "no"), default=None)
    ask = None if no is None else 100 - no
    return (None, None) if bid is not None and ask is not None and bid >= ask else (bid, ask)


class Books(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getValueState("book", "seq long, sides array<string>, prices array<int>, sizes array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (ticker,) = key
        frames = list(rows)
        messages = (pd.concat(frames) if len(frames) > 1 else frames[0]).sort_values(["arrival", "seq"], kind="stable")
        known = self.book.get()
        last, sides, prices, sizes = known if known is not None else (None, [], [], [])
        before = dict(zip(zip(sides, prices, strict=True), sizes, strict=True))
        start, book = last, dict(before)
        out = []
        for m in messages.itertuples(index=False):
            changed: dict[tuple[str, int], int] = {}
            if m.kind == "snapshot":
                status, last = "snapshot", m.seq
                changed = dict.fromkeys(book, 0)
                book = {}
                for side, price, size in zip(m.sides, m.prices.tolist(), m.sizes.tolist(), strict=True):
                    if size > 0:
                        book[side, price] = changed[side, price] = size
            elif last is not None and m.seq <= last:
                status = "duplicate"
            elif last is None or m.seq != last + 1:
                status = "gap"
            else:
                status, last = "applied", m.seq
                for side, price, moved in zip(m.sides, m.prices.tolist(), m.sizes.tolist(), strict=True):
                    at = (side, price)
                    size = max(0, book.pop(at, 0) + moved)
                    changed[at] = size
                    if size:
                        book[at] = size
            bid, ask = top_of(book)
            out.append((ticker, m.arrival, m.seq, m.ts, status, None, None, None, bid, ask))
            out += [(ticker, m.arrival, m.seq, m.ts, status, s, p, n, None, None) for (s, p), n in changed.items()]
        if last is not None and (last != start or book != before):
            self.book.update((int(last), [s for s, _ in book], [p for _, p in book], list(book.values())))
        columns = dict(zip([c.split()[0] for c in CHANGES.split(", ")], zip(*out, strict=True), strict=True))
        small = {"price": "Int32", "size": "Int64", "bid": "Int32", "ask": "Int32"}
        yield pd.DataFrame({c: pd.array(v, dtype=small[c]) if c in small else list(v) for c, v in columns.items()})

    def close(self) -> None:
        pass


def book_changes(feed: DataFrame) -> DataFrame:
    """The changes of a streamed feed, as they come. Needs the RocksDB state store (``with_rocksdb``)."""
    part = lambda name: F.transform("levels", lambda x: x[name]).alias(f"{name}s")
    # plain arrays and numbers, which cost a call per ticker far less to convert than structs and time zones
    flat = feed.select("ticker", "arrival", "seq", F.unix_micros("ts").alias("ts"), "kind", part("side"), part("price"), part("size"))
    told = flat.groupBy("ticker").transformWithStateInPandas(Books(), CHANGES.replace("ts timestamp", "ts long"), "append", "none")
    return told.withColumn("ts", F.timestamp_micros("ts"))


def book_after(changes: DataFrame) -> DataFrame:
    """ticker, side, price, size: the levels that are left after all changes."""
    last = changes.where("side IS NOT NULL").groupBy("ticker", "side", "price").agg(F.max_by("size", "arrival").alias("size"))
    return last.where("size > 0")


def replayed(feed: DataFrame) -> DataFrame:
    """``book_after`` of a whole feed as a batch, without state: the twin that the stream must agree with.

    Of a ticker only the messages from its last snapshot on count, of those the unbroken run of numbers, each once.
    """
    by_arrival = Window.partitionBy("ticker").orderBy("arrival", "seq")
    f = feed.withColumn("epoch", F.sum((F.col("kind") == "snapshot").cast("int")).over(by_arrival))
    in_epoch = Window.partitionBy("ticker", "epoch")
    f = f.where("epoch > 0").withColumns(
        {"start": F.min(F.when(F.col("kind") == "snapshot", F.col("seq"))).over(in_epoch), "place": F.dense_rank().over(in_epoch.orderBy("seq")) - 1, "copy": F.row_number().over(Window.partitionBy("ticker", "epoch", "seq").orderBy("arrival"))}
    )
    f = f.withColumn("newest", F.max("epoch").over(Window.partitionBy("ticker"))).where("epoch = newest AND copy = 1 AND seq - start = place")
    x = f.select("ticker", "seq", F.explode("levels").alias("x")).select("ticker", "seq", "x.*")
    w = Window.partitionBy("ticker", "side", "price").orderBy("seq")
    x = x.withColumn("run", F.sum("size").over(w))
    x = x.withColumns({"left": F.col("run") - F.least(F.lit(0), F.min("run").over(w)), "nth": F.row_number().over(Window.partitionBy("ticker", "side", "price").orderBy(F.desc("seq")))})
    return x.where("nth = 1 AND left > 0").select("ticker", "side", "price", F.col("left").alias("size"))
