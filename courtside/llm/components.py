"""Connected components of a table of links, by union-find within partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.shared import materialize


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each partition's links as links of a forest: every node with the least of its tree."""
    parent: dict = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    if rows:
        yield pd.DataFrame(rows, columns=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of links (a, b); rows with nulls or a = b don't count.

    Star contraction: all of a node's larger neighbours, then all its smaller ones, are tied to its least neighbour,
    until nothing changes. A hub's neighbours are never gathered: its least comes from an aggregation that combines in
    each task, and goes back by a join.
    """
    kind = links.schema["a"].dataType.simpleString()
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = materialize(links.mapInPandas(_forest, f"a {kind}, b {kind}").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        edges = materialize(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
