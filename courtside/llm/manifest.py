"""Merkle manifest of a dataset: a content-addressed store of nodes, and proofs by descent from the root.

Rows are leaves. The leaves of a group (a source) ascend by the given order; every ``FAN`` consecutive ones become a node
whose digest is that of its children's digests, until one is left, the group's subroot. Subroots, in the order of their
groups, are leaves of the tree above. What is kept of a node is one record, digest -> children, in a table for each
height. Proofs come from the records alone: requests for all leaves descend from the root by the digits of their ranks
(base ``FAN``), joined with the records by digest. Requests that begin with the same digits are one row, so a level has
as many rows as nodes; each child's request carries the children not selected, and a leaf's path is read backwards.

Shuffled are 64-character digests, never texts. Groups of any size are ranked and built in parallel (``ranks.ranked``);
the driver sees only the largest number of nodes of a level. Requests are never broadcast: those of one node share their
path, so that they are small when compressed, by which Spark would choose a broadcast, but large in the driver's memory.

Defined results: a null value counts as ``-``, a null group is the first one, a null order value comes first. Rows equal
in the order are ordered by digest; repeated rows are leaves of their own. Other columns are carried along, except that
those named g, n, p, digest, subroot, root, path or beginning with ``__`` must be left away before. An empty table has no
rows and no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.ranks import ranked
from courtside.shared import materialize

FAN = 16
#: What stands left and right of a node among its siblings.
_STEP = "array<struct<left: string, right: string>>"


def digest_of(*values: Column) -> Column:
    """SHA-256, in lower-case hex, of each value's length in bytes, a colon and the value; of ``-`` for a null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(tables of nodes by height, from 1 on; (g, digest, height) of each group's top node). nodes: g, p, n, digest."""
    levels, tops = [], [nodes.where("n = 1").select("g", "digest", F.lit(0).alias("height"))]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = nodes.where("n > 1").groupBy("g", F.expr(f"p div {FAN}").alias("p"))
        up = runs.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("p", "digest"))).alias("run"))  # at most FAN of them
        up = up.select("g", "p", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("run.digest").alias("children"))
        nodes = materialize(up.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{name}-nodes")
        levels.append(nodes)
        tops.append(nodes.where("n = 1").select("g", "digest", F.lit(len(levels)).alias("height")))
        most = -(-most // FAN)
    return levels, reduce(DataFrame.unionByName, tops)


def _step(children: Column, digit: Column) -> Column:
    """The children left and right of the one that the digit selects."""
    left = F.slice(children, F.lit(1), digit)
    right = F.slice(children, digit + 2, F.greatest(F.size(children) - digit - 1, F.lit(0)))
    return F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))


def _answers(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """leaves with ``path`` (steps from the root to the leaf) and what else ``tops`` has: g, digest, height, path, ..."""
    told = [c for c in tops.columns if c not in ("g", "digest", "height", "path")]
    asked = None
    for height in range(len(levels), 0, -1):
        new = tops.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("p"), "digest", "path", *told)
        asked = new if asked is None else asked.unionByName(new)
        records = levels[height - 1].groupBy("digest").agg(F.first("children").alias("children"))  # one for each content
        asked = asked.hint("merge").join(records, "digest")
        if height > 1:
            asked = asked.select("g", "p", "children", "path", *told, F.posexplode("children").alias("digit", "digest"))
            asked = asked.select("g", (F.col("p") * FAN + F.col("digit")).alias("p"), "digest", F.concat("path", _step(F.col("children"), F.col("digit"))).alias("path"), *told)
    lone = leaves.where("n = 1").join(tops.where("height = 0").select("g", "path", *told).hint("merge"), "g")
    if asked is None:
        return lone
    asked = asked.select("g", F.col("p").alias("__run"), "children", "path", *told)
    found = leaves.where("n > 1").withColumn("__run", F.expr(f"p div {FAN}")).join(asked.hint("merge"), ["g", "__run"])
    digit = (F.col("p") % FAN).cast("int")
    found = found.withColumn("path", F.concat("path", _step(F.col("children"), digit))).drop("__run", "children")
    return found.unionByName(lone)


def proofs(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves (with a column ``digest``) with subroot, root and ``path``, the siblings' digests from leaf to root.

    path: array of (left, right), each the concatenated digests on that side.
    """
    placed = materialize(ranked(leaves, group, [*order, "digest"]), "leaves")
    levels, tops = _levels(placed.select("g", "p", "n", "digest"), "group")
    tops = materialize(tops, "subroots")
    n_groups = tops.count()
    above = tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("p"), F.lit(n_groups).cast("long").alias("n"), "digest", "height")
    upper, root = _levels(above.drop("height"), "top")
    root = root.select("g", "digest", "height", F.array().cast(_STEP).alias("path"), F.col("digest").alias("root"))
    subroots = _answers(above, upper, root).select(F.col("p").alias("g"), "digest", "height", "path", "root", F.col("digest").alias("subroot"))
    answered = _answers(placed, levels, materialize(subroots, "subroot-paths"))
    return answered.withColumn("path", F.reverse("path")).drop("g", "n", "p")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings'."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings' digests, from leaf to root and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)
