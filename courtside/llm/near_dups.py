"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

A document's set is that of its word shingles. SuperMinHash gives each element a random value in [j, j + 1) for step j,
and a slot from a random permutation of the slots, so that one element's ranks are correlated and never meet in one
slot. Steps are taken for all elements of a batch at once; as later steps only give larger values, a document stops as
soon as all its slots are filled, after one or two steps for long texts.

Equal sets are one class from here on, represented by their least id. Bands of the representatives' signatures make
buckets. A small bucket gives all its pairs. In a large one all members are compared with its most central one (whose
buckets are the fullest), so that a group of near copies costs its size and not its square. Those that it isn't linked
with get a central member of their own to be compared with, again and again while that links an eighth of them. Members
that this leaves in unlike components are compared if they share enough of what tells them from the first pivot
(``_sharing``), which loses no link. Every pair is verified on full sets, in which 64-bit hashes stand for shingles: two
of the n shingles of a pair of texts share one with probability n * n / 2**65, 3e-8 for a million. Components by
``components``.

With 6 rows in 24 bands a pair at similarity 0.85 shares no bucket with probability 1e-5, at 0.9 with 2e-8.

Defined results: a null, empty or blank text has an empty set and is linked with nothing. Rows that share an id are one
document with several texts, and each row is returned. A null id is linked with nothing, its component is null and it
is kept. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.components import components
from courtside.llm.words import mix, shingle_hashes, text_bytes, text_slices, word_hashes
from courtside.shared import materialize

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def super_minhash(elements: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """Signatures, one row for each set; set i is elements[first[i] : first[i + 1]]. An empty set's row is all ones."""
    n = len(first) - 1
    out = np.full((n, slots), _FULL, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    order: np.ndarray | None = None  # the permutation of each element that is still needed
    for j in range(slots):
        if not len(elements):
            break
        seed = mix(elements ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = j + (mix(seed) % np.uint64(slots - j)).astype(np.int64)
        rows = np.arange(len(elements))
        slot = pick if order is None else order[rows, pick]
        np.minimum.at(out.reshape(-1), owner * slots + slot, (seed >> np.uint64(9)) | np.uint64(j << 55))
        stay = ~(out != _FULL).all(axis=1)[owner]
        if not stay.any():
            break
        if order is None:
            order = np.broadcast_to(np.arange(slots, dtype=np.int16), (len(elements), slots))[stay].copy()
        else:
            order = order[stay]
        elements, owner, pick = elements[stay], owner[stay], pick[stay]
        order[np.arange(len(pick)), pick] = order[:, j]
    return out


def distinct_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, flat, with the index of each text's first."""
    words, first = word_hashes(*text_bytes(column))
    shingles, at = shingle_hashes(words, first, size)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.r_[True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])] if len(shingles) else np.zeros(0, bool)
    return shingles[new], np.searchsorted(owner[new], np.arange(len(at)))


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (a 128-bit hash of the set), bands array<long>."""
    got = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in text_slices(whole.column(1), 1 << 19):
                elements, first = distinct_sets(whole.column(1).slice(a, b - a), size)
                n = np.diff(first)
                sums = [np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)]
                for out, salt in zip(sums, (1, 2), strict=True):
                    total = np.r_[np.uint64(0), np.cumsum(mix(elements + np.uint64(salt * 0x632BE59BD9B4E019)), dtype=np.uint64)]
                    out[:] = total[first[1:]] - total[first[:-1]]
                slots = super_minhash(elements, first, rows * bands).reshape(b - a, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (b - a, bands)).copy()
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, :, r])
                first_band = np.where(n > 0, bands, 0)
                flat = key[n > 0].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), *[pa.array(s.astype(np.int64)) for s in sums], _lists(flat, np.r_[0, np.cumsum(first_band)])],
                    ["doc_id", "n_shingles", "s1", "s2", "bands"],
                )

    return got.mapInArrow(run, f"doc_id {got.schema['doc_id'].dataType.simpleString()}, n_shingles long, s1 long, s2 long, bands array<long>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, shingles array<long>."""
    got = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in text_slices(whole.column(1)):
                elements, first = distinct_sets(whole.column(1).slice(a, b - a), size)
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a), _lists(elements, first)], ["doc_id", "shingles"])

    return got.mapInArrow(run, f"doc_id {got.schema['doc_id'].dataType.simpleString()}, shingles array<long>")


def _with_set(rows: DataFrame, key: str, other: str, sets: DataFrame, out: str, parts: int = 2000) -> DataFrame:
    """rows with the set of ``key`` as ``out``.

    A key that more than one of ``parts`` rows has (there are fewer than ``parts`` of them, so they can be broadcast) is
    dealt over several tasks by ``other``, and its set goes to each.
    """
    total = rows.count()
    hot = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__c")).where(F.col("__c") * parts > total).where("__c > 64")
    hot = materialize(hot.select("__key", F.ceil(F.col("__c") * parts / max(1, total)).cast("int").alias("__parts")), "hot-keys")
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), "__parts")).cast("int"))
    right = sets.join(F.broadcast(hot), F.col("doc_id") == F.col("__key"), "left").select(F.col("doc_id").alias(key), F.col("shingles").alias(out), F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)).alias("__part"))
    return left.drop("__key", "__parts").join(right, [key, "__part"]).drop("__part")


def _sharing(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of members (p, np, x, nx, c) of one pivot that may be linked though their components differ.

    Let d(x) be the symmetric difference of the sets of x and its pivot; that of x and y is the one of d(x) and d(y).
    Linked x and y differ in t = (nx + ny) * (100 - percent) / (100 + percent) elements at most, so d(x) and d(y) share
    (|d(x)| + |d(y)| - t) / 2 or more. If that is none, both are linked with the pivot and are in one component. Else they
    share an element among the first |d| - that + 1 of either in any one order of the pivot's group. First are those that
    the pivot hasn't, then those that it has; of a member that has more of the former than links need, the latter are
    not written at all. Of either, those that members of one component only have come first, as they pair none: they are
    counted but never joined. The others follow, rarest first; near copies, which differ from their pivot in elements of
    their own, are not paired at all. As Jaccard distance is a metric, those whose distances from the pivot differ by more
    than a link's are not either.
    """
    own = members.join(sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("sx")), "x").where("size(sx) = nx")
    both = _with_set(materialize(own, "members"), "p", "x", sets, "sp").where("size(sp) = np")
    ratio = (100 - percent) / (100 + percent)
    # linked sets' sizes are within percent of each other, so t is less than this, and so is an element's rank that counts
    most = F.col("nx") * ratio * (1 + 100 / percent) + 1
    d = both.select("p", "np", "x", "nx", "c", F.array_except("sx", "sp").alias("more"), F.array_except("sp", "sx").alias("less"))
    d = d.withColumn("size", F.size("more") + F.size("less")).where("size > 0")
    far = 2 * F.col("size") / (F.col("nx") + F.col("np") + F.col("size"))
    more = F.transform("more", lambda e: F.struct(e.alias("e"), F.lit(False).alias("less")))
    less = F.transform("less", lambda e: F.struct(e.alias("e"), F.lit(True).alias("less")))
    d = d.select("p", "x", "nx", "c", far.alias("far"), "size", F.size("more").alias("first"), F.explode(F.when(F.size("more") < most, F.concat(more, less)).otherwise(more)).alias("e"))
    d = materialize(d.select("p", "x", "nx", "c", "far", "size", "first", "e.*"), "differences")
    often = d.groupBy("p", "e").agg(F.count("*").alias("often"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("p", "e", "often")
    of_x = Window.partitionBy("p", "x", "less")
    upto = F.when(F.col("less"), F.col("size")).otherwise(F.col("first"))
    d = d.join(often, ["p", "e"]).withColumn("r", upto - F.count("*").over(of_x) + F.row_number().over(of_x.orderBy("often", "e")))
    d = d.where(F.col("r") <= most)
    d = materialize(d.select("p", "e", "r", "x", "nx", "c", "far", "size"), "rare-differences")
    y = d.select("p", "e", F.col("r").alias("rb"), F.col("x").alias("b"), F.col("nx").alias("nb"), F.col("c").alias("cb"), F.col("far").alias("farb"), F.col("size").alias("db"))
    share = F.greatest(F.lit(1), F.ceil((F.col("size") + F.col("db") - ratio * (F.col("nx") + F.col("nb"))) / 2 - 1e-9))
    fits = (F.col("x") < F.col("b")) & (F.col("c") != F.col("cb")) & (100 * F.least("nx", "nb") >= percent * F.greatest("nx", "nb")) & (F.col("r") <= F.col("size") - share + 1) & (F.col("rb") <= F.col("db") - share + 1)
    fits &= F.abs(F.col("far") - F.col("farb")) <= (100 - percent) / 100 + 1e-9
    d, y = d.alias("d"), y.alias("y")
    found = d.join(y, (F.col("d.p") == F.col("y.p")) & (F.col("d.e") == F.col("y.e")) & fits)
    return found.select(F.col("x").alias("a"), "b", F.col("nx").alias("na"), "nb").distinct()


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    size: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: int = 6,
    bands: int = 24,
    small: int = 8,
    broadcast_ids: int = 500_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: documents are linked at ``100 * intersection >= percent * union``."""
    spark = docs.sparkSession
    signed = materialize(signatures(docs, id_col, text_col, size, rows, bands), "signatures")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["s1", "s2", "n_shingles"]
    classes = materialize(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")

    banded = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "h")).select("rep", "n_shingles", F.xxhash64("band", "h").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members"))
    # buckets with the same members are one
    buckets = buckets.where("n > 1").groupBy("n", "least", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = materialize(banded.join(buckets, "bucket").select("bucket", "n", F.col("rep").alias("x"), F.col("n_shingles").alias("nx")), "buckets")

    ids = members.select(F.col("x").alias(id_col)).distinct()
    ids = materialize(ids, "bucket-ids")
    few = ids.count() <= broadcast_ids  # else both sides are shuffled
    sets = full_sets(docs.select(id_col, text_col).join(F.broadcast(ids) if few else ids, id_col, "left_semi"), id_col, text_col, size)
    # a row that shares its id with another text is told by its set's size
    sets = materialize(sets.where("size(shingles) > 0"), "sets")

    def measured(pairs: DataFrame) -> DataFrame:
        """pairs (a, b, na, nb) with both, the size of the intersection."""
        pairs = materialize(pairs.distinct(), "pairs")
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        got = _with_set(pairs, "a", "b", sets, "sa").where("size(sa) = na").join(right, "b").where("size(sb) = nb")
        return materialize(got.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("both")).groupBy("a", "b", "na", "nb").agg(F.max("both").alias("both")), "measured")

    fitting = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    linked = F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))

    def stars(rows: DataFrame, pivot: str, size: str) -> DataFrame:
        return rows.where(F.col("x") != F.col(pivot)).select(F.col(pivot).alias("a"), F.col("x").alias("b"), F.col(size).alias("na"), F.col("nx").alias("nb")).where(fitting)

    def central(rows: DataFrame, group: str, weight: DataFrame) -> DataFrame:
        """group, q, nq, n: the member (x, nx) of each group that has most weight, and how many there are."""
        best = rows.join(weight, "x").groupBy(group).agg(F.max(F.struct("w", F.xxhash64("x").alias("h"), "x", "nx")).alias("m"), F.count("*").alias("n"))
        return best.select(group, F.col("m.x").alias("q"), F.col("m.nx").alias("nq"), "n")

    x = members.where(F.col("n") <= small)
    y = x.select("bucket", F.col("x").alias("b"), F.col("nx").alias("nb"))
    pairs = x.select("bucket", F.col("x").alias("a"), F.col("nx").alias("na")).join(y, "bucket").where("a < b").where(fitting).select("a", "b", "na", "nb")
    # a large bucket's members against its pivot; a group of near copies mostly shares one over all its buckets
    large = members.where(F.col("n") > small).select("bucket", "x", "nx")
    pivots = central(large, "bucket", members.groupBy("x").agg(F.sum("n").alias("w"))).select("bucket", F.col("q").alias("p"), F.col("nq").alias("np"))
    starred = materialize(large.join(pivots, "bucket").select("p", "np", "x", "nx").distinct(), "stars")
    tested = measured(pairs.unionByName(stars(starred, "p", "np")))

    def grouped() -> tuple[DataFrame, DataFrame]:
        """The components so far, and the members (p, np, x, nx, c, cp) of pivots that they split; c and cp name components."""
        links = materialize(components(tested.where(linked).select("a", "b")), "components")
        apart = starred.join(links.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component")
        split = apart.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.when(F.col("x") == F.col("p"), F.col("c"))).alias("cp")).where("lo < hi").select("p", "cp")
        return links, materialize(apart.join(split, "p"), "apart")

    links, apart = grouped()
    before = None
    while True:
        rest = materialize(apart.where("c <> cp").select("p", "x", "nx"), "rest")
        left = rest.count()
        if left <= small or (before is not None and 8 * left > 7 * before):
            break
        before = left
        near = members.join(rest.select("x").distinct(), "x", "left_semi").select("bucket", "x")
        weight = near.join(near.groupBy("bucket").agg(F.count("*").alias("m")), "bucket").groupBy("x").agg(F.sum("m").alias("w"))
        more = stars(rest.join(central(rest, "p", weight).where(F.col("n") > small), "p"), "q", "nq")
        tested = tested.unionByName(measured(more.join(tested.select("a", "b"), ["a", "b"], "left_anti")))
        links, apart = grouped()
    if not apart.isEmpty():
        more = _sharing(apart.drop("cp"), sets, percent).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = tested.unionByName(measured(more))
        links = materialize(components(tested.where(linked).select("a", "b")), "components")

    named = classes.select(*same, "rep").join(links.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", *same).join(named, same, "left")
    # rows that share an id are one document: the least component of its rows
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
