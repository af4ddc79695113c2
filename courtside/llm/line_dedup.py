"""Line dedup: a segment-partition edit join of all lines, then removal of repeats.

Two lines are alike within t character edits, t being given by the shorter one's length (``edits``: pairs of a length
and the t of lines of that many characters or more). Cut in t + 1 segments, one of them must occur unchanged in a line
alike, shifted by what the edits before and after it allow; so each distinct line is indexed by its segments, and
probes the indexes of its own and of up to t smaller lengths with those substrings. Candidates are verified by a banded
bit-parallel automaton: one bit for each diagonal and one word for each number of errors, a step for each character.

Only hashes move: keys for distinct lines, and texts of candidates. Keys are counted first, and those that one line
alone has are left out. A group of a key gives its pairs (lines indexed times lines that probe) if they are no more than
``hot`` for each of its rows, so that pairs grow with rows and not with the square of a group. Else the members'
remaining characters (without that segment) are joined again in the same way, within the group, until groups are small.
Lines of one group whose rests are of t characters at most are all alike; each is paired with the first of them only.
Two lines that share several segments are paired by one of them: by the first segment, else the last, else one between.
Rows of other segments carry the hashes of those before in that order ("earlier"); pairs that agree in one aren't made,
and a group whose rows all agree in one goes, as its pairs are found by the other segment.

A line is dropped if a line alike is in a document before its own, or further up in its own, whether that one is dropped
or not: in a chain of lines alike only those stay that have none before them. Lines are compared without white space at
their ends; those with fewer than ``min_chars`` characters are left alone.

Defined results: a null text stays null and an empty one empty. Rows that share an id are one document whose lines
carry on; dropping takes the same line numbers from each of them. Rows with a null id are returned as they are. Tables
without lines give their rows back. Other columns are kept, but for those that have a result's name (n_lines,
n_repeated, n_dropped), which the result replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.shared import materialize

_BLANK = " \t\x0b\f\r"
#: (characters, edits): lines of 20 characters or more are alike within one edit, those of 80 or more within two.
EDITS = ((20, 1), (80, 2))
Edits = tuple[tuple[int, int], ...]


def segment(n: Column, i: int, edits: int | Column) -> tuple[Column, Column]:
    """(start, length) of segment i of the edits + 1 of a line of n characters; the last ones take the remainder."""
    parts = edits + F.lit(1)
    short, rest = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    return 1 + i * short + F.greatest(F.lit(0), i - parts + rest), short + (F.lit(i) >= parts - rest).cast("int")


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings to look up; those with difference and shift 0 are a line's own segments."""
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, d - (edits - i)), min(i, d + edits - i)
            out += [(d, i, s) for s in range(low, high + 1)]
    return sorted(out, key=lambda x: (x[0] != 0 or x[2] != 0, x))


def _allowed(n: Column, edits: Edits) -> Column:
    """The edits of lines of n characters; null where there are none."""
    out = F.lit(None).cast("int")
    for low, t in sorted(edits):
        out = F.when(n >= low, F.lit(t)).otherwise(out)
    return out


def _specs(edits: Edits) -> dict[tuple[int, int, int], list[int]]:
    """The numbers of edits that take each probe (length difference, segment, shift); a line's own segments come first."""
    out: dict[tuple[int, int, int], list[int]] = {}
    for t in sorted({t for _, t in edits}):
        for probe in probes(t):
            out.setdefault(probe, []).append(t)
    return dict(sorted(out.items(), key=lambda x: (x[0][0] != 0 or x[0][2] != 0, x)))


def segment_keys(line: Column, n: Column, edits: Edits) -> list[Column]:
    """A 64-bit key for each of ``_specs``; null where it isn't one of the line's. Lengths are part of a key."""
    out = []
    for (d, i, shift), takers in _specs(edits).items():
        t = _allowed(n - d, edits)
        start, length = segment(n - d, i, t)
        at = start + shift
        fits = t.isin(takers) & (length > 0) & (at >= 1) & (at + length - 1 <= n)
        out.append(F.when(fits, F.xxhash64(n - d, F.lit(i), F.substring(line, at, length))))
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefix(a: Column, b: Column) -> Column:
    """The number of characters that two strings begin with alike: doubled steps, the widest first."""
    steps = F.sequence(F.floor(F.log2(F.length(a) + 1)).cast("int"), F.lit(0), F.lit(-1))
    shorter = F.least(F.length(a), F.length(b))

    def step(n: Column, power: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1), power)
        return F.when(F.substring(a, n + 1, width) == F.substring(b, n + 1, width), F.least(n + width, shorter)).otherwise(n)

    return F.aggregate(steps, F.lit(0), step)


def alike(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` of each other. What they begin and end with alike is left out first."""
    whole = F.struct(a.alias("a"), b.alias("b"), _prefix(a, b).alias("n"))
    tails = _let(whole, lambda x: F.struct(F.reverse(F.substring(x["a"], x["n"] + 1, F.length(x["a"]))).alias("a"), F.reverse(F.substring(x["b"], x["n"] + 1, F.length(x["b"]))).alias("b")))
    tails = _let(tails, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), _prefix(x["a"], x["b"]).alias("n")))
    inner = _let(tails, lambda x: F.struct(F.substring(x["a"], x["n"] + 1, F.length(x["a"])).alias("a"), F.substring(x["b"], x["n"] + 1, F.length(x["b"])).alias("b")))

    def decided(x: Column) -> Column:
        long = F.greatest(F.length(x["a"]), F.length(x["b"]))
        some = _let(F.struct(F.split(x["a"], "").alias("a"), F.split(x["b"], "").alias("b")), lambda y: _alike(y["a"], y["b"], edits))
        may = ends_may_be_alike(x["a"], x["b"], edits)
        return F.when(long <= edits, True).when((F.least(F.length(x["a"]), F.length(x["b"])) == 0) | ~may, False).otherwise(some)

    return _let(inner, decided)


def _alike(a: Column, b: Column, edits: int) -> Column:
    """The same of two arrays of characters.

    Bit k of word e says that the characters of b so far fit those of a up to k - edits further, with e errors at most.
    """
    band = (1 << (2 * edits + 1)) - 1
    first = F.struct(*[F.lit(sum(1 << k for k in range(edits, edits + e + 1)) & band).alias(f"e{e}") for e in range(edits + 1)])

    def step(state: Column, j: Column) -> Column:
        return _let(F.get(b, j), lambda char: stepped(state, j, char))

    def stepped(state: Column, j: Column, char: Column) -> Column:
        same = F.lit(0)
        for k in range(2 * edits + 1):
            at = j + (k - edits)
            fits = F.when(at >= 0, F.coalesce(F.get(a, F.greatest(at, F.lit(0))) == char, F.lit(False))).otherwise(F.lit(False))
            same = same.bitwiseOR(F.when(fits, F.lit(1 << k)).otherwise(F.lit(0)))
        return _let(same, lambda same: moved(state, same))

    def moved(state: Column, same: Column) -> Column:
        words = [state["e0"].bitwiseAND(same)]
        for e in range(1, edits + 1):
            less = state[f"e{e - 1}"]
            word = state[f"e{e}"].bitwiseAND(same).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(words[-1], 1))
            words.append(word.bitwiseAND(F.lit(band)))
        return F.struct(*[w.alias(f"e{e}") for e, w in enumerate(words)])

    ended = F.when(F.size(b) > 0, F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), first, step)).otherwise(first)
    return ended[f"e{edits}"].bitwiseAND(F.call_function("shiftleft", F.lit(1), edits + F.size(a) - F.size(b))) != 0


def ends_may_be_alike(a: Column, b: Column, edits: int) -> Column:
    """False only for strings that aren't alike: the same of blocks of four characters, six from either end."""
    size, n = 4, 6
    found = F.lit(0)
    for k in range(n):
        for at, there in ((F.lit(1 + k * size), F.lit(1 + k * size)), (F.length(a) - (k + 1) * size + 1, F.length(b) - (k + 1) * size + 1)):
            found = found + F.substring(b, F.greatest(F.lit(1), there - edits), F.lit(size + 2 * edits)).contains(F.substring(a, at, F.lit(size))).cast("int")
    return (F.length(a) < 2 * n * size) | (found >= 2 * n - edits)


def may_be_alike(a: Column, b: Column, edits: int) -> Column:
    """False only for strings that aren't alike: of the 6 * edits blocks of a, each edit spoils one at most, and the others are in b near their place."""
    n = 6 * edits
    size = F.floor(F.length(a) / n).cast("int")
    found = F.lit(0)
    for k in range(n):
        at = F.floor(F.length(a) * k / n).cast("int") + 1
        found = found + F.substring(b, F.greatest(F.lit(1), at - edits), size + 2 * edits).contains(F.substring(a, at, size)).cast("int")
    return found >= n - edits


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc_id, pos, line, n, h, g (two hashes) of the lines that take part."""
    got = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    got = got.select("doc_id", "pos", F.btrim("raw", F.lit(_BLANK)).alias("line")).select("doc_id", "pos", "line", F.length("line").alias("n"))
    return got.where(F.col("n") >= min_chars).withColumn("h", F.xxhash64("line")).withColumn("g", F.hash("line"))


def _without(text: Column, at: Column, length: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + length, F.length(text)))


def _found(at: Column, length: Column, n: Column) -> Column:
    return (at >= 1) & (length > 0) & (at + length - 1 <= n)


def similar_lines(docs: DataFrame, edits: Edits = EDITS, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", hot: int = 8, broadcast_rows: int = 200_000, broadcast_bytes: int = 16_000_000) -> DataFrame:
    """a, b (hashes of distinct lines): pairs of lines alike, each once.

    Among lines that differ in a few characters at one place, only pairs with the one that occurs first are sure to be there.
    """
    lines = _lines(docs, id_col, text_col, min_chars)
    specs = list(_specs(edits))
    own = sum(d == 0 and shift == 0 for d, _, shift in specs)  # the first of specs are a line's own segments
    names = [f"k{i}" for i in range(len(specs))]
    keyed = lines.select("h", "g", "n", F.struct("doc_id", "pos").alias("at"), *[k.alias(c) for c, k in zip(names, segment_keys(F.col("line"), F.col("n"), edits), strict=True)])
    distinct = keyed.groupBy("h", "g", "n").agg(F.min("at").alias("at"), *[F.max(c).alias(c) for c in names])
    distinct = materialize(distinct.drop("g"), "line-keys")

    def weighed(rows: DataFrame, indexed: Column, probing: Column, level: int) -> DataFrame:
        """key, heavy (whether its pairs are too many) of the keys that two lines have, one of them indexed."""
        i, p = F.sum(indexed.cast("long")), F.sum(probing.cast("long"))
        counted = rows.groupBy("key").agg(i.alias("i"), p.alias("p"), F.min("h").alias("low"), F.max("h").alias("high"), *[agg(F.get("earlier", F.lit(k))).alias(f"{name}{k}") for k in range(2 * level + 2) for name, agg in (("least", F.min), ("most", F.max))])
        for k in range(2 * level + 2):  # all rows of a group have the same slots
            counted = counted.where(F.coalesce(F.col(f"least{k}") < F.col(f"most{k}"), F.lit(True)))
        counted = counted.where("i > 0 AND low < high").select("key", (F.col("i") * F.col("p") > hot * (F.col("i") + F.col("p"))).alias("heavy"))
        return materialize(counted, "shared-segments")

    def ordered(rows: DataFrame) -> DataFrame:
        """Rows (a, b, at_a, at_b) with a < b."""
        first = F.col("a") < F.col("b")
        return rows.where("a <> b").select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("a", "a", "b"), ("b", "b", "a"), ("at_a", "at_a", "at_b"), ("at_b", "at_b", "at_a"))])

    def crossed(index: DataFrame, probe: DataFrame) -> DataFrame:
        a = index.select(F.col("key").alias("ka"), F.col("h").alias("a"), F.col("at").alias("at_a"), F.col("earlier").alias("ea"))
        b = probe.select(F.col("key").alias("kb"), F.col("h").alias("b"), F.col("at").alias("at_b"), F.col("earlier").alias("eb"))
        return ordered(a.join(b, (F.col("ka") == F.col("kb")) & (F.col("a") != F.col("b")) & ~F.coalesce(F.arrays_overlap("ea", "eb"), F.lit(False))))

    def fetched(wanted: DataFrame) -> DataFrame:
        """h, line of the lines (h, at) wanted, from their first places."""
        wanted = materialize(wanted.select("h", F.col("at.doc_id").alias("doc_id")).distinct(), "wanted-lines")
        hint = F.broadcast if wanted.count() <= broadcast_rows else (lambda d: d)  # beyond, both sides are shuffled
        some = docs.join(hint(wanted.select(F.col("doc_id").alias(id_col)).distinct()), id_col, "left_semi")
        texts = _lines(some, id_col, text_col, min_chars).join(hint(wanted), ["h", "doc_id"], "left_semi")
        return materialize(texts.groupBy("h").agg(F.first("line").alias("line")), "line-texts")

    def entry(k: int) -> Column:
        diff, i, _ = specs[k]
        t = _allowed(F.col("n") - diff, edits)
        first, last = F.lit(None).cast("long"), F.lit(None).cast("long")
        if i:
            first = F.col(names[specs.index((diff, 0, 0))])
            for e in {e for _, e in edits if i < e and diff <= e}:
                last = F.when(t == e, F.col(names[specs.index((diff, e, diff))])).otherwise(last)
        return F.when(F.col(names[k]).isNotNull(), F.struct(F.col(names[k]).alias("key"), F.lit(k).alias("spec"), F.array(first, last).alias("earlier")))

    # most keys are one line's alone: those go first, by rows of no more than a key and a line's hash
    alone = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("key"), F.lit(k < own).alias("own"))) for k, c in enumerate(names)])))
    counted = distinct.select("h", alone.alias("x")).groupBy("x.key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("x.own").alias("own"))
    several = materialize(counted.where("own AND low < high").select("key"), "several-lines")
    few = several.count() <= broadcast_rows  # beyond, both sides are shuffled
    keys = F.explode(F.array_compact(F.array(*map(entry, range(len(specs))))))
    every = distinct.select("h", "at", keys.alias("x")).select("x.key", "x.spec", "h", "at", "x.earlier")
    every = materialize(every.join(F.broadcast(several) if few else several, "key"), "several-rows")
    indexed = F.col("spec") < own
    shared = weighed(every, indexed, F.lit(True), 0)
    few = shared.count() <= broadcast_rows
    every = materialize(every.join(F.broadcast(shared) if few else shared, "key"), "shared-lines")
    light = every.where("NOT heavy")
    # a round's pairs are written with it, so that no plan holds all rounds
    found = [materialize(crossed(light.where(indexed), light), "round-pairs")]

    rows = every.where("heavy").drop("heavy")
    if not rows.isEmpty():
        rows = rows.where(indexed).withColumn("own", F.lit(True)).unionByName(rows.withColumn("own", F.lit(False)))
        texts = fetched(rows.select("h", "at"))
        n, line, d = F.length("line"), F.col("line"), F.col("d")
        # the rows with, as line, what is left without the substring of their key; t edits may be in it
        spec = F.get(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("d", "i", "shift"), x, strict=True)]) for x in specs]), F.col("spec"))
        rows = rows.join(texts, "h").withColumn("s", spec).withColumn("t", _allowed(n - F.col("s.d"), edits))
        start, length = segment(n - F.col("s.d"), F.col("s.i"), F.col("t"))
        rows = rows.select("own", "key", "h", "at", "earlier", _without(line, start + F.col("s.shift"), length).alias("line"), F.col("s.d").alias("d"), "t", (F.col("s.shift") != 0).alias("moved"))
        # the substrings to look up, as rows; -1 for rests that are too short to be cut
        named = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("t", "d", "i", "shift"), (t, *x), strict=True)]) for t in sorted({t for _, t in edits}) for x in probes(t)]
        short = F.struct(F.col("t"), F.col("d"), F.lit(-1).alias("i"), F.lit(0).alias("shift"))
        taken = F.filter(F.array(*named), lambda x: (x["t"] == F.col("t")) & (x["d"] == F.col("d")) & (~F.col("own") | ((x["d"] == 0) & (x["shift"] == 0))))
        cuts = F.when(n - d <= F.col("t"), F.array(short)).otherwise(taken)
        level = 0
        while True:
            level += 1
            rows = rows.select("own", "key", "h", "at", "d", "t", "earlier", "line", "moved", n.alias("n"), F.explode(cuts).alias("s"))
            i, base = F.col("s.i"), F.col("n") - d
            start, length = segment(base, i, F.col("t"))
            at = start + F.col("s.shift")
            rows = rows.where((i < 0) | _found(at, length, F.col("n")))
            (_, size), (tail, tail_size) = segment(base, 0, F.col("t")), segment(base, F.col("t"), F.col("t"))
            first = F.when(i > 0, F.xxhash64(F.size("earlier"), F.substring(line, F.lit(1), size)))
            last = F.when((i > 0) & (i < F.col("t")), F.xxhash64(F.size("earlier") + 1, F.substring(line, tail + d, tail_size)))
            rows = rows.select(
                "own",
                F.when(i < 0, F.xxhash64("key", i)).otherwise(F.xxhash64("key", base, i, F.substring(line, at, length))).alias("key"),
                "h",
                "at",
                F.when(i < 0, F.lit("")).otherwise(_without(line, at, length)).alias("line"),
                "d",
                "t",
                (F.col("moved") | (F.col("s.shift") != 0)).alias("moved"),
                (i < 0).alias("last"),
                F.when(i < 0, F.col("earlier")).otherwise(F.concat("earlier", F.array(first, last))).alias("earlier"),
            ).distinct()
            rows = materialize(rows, "hot-rests")
            # rests too short to be cut: those of one length and at one place are all alike, others give the pairs of their group
            ends = rows.where("last AND own")
            first = ends.groupBy("key").agg(F.min(F.struct("at", "h")).alias("least"))
            made = [ordered(ends.join(first, "key").select(F.col("h").alias("a"), F.col("least.h").alias("b"), F.col("at").alias("at_a"), F.col("least.at").alias("at_b")))]
            made.append(crossed(ends, rows.where("last AND NOT own AND (d > 0 OR moved)")))
            rows = rows.where("NOT last").drop("last")
            rows = rows.join(weighed(rows, F.col("own"), ~F.col("own"), level), "key")
            light = rows.where("NOT heavy")
            made.append(crossed(light.where("own"), light.where("NOT own")))
            found.append(materialize(reduce(DataFrame.unionByName, made), "round-pairs"))
            rows = materialize(rows.where("heavy").drop("heavy"), "heavy-rests")
            if rows.isEmpty():
                break

    pairs = reduce(DataFrame.unionByName, found)
    # a number of its own, as verification takes far more time than the bytes of pairs tell
    pairs = materialize(pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b").distinct(), "line-pairs")
    texts = fetched(pairs.select(F.col("a").alias("h"), F.col("at_a").alias("at")).unionByName(pairs.select(F.col("b").alias("h"), F.col("at_b").alias("at"))))
    held = texts.agg(F.coalesce(F.sum(64 + F.octet_length("line")), F.lit(0))).first()[0]
    hint = F.broadcast if held <= broadcast_bytes else (lambda d: d)  # beyond, both sides are shuffled
    both = pairs.select("a", "b").join(hint(texts.select(F.col("h").alias("a"), F.col("line").alias("ta"))), "a").join(hint(texts.select(F.col("h").alias("b"), F.col("line").alias("tb"))), "b")
    both = both.withColumn("t", _allowed(F.least(F.length("ta"), F.length("tb")), edits)).where(F.abs(F.length("ta") - F.length("tb")) <= F.col("t"))
    may, sure = F.lit(False), F.lit(False)
    for t in {t for _, t in edits}:
        may = F.when(F.col("t") == t, may_be_alike(F.col("ta"), F.col("tb"), t)).otherwise(may)
        sure = F.when(F.col("t") == t, alike(F.col("ta"), F.col("tb"), t)).otherwise(sure)
    return both.where(may).where(sure).select("a", "b")


def dedup_lines(docs: DataFrame, edits: Edits = EDITS, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 16_000_000, parts: int = 20_000) -> DataFrame:
    """The documents with ``text`` without repeated lines, and n_lines, n_repeated (lines with a line alike elsewhere), n_dropped."""
    alike_ = materialize(similar_lines(docs, edits, min_chars, id_col, text_col), "similar-lines")
    sides = alike_.select("a", "b").unionByName(alike_.select(F.col("b").alias("a"), F.col("a").alias("b")))

    # of each line that occurs again or has a line alike: its number and its first place, then those with its neighbours
    placed = _lines(docs, id_col, text_col, min_chars).select("doc_id", "pos", "h")
    place = F.struct("doc_id", "pos")
    stated = placed.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    stated = stated.join(sides.select(F.col("a").alias("h"), F.lit(True).alias("linked")).distinct(), "h", "left").where("n > 1 OR linked")
    stated = materialize(stated.select("h", "n", "first"), "repeated-lines")
    near = sides.join(stated.select(F.col("h").alias("b"), "first"), "b").groupBy(F.col("a").alias("h")).agg(F.min("first").alias("near"))
    repeated = materialize(stated.join(near, "h", "left").select("h", "n", F.least("first", "near").alias("first")), "first-places")

    # fewer than ``parts`` lines are more than one of ``parts`` of all repeats each: those go to every task, the others are shuffled
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * parts > total
    again = placed.join(F.broadcast(repeated.where(often).select("h", F.col("first").alias("hot"))), "h", "left")
    again = again.join(repeated.where(~often).select("h", "first"), "h", "left") if total >= parts else again.withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType))
    again = again.select("doc_id", "pos", F.coalesce("hot", "first").alias("first")).where("first IS NOT NULL").select("doc_id", "pos", (place > F.col("first")).alias("drop"))
    drops = again.groupBy("doc_id").agg(F.collect_list(F.when(F.col("drop"), F.col("pos"))).alias("__drop"), F.count("*").alias("__again"))
    drops = materialize(drops.withColumnRenamed("doc_id", "__id"), "line-drops")
    held = drops.agg(F.coalesce(F.sum(64 + 4 * F.size("__drop")), F.lit(0))).first()[0]
    hint = F.broadcast(drops) if held <= broadcast_bytes else drops  # else both sides are shuffled

    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_repeated", "n_dropped")]
    got = docs.select(F.struct(*kept_columns).alias("__row"), F.col(id_col).alias("__doc"), F.split(text_col, "\n").alias("__lines")).join(hint, F.col("__doc") == F.col("__id"), "left")
    number = F.size("__lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), number - 1), "__drop"), lambda i: F.get("__lines", i))
    changed = F.size("__drop") > 0
    return got.select(
        *[F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(f"__row.{c}")).alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in kept_columns],
        F.coalesce(F.when(F.col("__lines").isNotNull(), number), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("__again", F.lit(0)).alias("n_repeated"),
        F.when(changed, F.size("__drop")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )
