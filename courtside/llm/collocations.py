"""Phrases of several words that occur often, per language, by bidirectional BWT indexes of shards.

Every task cuts its texts into pieces (at punctuation and line ends) and the pieces into words, and indexes about
``shard_words`` words at a time: the words become ids of the shard, and the shard keeps the Burrows-Wheeler transforms of
the id sequence and of its reverse, both sorted by as many words as phrases are long. A phrase is then a pair of
intervals, one in each index. It is extended to the left by all the words that stand in its interval of the forward
transform, and to the right by those in its interval of the reverse one; both intervals of every extension follow, and
an interval's length is the phrase's count in the shard.

Counts are summed over shards for one length at a time. Only phrases that are frequent over all shards are extended, and
only to phrases whose other part is frequent too, which loses no frequent phrase. A phrase of n + 1 words is named by
its first and its last n words. A shard proposes its phrases to parts (a hash of both names tells which), as packed
columns of names and counts, one row for each part; a part sums the counts of all shards, numbers what is frequent and
tells each shard which of its own proposals those are. A shard then finds their intervals again by extending from its
words, which is cheaper than to keep them. So no task needs a dictionary of all words or phrases, and names and counts
are all that is shuffled; the indexes themselves are written once, clustered by shard.

A task holds the index of one shard, or one part: at most ``part_words`` proposals on average, each of them once for
each shard at most, so that no common phrase is hot. A shard holds a text of any length whole (its memory grows with the
longest text only).

Defined results: null texts are empty, a null language counts as ``und``; repeated rows all count; other columns are not
read; an empty table has no phrases. Ties are in the order of the phrases' bytes. A table may be read in up to 2**20
partitions and a partition give up to 2**11 shards; beyond that the job ends with an error.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.words import mix
from courtside.shared import fresh_path, materialize

#: The bytes that end a piece; a byte that UTF-8 has not stands for them.
ENDS = b".,;:!?\n\x0b\x0c\r"
_END = b"\xff"
_TABLE = bytes.maketrans(ENDS + b"\t" + bytes(range(65, 91)), _END * len(ENDS) + b" " + bytes(range(97, 123)))
_SHARD = "shard long, n_symbols long, forward binary, reverse binary, langs array<string>, n_words array<long>, words array<string>, lo array<int>, counts array<int>, lang_of array<int>"
_KNOWN = pa.schema([("shard", pa.int64()), ("length", pa.int32()), ("part", pa.int64()), ("places", pa.binary()), ("names", pa.binary())])
_PROPOSED = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("p", pa.binary()), ("s", pa.binary()), ("n", pa.binary())])
_WORDS = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("langs", pa.list_(pa.string())), ("lang_of", pa.binary()), ("size", pa.int64()), ("words", pa.binary()), ("first", pa.int64()), ("n", pa.binary())])
_JUDGED_WORDS = pa.schema([*_KNOWN, ("lang", pa.list_(pa.string())), ("word", pa.list_(pa.string())), ("f", pa.list_(pa.int64()))])
_JUDGED = pa.schema([*_KNOWN, *[(c, pa.list_(pa.int64())) for c in "psf"]])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers with bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], n * 8, "zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _ordered(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the places of ``key`` in its order, the keys in it); key: from 0 to below ``most``. Equal keys keep their order.

    Numbers that hold key and place are sorted where they fit into 63 bits, which is faster than sorting places by keys.
    """
    n = len(key)
    if most * n >= 1 << 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key * n + np.arange(n))
    key = both // n
    return both - key * n, key


def transform(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, suffixes being in the order of (at least) their first ``depth`` symbols."""
    n, rank, known = len(symbols), symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable") if depth < 2 else rank
    while known < depth:
        ahead = np.full(n, -1, np.int64)
        ahead[: max(n - known, 0)] = rank[known:]
        width = int(rank.max(initial=0)) + 2
        order, key = _ordered(rank * width + ahead + 1, width * width)
        new = np.r_[False, key[1:] != key[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        known *= 2
    return symbols[order - 1]


class Index:
    """Both transforms of a shard; symbol 0 ends a piece and is in no phrase."""

    def __init__(self, forward: np.ndarray, reverse: np.ndarray):
        self.n = len(forward)
        self.sides = (forward, reverse)
        self.placed: dict[bool, np.ndarray] = {}

    def before(self, left: bool) -> np.ndarray:
        """For each place of a side the place of the suffix that begins one symbol earlier: the places in order of symbols."""
        if left not in self.placed:
            side = self.sides[not left]
            order, _ = _ordered(side, int(side.max(initial=0)) + 1)
            self.placed[left] = place = np.empty(self.n, np.int64)
            place[order] = np.arange(self.n)
        return self.placed[left]

    @classmethod
    def of(cls, symbols: np.ndarray, depth: int) -> Index:
        return cls(transform(symbols, depth), transform(symbols[::-1], depth))

    def grown(self, lo: np.ndarray, rlo: np.ndarray, n: np.ndarray, left: bool) -> tuple[np.ndarray, ...]:
        """(number of the phrase, symbol, lo, rlo, n) of all phrases with one more word on the left, or on the right."""
        here, there = (lo, rlo) if left else (rlo, lo)
        side = self.sides[not left]
        total = int(n.sum())
        owner = np.repeat(np.arange(len(n)), n)
        at = np.repeat(here - (np.cumsum(n) - n), n) + np.arange(total)
        width = int(side.max(initial=0)) + 1
        order, key = _ordered(owner * width + side[at], max(1, len(n)) * width) if total else (at, at)
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if total else np.zeros(0, np.int64)
        count = np.diff(np.r_[head, total])
        owner, symbol = key[head] // width, key[head] % width
        smaller = head - (np.cumsum(n) - n)[owner]  # symbols of the same interval that come before this one
        new_here = self.before(left)[at[order[head]]]  # of the symbol's first place in the interval
        new_there = there[owner] + smaller
        word = symbol > 0
        found = (owner, symbol, new_here, new_there) if left else (owner, symbol, new_there, new_here)
        return (*(x[word] for x in found), count[word])


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int, depth: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    numbers = itertools.count()
    known: dict[str, dict[bytes, int]] = {}
    size, held = itertools.count(1), []
    n_held = 0

    class Ids(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = found = next(size)
            return found

    def flush() -> pa.RecordBatch:
        nth = next(numbers)
        if part >= 1 << 20 or nth >= 1 << 11:
            raise ValueError("the table has too many partitions or too large ones: see the limits of collocations")
        symbols = np.concatenate([np.zeros(1, np.int64), *held])
        index_f, index_r = transform(symbols, depth), transform(symbols[::-1], depth)
        counts = np.bincount(symbols)
        lo = np.cumsum(counts) - counts
        found = [(zlib.crc32(w), w, i, k) for k, of_lang in enumerate(known.values()) for w, i in of_lang.items() if i]
        found.sort()  # words by the hash whose ranges make parts, so that a part has a run of them
        words, ids, lang_of = [w.decode() for _, w, _, _ in found], [i for _, _, i, _ in found], [k for _, _, _, k in found]
        row = [part << 11 | nth, len(symbols), _packed(index_f), _packed(index_r), list(known), [int(counts[[i for i in of_lang.values() if i]].sum()) for of_lang in known.values()], words, lo[ids], counts[ids], np.array(lang_of, np.int32)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [f.split()[0] for f in _SHARD.split(", ")])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            value = text.as_buffer()
            if not value:
                continue
            if lang not in known:
                known[lang] = Ids({_END: 0})
            ids = known[lang]
            tokens = (bytes(value).translate(_TABLE).replace(_END, b" \xff ") + b" \xff").split()
            held.append(np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)))
            n_held += len(tokens)
            if n_held >= shard_words:
                yield flush()
                known, held, n_held, size = {}, [], 0, itertools.count(1)
    if n_held:
        yield flush()


def _extended(index: Index, lo: np.ndarray, rlo: np.ndarray, n: np.ndarray, name: np.ndarray, left: bool) -> tuple[np.ndarray, ...]:
    """(p, s, lo, rlo, n) of the phrases one word longer whose first and last words but one (p and s) are both given."""
    owner, _, new_lo, new_rlo, count = index.grown(lo, rlo, n, left)
    # the other part has the interval in which the extension's lies
    mine, new = (lo, new_lo) if left else (rlo, new_rlo)
    holder = np.full(index.n, -1, np.int32)
    total = int(n.sum())
    holder[np.repeat(mine - (np.cumsum(n) - n), n) + np.arange(total)] = np.repeat(np.arange(len(n), dtype=np.int32), n)
    other = holder[new]
    fits = other >= 0
    owner, other = name[owner[fits]], name[other[fits]]
    return (*((other, owner) if left else (owner, other)), new_lo[fits], new_rlo[fits], count[fits])


def _sorted(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then the next (all from 0 on); in one sort where they fit into 63 bits."""
    widths = [int(k.max(initial=0)) + 1 for k in keys]
    if math.prod(widths) >= 1 << 63:
        return np.lexsort(keys[::-1])
    key = keys[0]
    for k, w in zip(keys[1:], widths[1:], strict=True):
        key = key * w + k
    return np.argsort(key)


def _packed_pairs(p: np.ndarray, s: np.ndarray) -> tuple[bytes, bytes]:
    """Pairs in order by what they differ from the pair before."""
    dp, ds = np.diff(p, prepend=0), np.diff(s, prepend=0)
    new = dp != 0
    new[:1] = True
    ds[new] = s[new]
    return _packed(dp), _packed(ds)


def _unpacked_pairs(dp: bytes, ds: bytes) -> tuple[np.ndarray, np.ndarray]:
    dp, ds = _unpacked(dp), _unpacked(ds)
    head = np.flatnonzero(np.r_[True, dp[1:] != 0])
    sums = np.cumsum(ds)
    return np.cumsum(dp), sums - np.repeat(sums[head] - ds[head], np.diff(np.r_[head, len(ds)]))


def _named(f: np.ndarray, least: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(the frequent ones, commonest first; names of all, those of the frequent ones by that order, so that most are small)."""
    order = np.argsort(-f, kind="stable")
    order = order[: int((f >= least).sum())]
    name = np.full(len(f), -1, np.int64)
    name[order] = np.arange(len(order)) * parts + part
    return order, name


def _part_of(p: np.ndarray, s: np.ndarray, parts: int) -> np.ndarray:
    return (mix(mix(p.astype(np.uint64)) + s.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _proposals(length: int, parts: int):
    """A shard and what is known of its shorter phrases to its phrases of this length, dealt to parts by a hash of their names."""

    def propose(shards: pa.Table, known: pa.Table) -> pa.Table:
        if not shards.num_rows or not known.num_rows:
            return _PROPOSED.empty_table()
        index = Index(_unpacked(shards["forward"][0].as_py()), _unpacked(shards["reverse"][0].as_py()))
        told = sorted(known.select(["length", "part", "places", "names"]).to_pylist(), key=lambda k: (k["length"], k["part"]))
        ones = [k for k in told if k["length"] == 1]
        lo = np.array(shards["lo"][0].values, np.int64)[np.concatenate([np.cumsum(_unpacked(k["places"])) for k in ones])]
        name = np.concatenate([_unpacked(k["names"]) for k in ones])
        ends = np.cumsum(np.bincount(index.sides[0]))
        state = (lo, lo, ends[np.searchsorted(ends, lo, side="right")] - lo, name)
        for m in range(2, length + 1):
            p, s, lo, rlo, n = _extended(index, *state, left=m % 2 == 0)
            part = _part_of(p, s, parts)
            order = _sorted(part, p, s)
            p, s, lo, rlo, n = (x[order] for x in (p, s, lo, rlo, n))
            at = np.searchsorted(part[order], np.arange(parts + 1))
            if m < length:
                rows = [k for k in told if k["length"] == m]
                kept = np.concatenate([np.zeros(0, np.int64), *[at[k["part"]] + np.cumsum(_unpacked(k["places"])) for k in rows]])
                names = np.concatenate([np.zeros(0, np.int64), *[_unpacked(k["names"]) for k in rows]])
                state = (lo[kept], rlo[kept], n[kept], names)
        found = [(k, slice(at[k], at[k + 1])) for k in range(parts) if at[k] < at[k + 1]]
        shard = shards["shard"][0].as_py()
        pairs = [_packed_pairs(p[x], s[x]) for _, x in found]
        return pa.table([[shard] * len(found), [k for k, _ in found], [a for a, _ in pairs], [b for _, b in pairs], [_packed(n[x]) for _, x in found]], schema=_PROPOSED)

    return propose


def _verdicts(length: int, least: int, parts: int):
    """What all shards propose in one part to the phrases that are frequent, and to each shard which of its own those are."""

    def judge(proposed: pa.Table) -> pa.Table:
        rows = proposed.to_pylist()
        p, s = (np.concatenate(x) for x in zip(*[_unpacked_pairs(r["p"], r["s"]) for r in rows], strict=True))
        n = np.concatenate([_unpacked(r["n"]) for r in rows])
        order = _sorted(p, s)
        head = np.r_[True, (np.diff(p[order]) != 0) | (np.diff(s[order]) != 0)]
        f = np.add.reduceat(n[order], np.flatnonzero(head))
        frequent, name = _named(f, least, rows[0]["part"], parts)
        of_row = np.empty(len(order), np.int64)
        of_row[order] = np.cumsum(head) - 1
        first = order[head][frequent]
        out = [(None, rows[0]["part"], None, None, p[first], s[first], f[frequent])]
        begin = 0
        for r in rows:
            size = int.from_bytes(r["n"][:8], "little")
            mine = name[of_row[begin : begin + size]]
            kept = np.flatnonzero(mine >= 0)
            out.append((r["shard"], r["part"], _packed(np.diff(kept, prepend=0)), _packed(mine[kept]), None, None, None))
            begin += size
        columns = [list(c) for c in zip(*out, strict=True)]
        return pa.table([columns[0], [length] * len(out), *columns[1:]], schema=_JUDGED)

    return judge


def _word_proposals(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Each shard's words with their counts, dealt to parts by ranges of the hash that they are ordered by."""
    for batch in batches:
        for row in batch.to_pylist():
            words = [w.encode() for w in row["words"]]
            part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * parts >> 32
            at = np.searchsorted(part, np.arange(parts + 1))
            n, lang = (np.array(row[c], np.int64) for c in ("counts", "lang_of"))
            out = []
            for k in np.flatnonzero(np.diff(at)).tolist():
                mine = slice(at[k], at[k + 1])
                joined = b"\n".join(words[mine])
                out.append((row["shard"], k, row["langs"], _packed(lang[mine]), len(joined), pa.compress(joined, "zstd", asbytes=True), int(at[k]), _packed(n[mine])))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _WORDS, strict=True)], schema=_WORDS)


def _word_verdicts(least: int, parts: int):
    """``_verdicts`` for words, which are named by language and word."""

    def judge(proposed: pa.Table) -> pa.Table:
        rows, number = proposed.to_pylist(), {}
        ids, counts = [], []
        for r in rows:
            langs = [r["langs"][k] for k in _unpacked(r["lang_of"])]
            words = pa.decompress(r["words"], r["size"], "zstd", asbytes=True).split(b"\n")
            ids.append(np.fromiter((number.setdefault(w, len(number)) for w in zip(langs, words, strict=True)), np.int64, len(words)))
            counts.append(_unpacked(r["n"]))
        f = np.bincount(np.concatenate(ids), np.concatenate(counts), len(number)).astype(np.int64)
        frequent, name = _named(f, least, rows[0]["part"], parts)
        words = list(number)
        told = [words[k] for k in frequent.tolist()]
        out = [(None, rows[0]["part"], None, None, [lang for lang, _ in told], [w.decode() for _, w in told], f[frequent])]
        for r, i in zip(rows, ids, strict=True):
            kept = np.flatnonzero(name[i] >= 0)
            out.append((r["shard"], r["part"], _packed(np.diff(r["first"] + kept, prepend=0)), _packed(name[i[kept]]), None, None, None))
        columns = [list(c) for c in zip(*out, strict=True)]
        return pa.table([columns[0], [1] * len(out), *columns[1:]], schema=_JUDGED_WORDS)

    return judge


def count_phrases(docs: DataFrame, least: int = 30, longest: int = 4, lang: str = "lang", text: str = "text", shard_words: int = 2_000_000, part_words: int = 1_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n) with all words' occurrences, a table for each length from 1 to ``longest``).

    The first table has id, lang, word, f; the others id, p, s, f: the names of a phrase, of its first and of its last
    words but one, and its count. All phrases with a count of ``least`` or more are there, and no others.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = read.mapInArrow(lambda batches: _shards(batches, shard_words, longest), _SHARD)
    table, n_buckets = f"courtside_phrases_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.option("path", fresh_path(spark, "phrase-shards")).bucketBy(n_buckets, "shard").saveAsTable(table)
    try:
        shards = spark.table(table)
        spoken = shards.select(F.explode(F.arrays_zip("langs", "n_words")).alias("x")).select(F.col("x.langs").alias("lang"), F.col("x.n_words").alias("n"))
        totals = materialize(spoken.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-words")
        parts = max(1, -(-(shards.agg(F.sum("n_symbols")).first()[0] or 0) // part_words))
        words = shards.select("shard", "langs", "lang_of", "words", "counts").mapInArrow(lambda batches: _word_proposals(batches, parts), _ddl(_WORDS))
        judged = materialize(words.groupBy("part").applyInArrow(_word_verdicts(least, parts), _ddl(_JUDGED_WORDS)), "phrases-1")
        entry = F.posexplode(F.arrays_zip("lang", "word", "f")).alias("at", "x")
        tables = [judged.where("shard IS NULL").select("part", entry).select((F.col("at") * parts + F.col("part")).alias("id"), "x.*")]
        known = judged.where("shard IS NOT NULL").select(_KNOWN.names)
        for length in range(2, longest + 1):
            proposed = shards.select("shard", "forward", "reverse", "lo").groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_proposals(length, parts), _ddl(_PROPOSED))
            judged = materialize(proposed.groupBy("part").applyInArrow(_verdicts(length, least, parts), _ddl(_JUDGED)), f"phrases-{length}")
            entry = F.posexplode(F.arrays_zip("p", "s", "f")).alias("at", "x")
            tables.append(judged.where("shard IS NULL").select("part", entry).select((F.col("at") * parts + F.col("part")).alias("id"), "x.*"))
            known = known.unionByName(judged.where("shard IS NOT NULL").select(known.columns))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return totals, tables


def _scored(tables: list[DataFrame], inside_percent: int) -> list[DataFrame]:
    """For each length from 2: lang, phrase, a, l, r, k, score of phrases that no longer one mostly holds."""
    one = tables[0].select("id", "lang", F.array("word").alias("words"), F.array("f").alias("firsts"), F.array("f").alias("lasts"))
    before, out = one, []
    for at, found in enumerate(tables[1:], 1):
        p = before.select(F.col("id").alias("p"), "lang", F.col("words").alias("p_words"), "firsts")
        s = before.select(F.col("id").alias("s"), F.element_at("words", -1).alias("last"), "lasts")
        joined = found.join(p, "p").join(s, "s")
        phrases = joined.select("id", "lang", F.concat("p_words", F.array("last")).alias("words"), F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"))
        before = materialize(phrases, "phrases-told")
        length = at + 1
        cuts = []
        for k in range(1, length):
            l, r = f"firsts[{k - 1}]", f"lasts[{length - k - 1}]"
            score = f"CAST(firsts[{length - 1}] AS DECIMAL(20,0)) * 2000000 div (CAST({l} AS DECIMAL(20,0)) + {r})"
            cuts.append(F.struct(F.expr(score).alias("score"), F.lit(k).alias("k"), F.expr(l).alias("l"), F.expr(r).alias("r")))
        told = before.select("id", "lang", F.array_join("words", " ").alias("phrase"), F.element_at("firsts", -1).alias("a"), (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut")).select("id", "lang", "phrase", "a", "cut.*")
        if at + 1 < len(tables):
            longer = tables[at + 1]
            for side in ("p", "s"):
                most = longer.groupBy(F.col(side).alias("id")).agg(F.max("f").alias("most"))
                told = told.join(most, "id", "left").where(F.expr(f"most IS NULL OR CAST(most AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {inside_percent}")).drop("most")
        out.append(told.drop("id"))
    return out


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, inside_percent: int = 80, top: int = 2000, **more) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    a: the phrase's count; l, r: those of the two parts of its worst cut; score: floor(2000000 a / (l + r)). Phrases that
    lie in a longer one with ``inside_percent`` of their count are left out: an extension by one word tells, as the
    counts of longer ones are no larger.
    """
    totals, tables = count_phrases(docs, least, longest, **more)
    phrases = None
    for told in _scored(tables, inside_percent):
        phrases = told if phrases is None else phrases.unionByName(told)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of 64 parts first: a language's last window holds 64 times ``top`` rows at most
    part = Window.partitionBy("lang", "__part").orderBy(*order)
    best = phrases.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("__at", F.row_number().over(part)).where(F.col("__at") <= top)
    ranks = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranks.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
