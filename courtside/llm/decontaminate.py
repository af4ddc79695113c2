"""Benchmark decontamination by greedy string tiling.

Windows of ``seed_words`` words, hashed as a running Karp-Rabin search does, are the seeds that documents and benchmark
items share. A shared seed whose words before it differ begins a match, whose length is found by halving steps over
running hashes of both texts; so a long run of one word costs its length, not its square. A pair whose matches could
cover enough of the item is tiled: the longest match whose words are free in both texts is marked, again and again (a match that marks cut goes back with its
free parts), until none of ``seed_words`` words is left. Tiles may lie in any order, so reordered passages count. A
document is contaminated by an item of whose words its tiles cover ``coverage`` or more.

The benchmark is the stated query set. It goes to the tasks in blocks of ``block_chars`` characters, one pass over the
documents for each block, however large it is; documents only stream through.

Words are compared without ASCII punctuation and case. Of equally long matches the first in the document, then in the
item, is marked first. Defined results: null, empty and blank texts have no words. An item with fewer than ``seed_words``
words fits just the documents that consist of its words and no others. Rows that share an id are each tiled; a
null id is reported as null. Equal items count once. Other columns of the inputs are not read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.words import mix, powers, shingle_hashes, text_bytes, text_slices, word_hashes

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*text_bytes(column), drop=_PUNCTUATION)


def _running(words: np.ndarray) -> np.ndarray:
    """Sums of words times powers of a base, from which ``_same`` compares any two stretches."""
    return np.r_[np.uint64(0), np.cumsum(words * powers(len(words) + 1)[0][: len(words)], dtype=np.uint64)]


def _stretch(sums: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (sums[at + n] - sums[at]) * powers(len(sums))[1][at]


def _keys(seeds: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A hash of each seed and the word before it."""
    return mix(seeds * np.uint64(0x9E3779B97F4A7C15) + before)


class Benchmark:
    """Items' words and the places of their seeds, sorted by seed and then by the word before."""

    def __init__(self, texts: list[str], seed_words: int):
        self.words, self.first = words_of(pa.array(texts, pa.string()))
        self.size, self.sums = np.diff(self.first), _running(self.words)
        seeds, at = shingle_hashes(self.words, self.first, seed_words)
        item = np.repeat(np.arange(len(texts)), np.diff(at))
        place = np.arange(len(seeds)) - at[:-1][item] if len(seeds) else item
        word = self.first[:-1][item] + place
        before = np.where(place > 0, self.words[word - 1], np.uint64(1)) if len(seeds) else seeds
        keys = _keys(seeds, before)
        order = np.lexsort((keys, seeds))
        self.item, self.word, self.place = item[order], word[order], place[order]
        self.seeds, self.begin, self.count = np.unique(seeds[order], return_index=True, return_counts=True)
        self.keys, self.key_begin, self.key_count = np.unique(keys[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, windows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, posting) of each shared seed that isn't the continuation of one a word earlier."""
        maybe = np.flatnonzero(self.sieve[(windows & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(self.seeds) or not len(maybe):
            return (np.zeros(0, np.int64),) * 2
        at = np.minimum(np.searchsorted(self.seeds, windows[maybe]), len(self.seeds) - 1)
        real = self.seeds[at] == windows[maybe]
        maybe, at = maybe[real], at[real]
        keys = _keys(windows[maybe], before[maybe])
        key = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        skip = np.where(self.keys[key] == keys, self.key_count[key], 0)
        n = self.count[at] - skip
        posting = np.repeat(self.begin[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        posting += np.repeat(skip, n) * (posting >= np.repeat(self.key_begin[key], n))
        return np.repeat(maybe, n), posting


def tile(matches: list[tuple[int, int, int]], size: int, seed_words: int) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, words) of the tiles, from all longest common stretches of both."""
    low = min(a for a, _, _ in matches)
    used_doc = np.zeros(max(a + n for a, _, n in matches) - low, bool)
    used_item = np.zeros(size, bool)
    heap = [(-n, a - low, b) for a, b, n in matches]
    heapq.heapify(heap)
    tiles, free = [], size
    while heap and free:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = np.flatnonzero(used_doc[a : a + n] | used_item[b : b + n])
        if not len(taken):
            tiles.append((a + low, b, n))
            used_doc[a : a + n] = used_item[b : b + n] = True
            free -= n
            continue
        bounds = np.r_[-1, taken, n]
        for k in np.flatnonzero(np.diff(bounds) > seed_words).tolist():
            start, end = int(bounds[k]) + 1, int(bounds[k + 1])
            heapq.heappush(heap, (start - end, a + start, b + start))
    return tiles


def leaks_of(bench: Benchmark, column: pa.Array, seed_words: int, coverage: float) -> list[tuple[int, int, int, int, list[tuple[int, int, int]]]]:
    """(text, item, words of the item, words covered, tiles) of the contaminated texts of a column."""
    words, first = words_of(column)
    windows, at = shingle_hashes(words, first, seed_words)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(at))
    start = first[:-1][owner] + np.arange(len(windows)) - at[:-1][owner]
    # at the beginning of a text there is no word before; 0 and 1 tell texts from items
    before = np.where(start > first[:-1][owner], words[start - 1], np.uint64(0)) if len(words) else windows
    window, posting = bench.hits(windows, before)
    if not len(window):
        return []
    text, item, place, spot, there = owner[window], bench.item[posting], bench.place[posting], start[window], bench.word[posting]
    # the length of each match: halving steps over the running hashes
    sums = _running(words)
    most = np.minimum(first[1:][text] - spot, bench.first[1:][item] - there)
    length = np.minimum(seed_words, bench.size[item])
    step = 1 << int(most.max()).bit_length()
    while step:
        longer = length + step
        fits = np.flatnonzero(longer <= most)
        same = _stretch(sums, spot[fits], longer[fits]) == _stretch(bench.sums, there[fits], longer[fits])
        length[fits[same]] = longer[fits[same]]
        step >>= 1
    # the words of the item that matches touch bound what tiles can cover
    order = np.lexsort((place, item, text))
    text, item, place, length, spot = text[order], item[order], place[order], length[order], (spot - first[:-1][text])[order]
    new = np.r_[True, (np.diff(text) != 0) | (np.diff(item) != 0)]
    apart = np.cumsum(new) * (int(bench.size.max()) + 1)
    ends = np.maximum.accumulate(apart + place + length)
    touched = np.maximum(0, apart + place + length - np.maximum(apart + place, np.r_[0, ends[:-1]]))
    begins = np.flatnonzero(new)
    out = []
    for k in np.flatnonzero(np.add.reduceat(touched, begins) >= coverage * bench.size[item[begins]] - 1e-9).tolist():
        rows = slice(begins[k], begins[k + 1] if k + 1 < len(begins) else len(text))
        size = int(bench.size[item[begins[k]]])
        tiles = tile(list(zip(spot[rows].tolist(), place[rows].tolist(), length[rows].tolist(), strict=True)), size, seed_words)
        covered = sum(n for _, _, n in tiles)
        if covered >= coverage * size - 1e-9:
            out.append((int(text[begins[k]]), int(item[begins[k]]), size, covered, sorted(tiles)))
    return out


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    seed_words: int = 5,
    coverage: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = 8_000_000,
) -> DataFrame:
    """doc_id, item_id, n_words (of the item), n_covered, coverage, tiles: one row for each document and item that it leaks."""
    spark = docs.sparkSession
    got = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    kinds = {c: d.schema[n].dataType.simpleString() for c, d, n in (("doc_id", got, "doc_id"), ("item_id", items, "item_id"))}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_words long, n_covered long, coverage double, tiles array<struct<in_doc:int,in_item:int,n_words:int>>"

    def passed(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # block_chars characters on average
        names = pa.array([r["item_id"] for r in rows]) if rows else pa.array([], pa.int64())
        shared = spark.sparkContext.broadcast(([r["text"] for r in rows], names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts, item_ids = shared.value
            bench = Benchmark(texts, seed_words)
            tiles_type = pa.list_(pa.struct([("in_doc", pa.int32()), ("in_item", pa.int32()), ("n_words", pa.int32())]))
            for whole in batches:
                found = defaultdict(list)
                for a, b in text_slices(whole.column(1), 1 << 19):
                    for text, item, size, covered, tiles in leaks_of(bench, whole.column(1).slice(a, b - a), seed_words, coverage):
                        for name, value in (("text", a + text), ("item", item), ("size", size), ("covered", covered), ("tiles", [{"in_doc": x, "in_item": y, "n_words": n} for x, y, n in tiles])):
                            found[name].append(value)
                if found:
                    size, covered = pa.array(found["size"], pa.int64()), pa.array(found["covered"], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [whole.column(0).take(pa.array(found["text"])), item_ids.take(pa.array(found["item"])), size, covered, pa.array([c / s for c, s in zip(found["covered"], found["size"], strict=True)]), pa.array(found["tiles"], tiles_type)],
                        ["doc_id", "item_id", "n_words", "n_covered", "coverage", "tiles"],
                    )

        return got.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [passed(k) for k in range(blocks)])
