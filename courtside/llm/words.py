"""Words of whole Arrow text columns as flat numpy arrays, for operators that work on word shingles."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@functools.cache
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64."""
    out = []
    for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base mod 2**64, and of its inverse."""
    return _powers_of(1 << max(16, (n - 1).bit_length()))


def text_slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about ``size`` bytes, or of one text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    begin, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > size:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, as its buffers hold them."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, drop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of the first word of each text and, last, the number of words).

    Words are runs of bytes that are not ASCII white space; with ``lower``, A-Z count as a-z. drop: for each byte value,
    whether it is left out of words (a word of such bytes only has no hash of its own and is left out too).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] |= inside[cuts]
    start = np.flatnonzero(begins)
    # a polynomial in an odd base mod 2**64, read off prefix sums; words end before the next white space or text
    values = _RANDOM[_LOWER[data] if lower else data]
    values[~inside] = 0
    kept = inside if drop is None else inside & ~drop[data]
    if drop is not None:
        values[~kept] = 0
    place = np.arange(1, n + 1) if drop is None else np.cumsum(kept, dtype=np.int64)  # place among the bytes that count
    ups, back = powers(n + 2)
    sums = np.cumsum(values * (ups[1 : n + 1] if drop is None else ups[place]), dtype=np.uint64)
    if drop is None:
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)] - 1
        ends[cuts] |= inside[cuts]
        bounds = np.r_[start[:1], np.flatnonzero(ends) + 1]
    else:
        bounds = np.r_[start, n]
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    total = sums[bounds[1:] - 1] - before
    first = np.where(start > 0, place[start - 1], 0)
    length = place[bounds[1:] - 1] - first
    # divide by the power at the word's start
    hashes = mix(total * back[first] + length.astype(np.uint64))
    counts = np.searchsorted(start, offsets)
    if drop is not None:
        real = length > 0
        counts = np.r_[0, np.cumsum(real)][counts]
        hashes = hashes[real]
    return hashes, counts.astype(np.int64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of ``size`` words of each text, index of each text's first window and, last, their number).

    A text with fewer words, but one at least, has one window of all its words.
    """
    n_words = np.diff(first)
    windows = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = np.r_[0, np.cumsum(windows)].astype(np.int64)
    owner = np.repeat(np.arange(len(n_words)), windows)
    start = first[:-1][owner] + (np.arange(at[-1]) - at[:-1][owner])
    end = first[1:][owner]
    out = np.full(len(start), size, np.uint64)
    for k in range(size):
        inside = start + k < end
        out = np.where(inside, mix(out * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(start + k, len(words) - 1)] if len(words) else out), out)
    return out, at
