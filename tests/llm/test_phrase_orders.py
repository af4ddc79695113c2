"""Orders of a phrase index against sorting by hand, in both ways of sorting, and what shards tell of their words."""

import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from courtside.llm import collocations as C


@pytest.mark.parametrize("most", [50, 1 << 62])
def test_places_in_the_order_of_keys(most):
    key = np.random.default_rng(4).integers(0, 50, 300)
    order, got = C._ordered(key, most)
    assert order.tolist() == sorted(range(300), key=lambda i: (key[i], i)) and got.tolist() == sorted(key.tolist())
    assert [x.tolist() for x in C._ordered(np.zeros(0, np.int64), most)] == [[], []]


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 7])
def test_transform_is_in_the_order_of_so_many_symbols(depth):
    x = np.r_[0, np.random.default_rng(depth).integers(0, 4, 200), 0]
    known = 1
    while known < depth:
        known *= 2
    order = sorted(range(len(x)), key=lambda i: x[i : i + known].tolist())
    blocks, got = {}, C.transform(x, depth).tolist()
    for at, i in enumerate(order):  # the symbols before suffixes that begin alike may be in any order
        blocks.setdefault(tuple(x[i : i + known].tolist()), ([], []))[0].append(int(x[i - 1]))
        blocks[tuple(x[i : i + known].tolist())][1].append(got[at])
    assert all(sorted(a) == sorted(b) for a, b in blocks.values())


def test_words_are_dealt_in_runs_and_their_places_stay_with_the_shard(monkeypatch):
    monkeypatch.setattr(C.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    texts = pa.record_batch([pa.array(["en", "de", "en"]), pa.array(["a b c a, d", "b b é", "z a b"])], ["lang", "text"])
    shards = list(C._shards(iter([texts]), 1000, 4))
    row = shards[0].to_pylist()[0]
    hashes = [zlib.crc32(w.encode()) for w in row["words"]]
    assert hashes == sorted(hashes)
    proposed = [r for batch in C._word_proposals(iter(shards), 3) for r in batch.to_pylist()]
    assert "lo" not in proposed[0]
    told = []
    for r in proposed:
        words = pa.decompress(r["words"], r["size"], "zstd", asbytes=True).decode().split("\n")
        assert words == row["words"][r["first"] : r["first"] + len(words)]
        told += words
    assert told == row["words"]
