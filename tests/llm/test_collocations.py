"""Phrases against counting by hand, over many small shards."""

import collections
import random
import re

import numpy as np
import pytest

from courtside.llm.collocations import Index, collocations, count_phrases, transform

DOCS = "doc_id long, text string, lang string, word string"
LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(docs):
    for _, text, lang, _ in docs:
        for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", p)
            if words:
                yield ("und" if lang is None else lang), words


def counted(docs, longest):
    f = collections.Counter()
    for lang, w in pieces(docs):
        for m in range(1, longest + 1):
            f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return f


def brute(docs, least, longest, top):
    f = counted(docs, longest)
    n = collections.Counter()
    for lang, w in pieces(docs):
        n[lang] += len(w)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    found = collections.defaultdict(list)
    for (lang, g), a in candidates.items():
        text = f" {' '.join(g)} "
        if any(lang == o and len(h) > len(g) and text in f" {' '.join(h)} " and 100 * b >= 80 * a for (o, h), b in candidates.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        found[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, rank, t.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items() for rank, (s, a, t, l, r) in enumerate(sorted(rows)[:top], 1))


def random_docs(n, seed=3):
    rnd = random.Random(seed)
    words = ["New", "york", "times", "a", "b", "ü", "İ", "x-y", " ", "don't"]
    phrases = ["New York Times", "a b a b", "of the", "x-y\tü"]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(40)):
            parts.append(rnd.choice(phrases) if rnd.random() < 0.4 else rnd.choice(words))
            parts.append(rnd.choice([" ", " ", "  ", ", ", ".\n", "\r", "\x0b", "?! "]))
        out.append((i, "".join(parts), rnd.choice(["en", "en", "en", "de", None, "und"]), "clash"))
    return out


@pytest.mark.parametrize(("least", "longest", "top"), [(5, 4, 10), (3, 2, 2000), (4, 5, 7)])
def test_against_counting_by_hand(spark, least, longest, top):
    docs = random_docs(150) + [(1, None, None, None), (2, "", "en", ""), (3, " \t\n.", "fr", ""), (4, "one", "fr", "")] + [(5, "Same row, same row", "es", "")] * 6
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    got = sorted(tuple(r) for r in collocations(frame, least, longest, top=top, shard_words=60).collect())
    assert got == brute(docs, least, longest, top)


def test_all_frequent_phrases_and_no_others(spark):
    docs = random_docs(120, 8)
    _, tables = count_phrases(spark.createDataFrame(docs, DOCS), 4, 4, shard_words=100)
    want = collections.Counter(len(g) for (_, g), a in counted(docs, 4).items() if a >= 4)
    assert [t.count() for t in tables] == [want[m] for m in (1, 2, 3, 4)]


def test_no_texts_and_a_long_one(spark):
    assert collocations(spark.createDataFrame([], DOCS)).isEmpty()
    assert collocations(spark.createDataFrame([(1, None, None, None)], DOCS)).isEmpty()
    got = collocations(spark.createDataFrame([(1, "a " * 300_000, "en", "")], DOCS), shard_words=1000).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("a a a a", 299_997, 300_000, 299_998, 300_000, 2_000_000 * 299_997 // 599_998)]


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from courtside.llm.collocations import _scored

    big = 10**17
    one = spark.createDataFrame([(1, "en", "a", 3 * big), (2, "en", "b", 2 * big + 1)], "id long, lang string, word string, f long")
    two = spark.createDataFrame([(3, 1, 2, 2 * big)], "id long, p long, s long, f long")
    row = _scored([one, two], 80)[0].select(F.col("score")).first()
    assert row.score == 2_000_000 * 2 * big // (5 * big + 1)


def test_both_intervals_of_every_extension():
    rnd = np.random.default_rng(2)
    symbols = np.r_[0, rnd.integers(0, 5, 400), 0]
    index = Index.of(symbols, 4)
    assert sorted(transform(symbols, 4)) == sorted(symbols)
    counts = np.bincount(symbols)
    lo, n = (np.cumsum(counts) - counts)[1:], counts[1:]
    phrases, state = [(c,) for c in range(1, len(counts))], (lo, lo, n)
    for length in (2, 3, 4):
        left = length % 2 == 0
        owner, symbol, *state = index.grown(*state, left)
        phrases = [(s, *phrases[o]) if left else (*phrases[o], s) for o, s in zip(owner.tolist(), symbol.tolist(), strict=True)]
        want = collections.Counter(tuple(symbols[i : i + length].tolist()) for i in range(len(symbols) - length + 1))
        assert {p: int(k) for p, k in zip(phrases, state[2], strict=True)} == {p: k for p, k in want.items() if 0 not in p}
