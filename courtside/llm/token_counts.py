"""Token counts: rank-synchronous merging of ragged arrays.

White space ends every pre-token of a word-level vocabulary, so a text is cut at white space and each distinct chunk of
a task is counted once. Chunks are cut further by the vocabulary's own pattern; the bytes of all new pre-tokens lie in
one flat array with the place of each. In each round every pre-token's lowest-ranked pair merges, at all its places, in
all pre-tokens at once; pre-tokens without a pair left drop out. What survives is counted. A long pre-token takes at
most as many rounds as unlike pairs merge in it.

Only documents stream through: no shuffle, and a task holds one Arrow batch and a table of at most ``max_chunks`` counts.

Defined results: a null text is empty and has no tokens. Special strings inside a text count as one token each. Rows
that repeat an id are each counted. Other columns of the input are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.vocab import Vocab, byte_letters, load_vocab

#: Characters that str.split() takes for white space and vocabularies' patterns may not.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_NONE = np.iinfo(np.int64).max


class Counter:
    def __init__(self, vocab: Vocab, max_chunks: int = 500_000):
        letters = byte_letters()
        self.first = np.array([vocab.tokens[c] for c in letters], np.int64)
        self.last = np.array([vocab.tokens[c + vocab.word_end] for c in letters], np.int64)
        self.width = max(vocab.tokens.values()) + 1
        keys = np.array([a * self.width + b for a, b, _ in vocab.merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([c for _, _, c in vocab.merges], np.int64)
        self.pattern = regex.compile(vocab.pattern)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True))) if vocab.special else None
        self.marks = {s[:2] for s in vocab.special}
        self.max_chunks = max_chunks
        self.known: dict[str, int] = {}

    def pre_tokens(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lower-cased letter by letter, without the final form
        return self.pattern.findall(chunk.lower())

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols of each (non-empty) word after all merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.ones(len(words), np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols) > 1:
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], _NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            done = lowest == _NONE
            out[owner[starts[done]]] = sizes[done]
            hit = np.r_[rank == np.repeat(lowest, sizes)[:-1], False] & np.repeat(~done, sizes)
            # of equal letters in a row every other pair merges, from the left
            run = np.flatnonzero(hit)
            if not len(run):
                break
            head = np.r_[True, np.diff(run) != 1]
            place = np.arange(len(run))
            run = run[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
            symbols[run] = self.merged[rank[run]]
            stay = np.repeat(~done, sizes)
            stay[run + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        if len(symbols) == 1:
            out[owner[0]] = 1
        return out

    def learn(self, chunks: set[str]) -> None:
        words: list[bytes] = []
        of: list[str] = []
        for chunk in chunks:
            self.known[chunk] = 0
            parts = [chunk]
            if self.special and any(m in chunk for m in self.marks):
                self.known[chunk] = len(self.special.findall(chunk))
                parts = self.special.split(chunk)
            for part in parts:
                for word in self.pre_tokens(part):
                    words.append(word.encode())
                    of.append(chunk)
        if words:
            for chunk, n in zip(of, self.survivors(words).tolist(), strict=True):
                self.known[chunk] += n

    def count(self, texts: list[str]) -> list[int]:
        cut = [regex.findall(r"\S+", t) if _SEPARATORS.search(t) else t.split() for t in texts]
        new = {c for chunks in cut for c in chunks} - self.known.keys()
        if len(self.known) + len(new) > self.max_chunks:
            self.known.clear()
            new = {c for chunks in cut for c in chunks}
        self.learn(new)
        known = self.known.__getitem__
        return [sum(map(known, chunks)) for chunks in cut]


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", max_chunks: int = 500_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens for every row."""
    vocab = docs.sparkSession.sparkContext.broadcast(load_vocab(vocab_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocab.value, max_chunks)
        for b in batches:
            texts = b.column(1)
            counts: list[int] = []
            for at in range(0, len(texts), 512):  # so many texts are cut at a time
                counts += counter.count(texts.slice(at, 512).to_pylist())
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
