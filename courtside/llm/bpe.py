"""BPE encoding and decoding: prefix-sharing traversal of a trie of the distinct pre-tokens.

A sequence of tokens is an encoding just if each two neighbours stay side by side when their bytes are merged anew; so
the encoding of a string is told by its last token and the encoding of the string before it. The distinct pre-tokens of
a batch form a trie, visited depth first (sorted words share the path to their common prefix with the word before). A
node's state is the last token of the encoding of its prefix, computed once for all words below it: of the tokens that
end there, the one that stays beside the last token of the prefix where it starts. A word's ids are read off by
stepping back over those states.

Texts are cut at single spaces into pieces whose encodings don't depend on each other. Arrow cuts some MB of texts at a
time and numbers their distinct pieces; only those are cut into pre-tokens and only the distinct pre-tokens are looked up
in the trie, so that Python meets each of them once for all its occurrences. The encodings of pieces of up to
``max_chars`` characters are kept in a worker for the tasks of one call, in two generations of half of ``max_pieces`` each
and what one block adds. Only documents stream through: no shuffle, one Arrow batch at a time. Of a very long word, each
place tries just the lengths of tokens that end in the three bytes before it.

Defined results: a null text is empty and has no ids. Special strings inside a text become their ids. Decoding joins the
bytes of all ids and replaces what isn't UTF-8; ids that the vocabulary lacks, and nulls, are left out. Rows that repeat
an id are each encoded. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.vocab import Vocab, byte_letters, load_vocab

#: Fixed value: the published pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What cuts pieces inside Arrow (texts that hold it are cut by Python), and the space between pieces.
CUT, SPACE = "\0", " "
_WHITE = [c for c in map(chr, range(0x3100)) if regex.match(r"\s", c)]
_CLASS, _OTHER = ("[" + "".join(f"\\x{{{ord(c):x}}}" for c in _WHITE if c != but) + "]" for but in ("", SPACE))


class Encoder:
    def __init__(self, vocab: Vocab, max_pieces: int = 200_000, max_chars: int = 64):
        code = {c: b for b, c in enumerate(byte_letters())}
        self.ids = {bytes(code[c] for c in t): i for t, i in vocab.tokens.items()}
        self.spelling = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in vocab.special.items()}
        self.longest = max(map(len, self.ids))
        lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) >= 3:
                lengths.setdefault(t[-3:], {1, 2}).add(len(t))
        self.lengths = {t: tuple(sorted(n, reverse=True)) for t, n in lengths.items()}
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(vocab.merges)}
        self.parts = {c: (r, a, b) for r, (a, b, c) in enumerate(vocab.merges)}
        self.beside: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.special_ids = vocab.special
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True)) + ")") if vocab.special else None
        self.marks = {s[:2] for s in vocab.special}
        #: A space next to other white space or at an end: no piece begins there.
        self.entangled = regex.compile(r" \s|[^\S ] |^ | $")
        marks = "".join(f"|{''.join(f'\\x{{{ord(c):x}}}' for c in m)}" for m in sorted(self.marks))
        #: The same for Arrow; and texts with special strings, or with what cuts pieces there.
        self.by_hand = f" {_CLASS}|{_OTHER} |^ | $|\\x{{0}}{marks}"
        self.between = regex.compile(r"(?<=\S) (?=\S)")
        self.max_pieces, self.max_chars = max_pieces, max_chars
        top = max(self.spelling, default=-1) + 1
        self.bytes_of = pa.array([self.spelling.get(i, b"") for i in range(top)], pa.large_binary())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; what is met again moves on

    def stay(self, a: int, b: int) -> bool:
        """Whether no merge crosses from token a to token b: undo the later of the two facing merges, again and again."""
        limit = len(self.rank)
        while True:
            if self.rank.get((a, b), limit) < limit:
                return False
            made_a, _, right = self.parts.get(a, (-1, 0, 0))
            made_b, left, _ = self.parts.get(b, (-1, 0, 0))
            if made_a > made_b:
                limit, a = made_a, right
            elif made_b >= 0:
                limit, b = made_b + 1, left  # of equal merges the left one comes first
            else:
                return True

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words that are in order, as int32 bytes."""
        out: list[bytes] = []
        path, last, start = b"", [-1], [0]  # of the path's prefixes: the last token and where it starts
        ids, beside, longest, lengths = self.ids, self.beside, self.longest, self.lengths
        for word in words:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if end <= longest and (token := ids.get(word[:end])) is not None:
                    last.append(token)
                    start.append(0)
                    continue
                for n in lengths.get(word[end - 3 : end], (2, 1)) if end > 2 else (1,):
                    at = end - n
                    if at <= 0:
                        continue
                    token = ids.get(word[at:end])
                    if token is not None:
                        pair = last[at] << 20 | token
                        fits = beside.get(pair)
                        if fits is None:
                            fits = beside[pair] = self.stay(last[at], token)
                        if fits:
                            last.append(token)
                            start.append(at)
                            break
            path = word
            found, at = [], len(word)
            while at:
                found.append(last[at])
                at = start[at]
            found.reverse()
            out.append(array("i", found).tobytes())
        if len(beside) > 300_000:
            beside.clear()
        return out

    def pre_tokens(self, text: str) -> list[bytes | int]:
        parts = self.special.split(text) if self.special and any(m in text for m in self.marks) else [text]
        out: list[bytes | int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special_ids[part])
            else:
                out += [w.encode() for w in self.pattern.findall(part)]
        return out

    def pieces(self, text: str) -> list[str]:
        """Strings that, joined, are the text, and that are encoded alone as they are in it."""
        if not text:
            return []
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            if len(parts) > 1:
                return [x for k, part in enumerate(parts) for x in ([part] if k % 2 else self.pieces(part))]
        first, *rest = self.between.split(text) if self.entangled.search(text) else text.split(" ")
        return [first, *[f" {x}" for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        return [x.values.to_numpy().tobytes() for x in self.encode_array(pa.array(texts, pa.string()))]

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; none are null."""
        by_hand = pc.match_substring_regex(texts, self.by_hand).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~by_hand)), SPACE, CUT + SPACE), CUT)
        if by_hand.any():
            cut = pa.concat_arrays([cut, pa.array([self.pieces(t) for t in texts.filter(pa.array(by_hand)).to_pylist()], pa.list_(pa.string()))])
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        often = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)) > 1
        ids = _lists(self._encoded(coded.dictionary.to_pylist(), often.tolist())).take(coded.indices)
        out = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[ends]), ids.values)
        if by_hand.any():
            out = out.take(pa.array(np.argsort(np.argsort(by_hand, kind="stable"))))
        return out

    def _encoded(self, pieces: list[str], often: list[bool]) -> list[bytes]:
        """The ids of distinct pieces, as int32 bytes; those met often are kept."""
        if len(self.known) > self.max_pieces // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out = [known.get(p) or older.get(p) for p in pieces]
        new = [p for p, ids in zip(pieces, out, strict=True) if ids is None]
        # what begins with its only space can be cut together: no pre-token reaches over such a space
        alone = [not p.startswith(SPACE) or p.count(SPACE) > 1 or p[-1].isspace() for p in new]
        found = dict(self._cut_together([p for p, x in zip(new, alone, strict=True) if not x]))
        split = {p: self.pre_tokens(p) for p, x in zip(new, alone, strict=True) if x}
        words = sorted({w for ws in split.values() for w in ws if isinstance(w, bytes)})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        for p, ws in split.items():
            found[p] = b"".join([array("i", [w]).tobytes() if isinstance(w, int) else ids[w] for w in ws])
        out = [found[p] if e is None else e for p, e in zip(pieces, out, strict=True)]
        known.update((p, e) for p, e, more in zip(pieces, out, often, strict=True) if more and len(p) <= self.max_chars)
        return out

    def _cut_together(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        tokens = pa.array(self.pattern.findall("".join(pieces)), pa.string())
        first = np.flatnonzero(pc.starts_with(tokens, SPACE).to_numpy(zero_copy_only=False))
        coded = tokens.dictionary_encode()
        words = coded.dictionary.cast(pa.binary())
        order = pc.sort_indices(words)
        ids = _lists(self.encode_words(words.take(order).to_pylist()))
        ids = ids.take(pa.array(np.argsort(order.to_numpy()))).take(coded.indices)
        at = (4 * ids.offsets.to_numpy()[np.r_[first, len(tokens)]]).tolist()
        raw = ids.values.to_numpy().tobytes()
        return zip(pieces, [raw[a:b] for a, b in itertools.pairwise(at)], strict=True)

    def decode_array(self, rows: pa.ListArray) -> pa.Array:
        """The texts of rows of ids of the vocabulary."""
        spelled = self.bytes_of.take(rows.values)
        ends = np.frombuffer(spelled.buffers()[1], np.int64)[rows.offsets.to_numpy()] if len(spelled) else np.zeros(len(rows) + 1, np.int64)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), spelled.buffers()[2]])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            return pa.array([x.as_buffer().to_pybytes().decode("utf-8", "replace") for x in raw], pa.string())

    def decode(self, ids: list[int | None]) -> str:
        get = self.spelling.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def _lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(e) // 4 for e in encoded])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def _slices(b: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _blocks(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with up to so many bytes of text (second column), or one row."""
    sizes = pc.binary_length(b.column(1)).to_numpy().tolist()
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield b.slice(at, k - at)
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield b.slice(at)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, max_pieces: int = 200_000, block_bytes: int = 6_000_000) -> DataFrame:
    """doc_id, ids array<int> for every row; with ``decoded`` also the text that the ids decode to, in the same pass.

    Up to ``block_bytes`` of texts are encoded at a time: smaller blocks take less memory and meet fewer repeats.
    """
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder(load_vocab(vocab_path), max_pieces))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder.value  # one for all tasks of a worker, with the pieces that it keeps
        for whole in batches:
            for b in _blocks(whole, block_bytes):
                ids = mine.encode_array(b.column(1))
                columns = [b.column(0), ids]
                if decoded:
                    columns.append(mine.decode_array(ids))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for every row of ids; null ids give an empty text."""
    vocab = rows.sparkSession.sparkContext.broadcast(load_vocab(vocab_path))
    got = rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        for whole in batches:
            for b in _slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return got.mapInArrow(run, f"doc_id {got.schema['doc_id'].dataType.simpleString()}, text string")
