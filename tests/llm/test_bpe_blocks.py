"""BPE by blocks: every distinct pre-token of a block is looked up once, whatever pieces hold it."""

import pickle

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from courtside.llm.bpe import Encoder, _blocks, encode
from courtside.llm.vocab import load_vocab

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_a_block_looks_up_a_pre_token_once():
    encoder, library, met = Encoder(load_vocab(PATH)), Tokenizer.from_file(PATH), []
    texts = [" ".join(f"ab{i}" for i in range(120_000)), "ab1 ab2", "by\0hand ab3", "", "é\x85 ab"]
    look_up = encoder.encode_words
    encoder.encode_words = lambda words: met.extend(words) or look_up(words)
    encoder.encode(texts[:1])
    assert met.count(b" ab") == 1
    got = encoder.encode(texts)
    assert [memoryview(g).cast("i").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_an_encoder_travels_and_decodes_whole_columns():
    encoder = pickle.loads(pickle.dumps(Encoder(load_vocab(PATH), max_pieces=4)))
    texts = ["x y z  <|endoftext|> q", "", "日本 y y", "퟿\n\n a  "] * 3
    for _ in range(3):
        ids = encoder.encode_array(pa.array(texts))
        assert encoder.decode_array(ids).to_pylist() == texts
    assert encoder.decode_array(pa.array([[encoder.ids["日".encode()[:1]]], []], pa.list_(pa.int32()))).to_pylist() == ["�", ""]


def test_blocks_are_bounded_by_bytes_and_lose_no_row(spark):
    texts = ["x" * 900, "", "y" * 5000, "é" * 300, "z", ""] * 5
    blocks = list(_blocks(pa.record_batch([list(range(30)), texts], ["doc_id", "text"]), 1000))
    assert [i for b in blocks for i in b.column(0).to_pylist()] == list(range(30))
    assert all(sum(len(t.encode()) for t in b.column(1).to_pylist()) <= 1000 or sum(map(bool, b.column(1).to_pylist())) == 1 for b in blocks)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small, whole = (sorted(map(tuple, encode(docs, PATH, decoded=True, block_bytes=n, max_pieces=m).collect())) for n, m in ((500, 2), (6_000_000, 200_000)))
    assert small == whole and [r[2] for r in small] == texts
