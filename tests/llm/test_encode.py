"""Problem 7 against the tokenizer itself."""

import os
import random

import pytest

from motleydex.llm.encode import VOCABULARY, Encoder, encoded, encoder

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
TEXTS = ["", " ", "Hello world", "don't we'll've I'M", "\n\n a  b\t\r\n", "<|endoftext|> is text", "मुझे तो बस", "தமிழ் 123 ４５", "x" * 3000, "क" * 2000, "\u0000퟿\U0001f600 　​", "a" + " " * 500 + "b", "!?" * 700, "é" * 999]


@pytest.fixture(scope="module")
def ours():
    return encoder(open(VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_same_ids(ours, theirs, data):
    import pyarrow.parquet as pq

    texts = TEXTS + [t or "" for t in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist()]
    rng = random.Random(4)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x900, 0xC00), rng.randrange(0x2000, 0x2100), 32])) for _ in range(60)) for _ in range(300)]
    assert [ours.encode(t) for t in texts] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_merges_take_the_leftmost_of_equal_pairs():
    ranks = {b"a": 0, b"aa": 1, b"aaa": 2}
    e = Encoder(ranks)
    assert e.piece(b"aaaaa") == [1, 2] and e.piece(b"aaaa") == [1, 1] and e.piece(b"aaa") == [2]


def test_frame(spark, ours):
    df = spark.createDataFrame([(1, "Hello", 5), (2, None, 5), (3, "", 5), (3, "Hello", 5)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, r.ids) for r in encoded(df, "doc_id").collect()) == [(1, ours.encode("Hello")), (2, []), (3, []), (3, ours.encode("Hello"))]
    assert encoded(df.limit(0), "doc_id").count() == 0
    assert sorted(r.tokens for r in encoded(df, "doc_id", sizes_only=True).collect()) == [0, 0, 1, 1]


def test_round_trip(ours):
    back = {v: k for k, v in ours.ranks.items()}
    for t in TEXTS:
        assert b"".join(back[i] for i in ours.encode(t)).decode() == t
