import base64
import random

import numpy as np
import pytest

from rallyforge.llm import encode as en

tiktoken = pytest.importorskip("tiktoken")
TEXTS = [
    None, "", " ", "\n\n", "a", " hello  world \n\n x", "don't we'll 'tis ''''s", "1234567 x12", "<|endoftext|> is text", "ünïcödé ​ é ‍", "漢字かな交じり文。テスト！", "👩‍👩‍👧‍👦🏳️‍🌈 ok",
    "\x00\x1c\x85\xa0 　 mixed\twhite \r\n ends  ", "no" * 3000, "".join(chr(0x4E00 + i * 7 % 20000) for i in range(1500)), " " * 700, "a b" * 400, "́" * 200, "x\0 y \0z",
]


@pytest.fixture(scope="module")
def ref():
    with open(en.BYTE_BPE_50K, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=en.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_library(spark, ref):
    rng = random.Random(0)
    pool = "ab c\n.'s01,é漢‍👍\t"
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in en.encode_texts(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (ref.encode_ordinary(t) if t else []), repr(t)[:80]


def test_both_trees_agree():
    vocab = en.encoder().vocab
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (1, 2, 3, 5, 8, 9, 16, 31, 33, 64)] * 3
    assert en.encode_together(pieces, vocab) == [en.encode_long(p, vocab) for p in pieces]
    assert en.encode_together([b"aaaaaaa", b""], vocab) == [en.encode_long(b"aaaaaaa", vocab), []]


def test_memory_is_bounded(ref):
    e = en.Encoder(remembered=5)
    for i in range(30):
        text = f"word{i} and{i} more{i}"
        assert e.encode(text) == ref.encode_ordinary(text)
    assert len(e.words) < 20 and len(e.pieces) < 40
    long = "x" * 5000 + "\n" + "漢" * 400
    assert e.encode(long) == ref.encode_ordinary(long) == e.encode(long)
    assert max(map(len, [*e.words, *e.pieces])) <= en.LONGEST


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert en.encode_texts(df).count() == 0
    rows = spark.createDataFrame([(1, "a", [9]), (1, "a", None)], "doc_id bigint, text string, ids array<int>")
    assert [r["ids"] for r in en.encode_texts(rows).collect()] == [[64], [64]]


def test_room_for_one_piece_of_any_length():
    class Bytes:  # no pair is a token, so every byte stays
        byte_id, pairs = np.arange(256), {}

        def pair_ranks(self, a, b):
            return np.full(len(a), en.NONE, np.int64)

    data = b"ab" * (1 << 21) + b"c"
    assert en.encode_long(data, Bytes()) == list(data)
    assert max(en.encoder(en.BYTE_BPE_50K).vocab.rank.values()) < en.NONE
