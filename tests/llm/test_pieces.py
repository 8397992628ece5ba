import base64
import random

import pytest

from rallyforge.llm import encode as en
from rallyforge.llm import pieces as pc

tiktoken = pytest.importorskip("tiktoken")
LIMITS = "limit_name string, max_tokens int, overlap_tokens int"


@pytest.fixture(scope="module")
def ref():
    with open(en.BYTE_BPE_50K, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=en.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(spark, texts, limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {}
    for r in pc.cut(docs, spark.createDataFrame(limits, LIMITS)).orderBy("doc_id", "limit_name", "piece_no").collect():
        out.setdefault((r["doc_id"], r["limit_name"]), []).append(r)
    return out


def test_limits_overlaps_and_round_trip(spark, ref):
    rng = random.Random(0)
    words = ["serve", "boast", "don't", "漢字", "👩‍👩‍👧", "éá", "'''s", "12345", "ＡＢ。", "x" * 90, "\n\n", ". ", ", ", "\r\n", "  "]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(40)] + ["漢" * 900, "ab" * 2000, "́" * 300, "'" * 500 + "s", "", None, "short"]
    limits = [("a", 32, 4), ("b", 100, 10), ("c", 64, None), ("d", 40, 39)]
    out = cut(spark, texts, limits)
    for i, text in enumerate(texts):
        for name, most, overlap in limits:
            got = out.get((i, name), [])
            if not text or len(ref.encode_ordinary(text)) <= most:
                assert got == []
                continue
            data, end = text.encode(), 0
            wanted = overlap or 0
            for k, r in enumerate(got):
                piece = r["piece"].encode()
                assert r["piece_no"] == k + 1 and r["n_tokens"] <= most
                assert len(ref.encode_ordinary(r["piece"])) <= most
                assert data[r["byte_start"] : r["byte_start"] + len(piece)] == piece and r["byte_start"] <= end
                if k and got[k - 1]["token_start"] + got[k - 1]["n_tokens"] > wanted:
                    # a few tokens less only where those of a character would not fit beside something new
                    assert wanted - (pc.SLACK if wanted + pc.SLACK >= most else 0) <= r["overlap"] <= wanted + pc.SLACK
                end = r["byte_start"] + len(piece)
            assert end == len(data) and got[-1]["cut"] == "end"


def test_strongest_boundary_wins(spark):
    sentence = "The ball went to the back. "
    para = (sentence * 3).strip() + "\n\n"
    out = cut(spark, [para * 8, sentence * 40, "word " * 200, "漢" * 300], [("a", 40, 0)])
    assert {r["cut"] for r in out[0, "a"][:-1]} == {"paragraph"}
    assert {r["cut"] for r in out[1, "a"][:-1]} == {"sentence"}
    assert {r["cut"] for r in out[2, "a"][:-1]} == {"word"}
    assert {r["cut"] for r in out[3, "a"][:-1]} == {"character"}


def test_no_limits_and_empty_table(spark):
    assert cut(spark, ["a b c"], [("tiny", 3, 1), ("none", None, 1)]) == {}
    assert cut(spark, [], [("a", 32, 4)]) == {}


@pytest.mark.parametrize("most", [1, 2, 3, 4, 7, 15, 16])
def test_small_limits_and_every_overlap(spark, ref, most):
    texts = ["serve to the back, then boast. " * 6, "漢字👩‍👩‍👧 don't é" * 9, "'" * 40 + "s", "x"]
    limits = [(f"o{o}", most, o) for o in sorted({0, 1, most // 2, most - 1, most + 3})]
    out = cut(spark, texts, limits)
    for i, text in enumerate(texts):
        total = len(ref.encode_ordinary(text))
        for name, _, overlap in limits:
            got, end = out.get((i, name), []), 0
            assert bool(got) == (total > most)
            for r in got:
                assert 1 <= r["n_tokens"] <= most and r["token_start"] + r["overlap"] == end  # no token is left out
                assert r["token_start"] + r["n_tokens"] > end  # every piece has something new
                end = r["token_start"] + r["n_tokens"]
                if r["token_start"] > 0 and i == 0:  # a token here never ends inside a character
                    assert r["overlap"] == min(overlap, most - 1)
            assert not got or (end == total and got[-1]["cut"] == "end")
            if got and most >= 7:  # room for any character, so none is cut
                assert "\ufffd" not in "".join(r["piece"] for r in got) and all(r["cut"] != "none" for r in got)


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(9) for _ in range(n)],) for n in (1, 2, 3, 10, 257)]
    for v, sums in spark.createDataFrame(rows, "v array<int>").withColumn("s", pc.running(pc.F.col("v"))).collect():
        assert sums == [sum(v[: k + 1]) for k in range(len(v))]
