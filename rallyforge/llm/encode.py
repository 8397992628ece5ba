"""Problem 6: encode every text with a public byte-level BPE vocabulary.

Method: the merges of a piece are found with a segment tree over its byte positions. A leaf holds the rank of the pair
that starts there (none: a large number), an inner node the leftmost minimum of its two halves; so the root names the
next merge, and each merge updates three leaves - the merged symbol's pair, its left neighbour's, the vanished symbol's
- and their paths to the root. Pieces are the matches of the vocabulary's splitting pattern. Short pieces are encoded
many at a time (one numpy step does the next merge of all of them), long ones by a scalar tree, O(n log n) in the
piece's bytes: a text with hardly a space is no special case.

Scale: no shuffle; each Arrow batch is encoded where it is read. Words are remembered in a table of bounded size for
each Python worker, so a frequent word costs one lookup. The vocabulary file is read by each worker from its path (a
parameter), or, where an executor's machine does not have it, from the copy that the driver has sent along; nothing about the
corpus is gathered anywhere.

Defined results: NULL, empty text: an empty list. Names of special tokens in a text are ordinary text. Equal texts get
equal ids.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by a worker; beyond, the table starts anew.
REMEMBERED = 400_000
#: Longest word, in characters, that is remembered.
LONGEST = 100
#: Longest piece, in bytes, that is encoded together with others.
TOGETHER = 64
#: Above every rank (pairs are packed into 20 bits each); times the size of a tree it stays below 2**63 for any text.
NONE = np.int64(1) << 21
#: Marks each space with no white space beside it and not at an end of the text (white space: what str.isspace says).
SPACE_BETWEEN = re.compile(r" (?=\S)(?<=\S )").sub
#: Texts that are encoded together.
SLICE = 512


class Vocabulary:
    """Ranks of byte strings; pair_rank of two ids is the rank of their joined bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = r
        self.pairs = pairs
        # open addressing for the numpy path: a table of keys and one of ranks
        keys = np.fromiter(pairs, np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            s = slot[todo]
            free = self.keys[s] < 0
            _, first = np.unique(np.where(free, s, -1 - np.arange(len(s))), return_index=True)
            first = first[free[first]]
            self.keys[s[first]], self.ranks[s[first]] = keys[todo[first]], ranks[todo[first]]
            placed = np.zeros(len(todo), bool)
            placed[first] = True
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it is no token or a side is missing (-1)."""
        keys = np.where((a >= 0) & (b >= 0), (a << 20) | b, -2)
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out


def encode_long(data: bytes, vocab: Vocabulary) -> list[int]:
    """One piece with a scalar segment tree. A node holds rank * size + position, so the minimum is the leftmost one."""
    n = len(data)
    ids = vocab.byte_id[np.frombuffer(data, np.uint8)]
    size = 1 << max(1, (n - 1).bit_length())
    none = int(NONE) * size
    leaf = np.full(size, none, np.int64)
    if n > 1:
        leaf[: n - 1] = vocab.pair_ranks(ids[:-1], ids[1:]) * size + np.arange(n - 1)
    levels = [leaf]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(axis=1))
    tree = np.concatenate([[none], *levels[::-1]]).tolist()  # the root at 1, leaf i at size + i
    sym, before, after = ids.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
    pairs, mask = vocab.pairs, size - 1
    while True:
        best = tree[1]
        if best >= none:
            break
        i, r = best & mask, best // size
        j = after[i]
        k, h = after[j], before[i]
        sym[i], sym[j], after[i] = r, -1, k
        if k >= 0:
            before[k] = i
        right = pairs.get((r << 20) | sym[k]) if k >= 0 else None
        left = pairs.get((sym[h] << 20) | r) if h >= 0 else None
        for at, rank in ((i, right), (j, None), (h, left)):
            if at < 0:
                continue
            node = size + at
            tree[node] = none if rank is None else rank * size + at
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                value = a if a < b else b
                if tree[node] == value:
                    break  # the path above cannot change either
                tree[node] = value
                node >>= 1
    return [s for s in sym if s >= 0]


def encode_together(pieces: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Pieces of at most TOGETHER bytes in lockstep: trees of one size lie beside each other in one array, and each
    numpy step does the next merge of every piece that still has one."""
    out: list = [None] * len(pieces)
    length = np.array([len(p) for p in pieces])
    size = 2
    lower = 0
    while lower < TOGETHER:
        which = np.flatnonzero((length > lower) & (length <= size))
        if len(which):
            for w in np.array_split(which, -(-len(which) // max(1, 65_536 // size))):
                for p, ids in zip(w.tolist(), _lockstep([pieces[p] for p in w.tolist()], length[w], size, vocab)):
                    out[p] = ids
        lower, size = size, size * 2
    for p in np.flatnonzero(length == 0).tolist():
        out[p] = []
    return out


def _lockstep(pieces: list[bytes], length: np.ndarray, size: int, vocab: Vocabulary) -> list[list[int]]:
    m, span = len(pieces), np.arange(size)
    inside = span[None, :] < length[:, None]
    sym = np.full((m, size), -1, np.int64)
    sym[inside] = vocab.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.where(span[None, :] + 1 < length[:, None], span[None, :] + 1, -1)
    before = np.broadcast_to(span - 1, (m, size)).copy()
    tree = np.full((m, 2 * size), int(NONE) * size, np.int64)
    ranks = vocab.pair_ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(m, size - 1)
    tree[:, size : 2 * size - 1] = ranks * size + span[:-1]
    tree[:, size : 2 * size - 1][ranks == NONE] = int(NONE) * size
    width = size
    while width > 1:
        width //= 2
        np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2], out=tree[:, width : 2 * width])
    run = np.flatnonzero(tree[:, 1] < int(NONE) * size)
    depth = size.bit_length() - 1
    while len(run):
        best = tree[run, 1]
        i, r = best & (size - 1), best // size
        j = after[run, i]
        k, h = after[run, j], before[run, i]
        sym[run, i], sym[run, j], after[run, i] = r, -1, k
        some = k >= 0
        before[run[some], k[some]] = i[some]
        to_right = np.where(some, sym[run, k], -1)
        to_left = np.where(h >= 0, sym[run, h], -1)
        rank = vocab.pair_ranks(np.concatenate([r, to_left]), np.concatenate([to_right, r]))
        value = np.where(rank == NONE, int(NONE) * size, rank * size + np.concatenate([i, h]))
        tree[run, size + j] = int(NONE) * size
        tree[run, size + i] = value[: len(run)]
        has = h >= 0
        tree[run[has], size + h[has]] = value[len(run) :][has]
        rows = np.concatenate([run, run, run[has]])
        node = np.concatenate([size + i, size + j, size + h[has]])
        for _ in range(depth):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        run = run[tree[run, 1] < int(NONE) * size]
    flat, kept = sym[sym >= 0].tolist(), (sym >= 0).sum(axis=1)
    ends = np.cumsum(kept).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Encoder:
    """Texts to ids, with a bounded memory of words and pieces. Ids are kept as the bytes of 32-bit integers, so a text's
    list is one join of remembered bytes."""

    def __init__(self, path: str = BYTE_BPE_50K, pattern: str = PATTERN, remembered: int = REMEMBERED):
        import regex

        self.vocab, self.split, self.remembered = Vocabulary(path), regex.compile(pattern).findall, remembered
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces, remembered ones and new ones."""
        if len(self.pieces) > self.remembered:
            self.pieces.clear()
        known = self.pieces
        new = [p for p in pieces if p not in known]
        data = [p.encode() for p in new]
        short = [k for k, d in enumerate(data) if len(d) <= TOGETHER]
        for k, ids in zip(short, encode_together([data[k] for k in short], self.vocab)):
            known[new[k]] = np.array(ids, np.int32).tobytes()
        for k, d in enumerate(data):
            if len(d) > TOGETHER:
                known[new[k]] = np.array(encode_long(d, self.vocab), np.int32).tobytes()
        return known

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes. A single space between two other characters always starts a piece. So a text
        is cut at such spaces into words, each of which is split and encoded on its own and remembered; only stretches
        around other white space take the pattern over more than one word."""
        if len(self.words) > self.remembered:
            self.words = {"": b""}
        words = self.words
        parts = [self.units(text) if text else [""] for text in texts]
        new: set[str] = set()
        for units in parts:
            new |= set(units).difference(words)
        if new:
            split = {u: self.split(u) for u in new}
            pieces = self._learn({p for ps in split.values() for p in ps})
            for u, ps in split.items():
                words[u] = pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps])
            for p in [p for u, ps in split.items() if len(u) > LONGEST for p in ps if len(p) > LONGEST]:
                pieces.pop(p, None)
        get = words.__getitem__
        coded = [b"".join(map(get, units)) for units in parts]
        for u in new:  # long stretches are rare and large: they are not remembered
            if len(u) > LONGEST:
                del words[u]
        return coded

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], np.int32).tolist()

    @staticmethod
    def units(text: str) -> list[str]:
        """Stretches of the text between which the pattern always cuts; their concatenation is the text."""
        if "\0" not in text:
            return SPACE_BETWEEN("\0 ", text).split("\0")
        words = text.split(" ")
        out = [words[0]]
        add = out.append
        for w in words[1:]:
            # cut before this space only if neither side of it is white space or the text's end
            last = out[-1]
            if w and last and not w[0].isspace() and not last[-1].isspace():
                add(" " + w)
            else:
                out[-1] = last + " " + w
        return out


@lru_cache(maxsize=4)
def encoder(path: str = BYTE_BPE_50K) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    from pyspark import SparkFiles

    return Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def sent_along(df: DataFrame, path: str) -> DataFrame:
    """df as it is; on a cluster, executors can get the driver's copy of the vocabulary from now on."""
    sc = df.sparkSession.sparkContext
    if not sc.master.startswith("local") and os.path.exists(path) and not any(f.endswith("/" + os.path.basename(path)) for f in sc.listFiles):
        sc.addFile(path)
    return df


def encode_texts(documents: DataFrame, path: str = BYTE_BPE_50K, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The kept columns and ids, an array of integers; ids is never NULL."""
    rows = sent_along(documents, path).select(*keep, F.col(text).alias("__text"))
    schema = StructType([*rows.select(*keep).schema.fields, StructField(ids, ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                coded = enc.encode_batch(batch.column("__text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], names=[*keep, ids])

    return rows.mapInArrow(run, schema)
