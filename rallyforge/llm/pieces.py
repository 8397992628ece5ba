"""Problem 8: split oversized texts at natural boundaries, with an overlap.

Sizes are tokens of a public vocabulary. A text is encoded once, as a whole, and described by its *shape*: a string with
one letter for each token, which says what lies behind that token - a paragraph's end, a line's, a sentence's, a
clause's, a word's, just a character's, or no place to cut at all.

Method: bounded-quantifier regular expressions over the shape. The alternatives are ordered by the strength of the
boundary; each takes as many tokens as the limit allows (``.{a,b}P``), from half the limit up first, so that a strong
boundary near the start does not make a tiny piece, then from one token up; characters are the fallback. SQL array
functions turn the matches into ends, and looking back from each end by the overlap gives the next piece's start.
Matching runs in the JVM, a few steps for each token.

Why pieces keep the limit: they start and end where a token of the whole text does. Merges inside such a stretch happen
in the same order whether or not there is text around it, and the splitting pattern cuts it in the same way. There are
two exceptions. An apostrophe before a letter could begin a contraction: no piece starts there. And several line
ends at the end of a piece, of which the last was a token of its own before the next word, become one token when the
piece is encoded alone: it then has fewer tokens than ``n_tokens``, which counts those of the whole text.

Defined results: NULL and empty texts, and texts within a limit, give no piece for it. Pieces are numbered from 1. Every
piece but the first starts ``overlap_tokens`` tokens before the end of the previous one, up to ``SLACK`` more where that
is inside a character. Where those do not fit into the limit beside something new, it starts at the first place after that
instead, so the overlap is a few tokens smaller; the column overlap has what it is. A NULL overlap is 0, one of the limit or
more is the limit less one. Any limit from 1 is served: one that is smaller than a character's tokens cuts characters (cut
'none'), and their bytes show as replacement characters in piece. A limit that is NULL or below 1 is none. Texts are never
shortened: the pieces cover the whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyforge.llm.encode import BYTE_BPE_50K, SLICE, encoder, sent_along

#: Letters of the shape, strongest boundary first: paragraph, line, sentence, clause, word, character, before a mark, none.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER, MARK, NO_CUT = "PLSCWcmx"
NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", CLAUSE: "clause", WORD: "word", CHARACTER: "character", MARK: "mark", NO_CUT: "none"}
#: A character has at most 4 bytes, so a start moves back by 3 tokens at most, and by one more at an apostrophe.
SLACK, MOST_LIMITS = 4, 100
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: First letters of what an apostrophe takes with it (s, t, re, ve, m, ll, d).
CONTRACTED = np.array([ord(c) for c in "strvmld"], np.uint32)
#: Kinds of characters, as bits: white space, line end, what ends a sentence or a clause before white space, what ends
#: them without it, closing quotes and brackets, marks that belong to the character before them.
SPACE, LINE_END, ENDS, WIDE, PAUSES, WIDE_PAUSE, CLOSER, MARKS = (1 << i for i in range(8))


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for bit, chars in ((ENDS, ".!?…؟۔।‽"), (WIDE, "。！？．"), (PAUSES, ",;:،؛—"), (WIDE_PAUSE, "、，；："), (CLOSER, "\"')]}’”»」』）")):
        table[[ord(c) for c in chars]] |= bit
    table[SPACES] |= SPACE
    table[[10, 13, 0x85, 0x2028, 0x2029]] |= LINE_END
    table[[c for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M"]] |= MARKS
    table[[0x200D, *range(0x1F3FB, 0x1F400), *range(0xE0100, 0xE01F0)]] |= MARKS  # joiner, skin tones, variation selectors
    return table


def shapes_of(texts: list[str], token_bytes: list[np.ndarray]) -> list[tuple[str, np.ndarray]]:
    """For each text its shape, and the number of bytes up to each token's end. token_bytes: bytes of each token.

    All texts are looked at together, with a character 0 between them, as a token of its own."""
    whole_text = "\0".join(texts)
    one = np.ones(1, np.int64)
    sizes = np.concatenate([x for t in token_bytes for x in (t, one)])[:-1]
    data = np.frombuffer(whole_text.encode(), np.uint8)
    code = np.frombuffer(whole_text.encode("utf-32-le"), np.uint32)
    kind = kinds()[code]
    ends = np.cumsum(sizes)
    head = (data & 0xC0) != 0x80
    chars = np.cumsum(head, dtype=np.int32)[ends - 1]  # characters up to each token's end
    starts = np.append(head, True)[ends]  # the next byte starts a character, so the token ends with one
    n = len(code)
    at = np.arange(n, dtype=np.int32)
    space, line = (kind & SPACE) > 0, (kind & LINE_END) > 0
    solid = np.maximum.accumulate(np.where(space, -1, at))  # the last character that is no white space
    unclosed = np.maximum.accumulate(np.where(kind & CLOSER, -1, at))  # the last that is no closing quote or bracket
    lines = np.cumsum(line & ~((code == 10) & (np.append(0, code[:-1]) == 13)), dtype=np.int32)
    i = chars - 1
    following = np.minimum(chars, n - 1)
    next_space = space[following] | (chars == n)
    after_line = line[i] & ~(line[following] & (chars < n))
    since = lines[i] - np.where(solid[i] >= 0, lines[np.maximum(solid[i], 0)], 0)  # two line ends or more: an empty line
    last = kind[np.maximum(unclosed[i], 0)]
    out = np.full(len(ends), ord(CHARACTER), np.uint8)
    out[((kind[following] & MARKS) > 0) | (code[i] == 0x200D)] = ord(MARK)
    out[next_space | space[i]] = ord(WORD)
    out[(((last & PAUSES) > 0) & next_space) | ((last & WIDE_PAUSE) > 0)] = ord(CLAUSE)
    out[(((last & ENDS) > 0) & next_space) | ((last & WIDE) > 0)] = ord(SENTENCE)
    out[after_line] = ord(LINE)
    out[after_line & (since >= 2)] = ord(PARAGRAPH)
    contraction = (code[following] == 39) & np.isin(code[np.minimum(chars + 1, n - 1)], CONTRACTED)
    out[~starts | contraction] = ord(NO_CUT)
    letters = out.tobytes().decode("ascii")
    made, token, byte = [], 0, 0
    for t in token_bytes:
        upto = ends[token : token + len(t)] - byte
        made.append((letters[token : token + len(t)], upto.astype(np.int32)))
        token, byte = token + len(t) + 1, byte + int(upto[-1]) + 1
    return made


def taking(limit: int, reach: int) -> str:
    """Takes at most `limit` tokens of a shape: the rest if it fits, else up to the strongest boundary; where there is no place
    to cut at all, up to the next one within `reach` tokens, else `limit`."""
    half = max(1, limit // 2)
    upper = [f".{{{half - 1},{limit - 1}}}{c}" for c in (PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD)]
    lower = [f".{{0,{half - 1}}}{c}" for c in (PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD)]
    rest = [f".{{0,{limit - 1}}}{c}" for c in (CHARACTER, MARK)]
    beyond = [f"{NO_CUT}{{{limit},{reach - 1}}}[^{NO_CUT}]"] if reach > limit else []
    return "|".join([f".{{1,{limit}}}\\z", *upper, *lower, *rest, *beyond, f".{{1,{limit}}}"])


def running(sizes: Column) -> Column:
    """Running sums of an array, in the time of n ** 1.5: by stretches of about the root of its length, each from the sum of
    those before it. (An array grows by copying it, which is quadratic for a single stretch.)"""
    none = F.array().cast("array<int>")

    def from_(part: Column, base: Column) -> Column:
        return F.aggregate(part, none, lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.get(acc, F.size(acc) - 1), base))))

    def of(sizes: Column, span: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), ((F.size(sizes) - 1) / span).cast("int")), lambda g: F.slice(sizes, g * span + 1, span))

        def summed(parts: Column) -> Column:
            before = from_(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n)), F.lit(0))
            return _let(before, lambda sums: F.flatten(F.transform(parts, lambda p, g: from_(p, F.coalesce(F.get(sums, g - 1), F.lit(0))))))

        return _let(stretches, summed)

    return _let(sizes, lambda s: _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s))).cast("int")), lambda span: of(s, span)))


def shapes(documents: DataFrame, least: int, path: str = BYTE_BPE_50K, key: str = "doc_id") -> DataFrame:
    """key, text (UTF-8 bytes), shape, ends (bytes up to each token's end) of the texts of more than `least` tokens."""
    rows = sent_along(documents, path).select(F.col(key).alias("key"), F.col("text").alias("text")).filter(F.octet_length("text") > least)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        size = np.zeros(max(enc.vocab.rank.values()) + 1, np.int64)
        for token, r in enc.vocab.rank.items():
            size[r] = len(token)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = batch.column("text").to_pylist()
                coded = enc.encode_batch(texts)
                kept = [i for i, c in enumerate(coded) if len(c) // 4 > least]
                if kept:
                    made = shapes_of([texts[i] for i in kept], [size[np.frombuffer(coded[i], np.int32)] for i in kept])
                    some = batch.take(pa.array(kept))
                    offsets = np.concatenate([[0], np.cumsum([len(e) for _, e in made])]).astype(np.int32)
                    ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([e for _, e in made])))
                    yield pa.RecordBatch.from_arrays([some.column("key"), some.column("text").cast(pa.binary()), pa.array([s for s, _ in made]), ends], names=["key", "text", "shape", "ends"])

    return rows.mapInArrow(run, f"key {kind}, text binary, shape string, ends array<int>").withColumnRenamed("key", key)


def cut(documents: DataFrame, limits: DataFrame, path: str = BYTE_BPE_50K, key: str = "doc_id") -> DataFrame:
    """key, limit_name, piece_no, n_tokens, overlap (tokens shared with the piece before), token_start, byte_start (in UTF-8), cut
    (the boundary at its end; 'end' for the last) and piece, for each text above each limit."""
    wanted = limits.select("limit_name", "max_tokens", "overlap_tokens").filter(F.col("max_tokens") >= 1).distinct().limit(MOST_LIMITS + 1).collect()
    if len(wanted) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    least = min((r["max_tokens"] for r in wanted), default=2**31 - 1)
    described = shapes(documents, least, path, key)
    ways = []
    for r in wanted:
        most = r["max_tokens"]
        overlap = max(0, min(r["overlap_tokens"] or 0, most - 1))
        fresh = max(1, most - overlap - SLACK) if overlap else most
        pattern = f"\\A(?:{taking(most, most)})|{taking(fresh, most)}"
        matches = F.when(F.length("shape") > most, F.regexp_extract_all("shape", F.lit(pattern), F.lit(0)))
        ways.append(F.struct(F.lit(r["limit_name"]).alias("limit_name"), F.lit(overlap).alias("want"), F.lit(most).alias("most"), matches.alias("matches")))
    none = F.array().cast("array<struct<limit_name:string,want:int,most:int,matches:array<string>>>")
    taken = described.select(key, "text", "shape", "ends", F.inline(F.array(*ways) if ways else none)).filter("matches IS NOT NULL")
    # Everything about the pieces is computed inside arrays; only finished pieces are made into rows, so no text is copied
    # for each of its pieces.
    sizes = F.transform("matches", lambda m: F.length(m))
    # Bytes are cut in the time of the piece, characters in that of the whole text: so text and shape are cut as bytes.
    each = lambda data, letters, upto: F.transform(
        upto, lambda stop, i: _let(F.coalesce(F.get(upto, i - 1), F.lit(0)), lambda before: _piece(data, letters, i, before, stop))
    )
    made = _let(F.col("text"), lambda data: _let(F.col("shape").cast("binary"), lambda letters: _let(running(sizes), lambda upto: each(data, letters, upto))))
    return taken.select(key, "limit_name", made.alias("pieces")).select(key, "limit_name", F.inline("pieces"))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once (a variable of a lambda is; a column that is used there is not)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _start(letters: Column, before: Column, stop: Column) -> Column:
    """Where a piece starts that ends at `stop` and should share `want` tokens with the one that ends at `before`: in front of
    the tokens that no piece may start after, or behind them if it would be longer than `most`."""
    back, first = before - F.col("want"), stop - F.col("most")
    seen = F.least(back, F.lit(8))
    tail, head = F.substring(letters, back - seen + 1, seen).cast("string"), F.substring(letters, first, F.lit(8)).cast("string")
    wished = F.when(back > 0, back - seen + F.length(F.rtrim(tail, F.lit(NO_CUT)))).otherwise(F.lit(0))
    return F.when(wished >= first, wished).otherwise(F.least(before, first + F.length(head) - F.length(F.ltrim(head, F.lit(NO_CUT)))))


def _piece(data: Column, letters: Column, no: Column, before: Column, stop: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    kind = F.when(stop == F.size("ends"), "end").otherwise(F.element_at(names, F.substring(letters, stop, F.lit(1)).cast("string")))

    def made(start: Column) -> Column:
        a = F.coalesce(F.get("ends", start - 1), F.lit(0))
        text = F.substring(data, a + 1, F.get("ends", stop - 1) - a).cast("string")
        return F.struct(
            (no + 1).alias("piece_no"), (stop - start).alias("n_tokens"), (before - start).alias("overlap"), start.alias("token_start"), a.alias("byte_start"),
            kind.alias("cut"), text.alias("piece"),
        )

    return _let(_start(letters, before, stop), made)
