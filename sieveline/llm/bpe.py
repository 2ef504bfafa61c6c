"""Byte-level BPE by ranks: a fold of ranked merges over the bytes of distinct words; decoding joins binary pieces.

A word's bytes are its first pieces; the neighbouring pair of least rank is merged again and again until no pair has a rank. There are two
forms of the fold. `fold` is a Column of Spark's higher-order functions with a literal rank map (an array of small maps, reached by the
hash of the bytes, as a single map is searched from end to end). `Encoder` runs the same fold in Python workers, once for each distinct
word a worker has met lately, and is what `encode` uses: over whole corpora the Column form took about twice the CPU time that the check
tool allows and too much executor memory (figures in the README). Both give the ids of the rank file's own library. No rows are exchanged.

The fold looks at all pairs for every merge, so `Encoder` merges words over `LONG` bytes (runs without a break) with a heap instead.

Defined results: null and empty texts have no tokens; repeated rows and words repeat their ids; of equal ranks the leftmost pair is merged
first; texts of any length are encoded whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.shared import table

BATCH_CHARS = 8_000_000
LONG = 64
BUCKETS = 32_768
NO_RANK = 2_147_483_647


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


# ---- the fold; bytes are held as strings of the characters U+0000 to U+00FF, one a byte


def _bucket_of(s: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(s.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: array of maps from bytes to rank, by the hash that xxhash64 gives them."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for k, v in ranks.items():
        s = k.decode("latin-1")
        maps[_bucket_of(s)][s] = v
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def _rank(literal: Column, piece: Column) -> Column:
    return F.coalesce(F.try_element_at(F.get(literal, F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")), piece), F.lit(NO_RANK))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def fold(word: Column, literal: Column) -> Column:
    """array<int>: ids of one word of at least one byte."""
    pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda a, b: _rank(literal, F.concat(a, b)))
    # ranks of neighbours, with a sentinel at both ends: the pair of ranks[a] is pieces[a - 1] and pieces[a], counted from 1
    none, outer = F.array().cast("array<int>"), F.array(F.lit(NO_RANK))
    start = _let(F.split(word, ""), lambda p: F.struct(p.alias("p"), F.concat(outer, pairs(p), outer).alias("r")))

    def merge(p: Column, r: Column, a: Column, merged: Column) -> Column:
        beside = F.array(_rank(literal, F.concat(F.get(p, a - 3), merged)), _rank(literal, F.concat(merged, F.get(p, a))))
        new_p = F.concat(F.slice(p, F.lit(1), a - 2), F.array(merged), F.slice(p, a + 1, F.size(p)))
        return F.struct(new_p.alias("p"), F.concat(F.slice(r, F.lit(1), a - 2), beside, F.slice(r, a + 2, F.size(r))).alias("r"))

    def step(acc: Column, _: Column) -> Column:
        p, r = acc["p"], acc["r"]
        at_least = lambda a: F.when(F.get(r, a - 1) < NO_RANK, _let(F.concat(F.get(p, a - 2), F.get(p, a - 1)), lambda m: merge(p, r, a, m))).otherwise(acc)
        return _let(F.array_position(r, F.array_min(r)).cast("int"), at_least)

    merges = F.when(F.length(word) > 1, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(none)
    merged = F.aggregate(merges, start, step, lambda acc: F.transform(acc["p"], lambda x: _rank(literal, x)))
    return _let(_rank(literal, word), lambda whole: F.when(whole < NO_RANK, F.array(whole)).otherwise(merged))


def fold_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """array<array<int>>: ids of each word of an array of words, bytes as characters; the rank map stands in the plan once."""
    return _let(rank_map(ranks), lambda literal: F.transform(words, lambda w: fold(w, literal)))


# ---- long words


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and linked pieces: n log n for n bytes."""
    n = len(word)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not live[i] or j < 0 or end[j] != stop:
            continue
        end[i], live[j], nxt[i] = end[j], False, nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        for a in (prev[i], i):
            if a >= 0 and (b := nxt[a]) >= 0 and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold: of all neighbouring pairs the one of least rank, the leftmost of equals, becomes one piece."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return merge_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < NO_RANK:
        i = pairs.index(least)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(pieces[i - 1] + pieces[i], NO_RANK)
        if i < len(pairs):
            pairs[i] = ranks.get(pieces[i] + pieces[i + 1], NO_RANK)
    return [ranks[p] for p in pieces]


class Encoder(dict):
    """Ids of words as little-endian uint32 bytes; at most KEEP words of moderate length are kept at a time."""

    KEEP, KEEP_LENGTH = 500_000, 48

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find, self.pieces = ranks, regex.compile(pattern).findall, pieces_of(ranks)

    def __missing__(self, word: str) -> bytes:
        ids = np.array(merge(word.encode(), self.ranks), "<u4").tobytes()
        if len(word) <= self.KEEP_LENGTH:
            if len(self) >= self.KEEP:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, so tasks after the first find the common words known."""
    return Encoder(load_ranks(path), pattern)


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out


def _per_text(docs: DataFrame, one, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """doc_id and one(text) of every row, in batches of bounded size."""
    names = [c.split()[0] for c in schema.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                rows.append((d, *one(t)))
                held += len(t or "")
                if held > BATCH_CHARS:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian uint32 bytes."""
    return _per_text(docs, lambda t: (encoder(ranks_path, pattern).encode(t),), "doc_id long, ids binary", [pa.int64(), pa.binary()])


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encodes, decodes what it encoded, and gives digests of both."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def digests(text: str | None) -> tuple[int, str, str]:
        e = encoder(path, pattern)
        ids = e.encode(text)
        return len(ids) // 4, sha(ids), sha(e.decode(ids))

    return _per_text(table(spark, sf_dir, "documents"), digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.int64(), pa.string(), pa.string()])
