"""Packing: documents become token windows of at most `WINDOW` ids by Karmarkar-Karp multiway differencing.

Each document is its token ids and one end id. Whole windows are cut off the front; what remains is cut into pieces of at most
`GRAIN` ids and gathered until a group fills `GROUP` windows. Within a group, differencing merges the two partial partitions with the
largest imbalance, the fullest window of one with the emptiest of the other, until one partition is left: near-equal windows. Where
any exceeds the capacity, the number of windows rises by one and the group is parted again.

Groups are formed in the stream of each task, so nothing is shuffled and memory is bounded by a group; the input's own partitions are
read in their order, so a task that runs again gives the same rows.

Defined results: null and empty texts are the end id alone; repeated rows are packed as often as they stand there; texts of any length are
packed whole; ties are broken by input order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sieveline.llm.shared import table

WINDOW = 1024
GRAIN = 256
GROUP = 128
#: Free ids a window that a group aims at, so that near-equal windows fit.
SLACK = 2
END = 0

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def rank_encoder(path: str):
    """An encoder by ranks for a tokenizer file whose ids are the order of its merges and whose split is the byte-level one; else None."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocab, alphabet = model["vocab"], byte_alphabet()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(vocab) - len(special & vocab.keys()) != 256 + len(merges):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("by-ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Ids:
    """Token ids of whole texts by a tokenizer file, as little-endian uint32 bytes.

    The split pattern of byte-level BPE never joins a non-space with a space after it, nor takes more than one space into a word, so a text may be
    cut before a space that has a non-space beside it. The parts between such spaces recur and are kept, up to `keep` of them. New parts are
    encoded by ranks where the file allows it, which gives the ids of the `tokenizers` library several times as fast, else by that library.
    """

    KEEP_LENGTH = 48

    def __init__(self, path: str, keep: int = 700_000, library: bool = False):
        self.by_ranks = None if library else rank_encoder(path)
        if self.by_ranks is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
        self.spaced = Parts(self, " ", keep)
        self.bare = Parts(self, "", keep // 8)
        self.doubled = re.compile(r"\s \s|^ \s|\s $")
        self.cuts = re.compile(r"(?<=\S)(?= )|(?=\x20\S)")

    def one(self, part: str) -> bytes:
        ids = self.by_ranks(part) if self.by_ranks else self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.doubled.search(text):
            return b"".join(self.spaced[p[1:]] if p[0] == " " else self.bare[p] for p in self.cuts.split(text) if p)
        first, *rest = text.split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.spaced.__getitem__, rest))


class Parts(dict):
    """Ids of parts behind a fixed lead; the short ones are kept, all are dropped when there are too many."""

    def __init__(self, ids: Ids, lead: str, keep: int):
        self.ids, self.lead, self.keep = ids, lead, keep

    def __missing__(self, part: str) -> bytes:
        found = self.ids.one(self.lead + part)
        if len(part) <= Ids.KEEP_LENGTH:
            if len(self) >= self.keep:
                self.clear()
            self[part] = found
        return found


@functools.cache
def ids_of(path: str) -> Ids:
    """One for each Python worker, so tasks after the first find the common parts known."""
    return Ids(path)


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Parts sizes into k windows; returns their sums and members."""
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    left, right = list(range(len(sizes))), [-1] * len(sizes)  # nodes: items, then merged pairs
    for i, n in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[-1], nodes[-1] = n, i
        heap.append((-n, i, sums, nodes))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heap[0]
        sums, other = a + b[::-1], bn[::-1]  # both ascending: the fullest meets the emptiest
        both = np.flatnonzero((an >= 0) & (other >= 0))
        nodes = np.maximum(an, other)
        if len(both):
            first = len(left)
            left.extend(an[both].tolist())
            right.extend(other[both].tolist())
            nodes[both] = np.arange(first, first + len(both))
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        tick += 1
        heapq.heapreplace(heap, (int(sums[0] - sums[-1]), tick, sums, nodes))
    _, _, sums, nodes = heap[0]
    members = []
    for node in nodes.tolist():
        todo, items = [node] if node >= 0 else [], []
        while todo:
            x = todo.pop()
            if x < len(sizes):
                items.append(x)
            else:
                todo += [left[x], right[x]]
        members.append(sorted(items))
    return sums, members


def part(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Members of near-equal windows of at most capacity; every size is at most capacity."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        sums, members = differencing(sizes, k)
        if sums.max() <= capacity:
            return [m for m in members if m]
        k += 1


class Packer:
    """Packs documents in the order given; rows are tuples in the order of RESULT."""

    def __init__(self, first_sequence: int, window: int = WINDOW, grain: int = GRAIN, group: int = GROUP):
        self.next, self.window, self.grain, self.goal = first_sequence, window, grain, group * (window - SLACK)
        self.held: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, w = len(ids) // 4, self.window
        whole = total - total % w
        for at in range(0, whole, w):
            yield (doc_id, at, w, zlib.crc32(ids[4 * at : 4 * (at + w)]), total, self.next, 0)
            self.next += 1
        for at in range(whole, total, self.grain):
            n = min(self.grain, total - at)
            while self.tokens + n > self.goal:  # the piece that fills the group is cut to measure
                fits = self.goal - self.tokens
                if fits:
                    self.hold(doc_id, at, fits, ids, total)
                    at, n = at + fits, n - fits
                yield from self.flush()
            if n:
                self.hold(doc_id, at, n, ids, total)

    def hold(self, doc_id, at: int, n: int, ids: bytes, total: int) -> None:
        self.held.append((doc_id, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total))
        self.tokens += n

    def flush(self) -> Iterator[tuple]:
        for members in part([p[2] for p in self.held], self.window):
            at = 0
            for i in members:
                yield (*self.held[i], self.next, at)
                at += self.held[i][2]
            self.next += 1
        self.held, self.tokens = [], 0


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, grain: int = GRAIN, group: int = GROUP) -> DataFrame:
    """docs: doc_id, text. One row a piece."""
    end = np.array([END], "<u4").tobytes()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_path)
        packer, rows = Packer(TaskContext.get().partitionId() << 40, window, grain, group), []
        for b in batches:
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                rows.extend(packer.add(d, ids.encode(t or "") + end))
                if len(rows) > 20_000:
                    yield out(rows)
                    rows = []
        rows.extend(packer.flush())
        if rows:
            yield out(rows)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, RESULT)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())
