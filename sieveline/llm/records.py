"""Token-id output: length-delimited binary records with masked checksums, and a separate offset index for shuffled reads.

Shards. A write makes one pair of files a task, ``part-NNNNNN-<attempt>.rec`` and ``.idx``, and at the end ``shards.json``, which names the shards of
the write in the order of their partitions. Only what it names is data: a task that failed or ran twice leaves a file that nobody reads, and a
write that failed leaves no ``shards.json``.

Record (the framing that is common for training data, so its readers can open a shard): length as little-endian uint64, masked CRC-32C of these
eight bytes as uint32, the serialized sequence, masked CRC-32C of the sequence. masked(c) = rotate_right(c, 15) + 0xa282ead8.
Sequence: doc_id int64, one byte that says whether there is a doc_id, one byte for the width of an id, two zero bytes, number of ids as
uint32, then the ids, little-endian, two bytes wide where the vocabulary allows it, else four.
Index: for each record its offset, its framed bytes and the ids before it in the shard (three uint64), then a masked CRC-32C of all that.

A reader plans byte ranges over the shards; a record belongs to the range in which it starts. `shuffled` deals the index, not the sequences: rows
of the index are put into an order that a seed gives, and each task fetches its records by their offsets.

Defined results: null and empty texts are the end id alone; a null doc_id stays null and comes first; rows of one doc_id are ordered by a hash of
their text, equal rows are as many records; a text of any length is one record (read in slices cut at spaces, so words stay whole); an
empty table gives no shard; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sieveline.llm.media import file_system
from sieveline.llm.packing import tokenizer_file
from sieveline.llm.shared import shared_dir, table

END = 2
MANIFEST = "shards.json"

# ---- ids

#: How a vocabulary of words with an end mark splits a normalised text, and the same pattern over `PLAIN` characters in lower case.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Characters that normalisation leaves as they are, but for case, one to one: printable ASCII, the Latin-1 letters and white space.
PLAIN = re.compile("[ -~À-ÖØ-öø-ÿ\t\n\x0b\x0c\r]*")

SLICE = 4_000_000  # characters of a text that are held as pieces at a time
TOGETHER = 2000  # pieces in one call of the library


class WordIds:
    """Ids of whole texts by a file of the `tokenizers` library.

    Where the file drops white space, lower-cases and marks the ends of words, a text is cut into the pieces that the file's pattern gives; pieces recur
    and the ids of those met of late are kept. New pieces are encoded by the library, many in one text with spaces between: the end mark of each
    shows where its ids end. Words with other characters than `PLAIN`, and texts of other files, go to the library whole.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocab = self.library.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.keep, self.pieces, self.older = keep, {}, {}
        self.by_pieces = self._splits(spec)
        if self.by_pieces:
            mark = spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(mark)]] = True

    @staticmethod
    def _splits(spec: dict) -> bool:
        steps = [(s["type"], s.get("pattern")) for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        return bool(
            steps == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
            and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": SPLIT}, "Removed", True)
            and [(r["type"], r.get("use_regex"), r.get("add_prefix_space")) for r in rest] == [("ByteLevel", False, False)]
            and spec["model"].get("end_of_word_suffix")
        )

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, used: set[str]) -> None:
        new = used.difference(self.pieces)
        back = new.intersection(self.older)
        self.pieces.update(zip(back, map(self.older.__getitem__, back), strict=True))
        new = list(new.difference(back))
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer file splits pieces again")
            raw, cuts = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
            self.pieces.update(zip(some, (raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """texts: `PLAIN` characters alone."""
        found = [PLAIN_SPLIT.findall(t.lower()) for t in texts]
        self._learn(set().union(*found))
        out = [b"".join(map(self.pieces.__getitem__, f)) for f in found]
        if len(self.pieces) > self.keep:
            self.pieces, self.older = {}, self.pieces
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if not PLAIN.fullmatch(t)]
        if not odd:
            return self._by_pieces(texts)
        # an odd text: its plain runs as texts, its odd words as lists
        runs = {i: [" ".join(g) if plain else list(g) for plain, g in itertools.groupby(texts[i].split(" "), lambda w: bool(PLAIN.fullmatch(w)))] for i in odd}
        flat = [t for i, t in enumerate(texts) if i not in runs] + [r for i in odd for r in runs[i] if isinstance(r, str)]
        plain = iter(self._by_pieces(flat))
        out = {i: next(plain) for i in range(len(texts)) if i not in runs}
        for i in odd:
            out[i] = b"".join(next(plain) if isinstance(r, str) else b"".join(self.whole(r)) for r in runs[i])
        return [out[i] for i in range(len(texts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_pieces:
            return self.whole(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        held, at, size = [], [], 0
        for i, t in enumerate(texts):
            for piece in slices(t):
                held.append(piece)
                at.append(i)
                size += len(piece)
                if size >= SLICE:
                    for k, ids in zip(at, self._some(held), strict=True):
                        out[k].append(ids)
                    held, at, size = [], [], 0
        for k, ids in zip(at, self._some(held) if held else [], strict=True):
            out[k].append(ids)
        return [b"".join(x) for x in out]


def slices(text: str, n: int = SLICE) -> Iterator[str]:
    """A text in slices of about n characters, cut at spaces."""
    at = 0
    while len(text) - at > n:
        cut = text.find(" ", at + n)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


@functools.cache
def ids_of(path: str) -> WordIds:
    """One for each Python worker, so tasks after the first find the common pieces known."""
    return WordIds(path)


def sequences(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """(doc_id, ids binary, width) of docs (doc_id, text), in ascending doc_id over range partitions: ids of the whole text and the end id."""
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_path)
        last = np.array([end], ids.dtype).tobytes()
        for b in batches:
            found = [x + last for x in ids.encode(b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, pa.binary()), pa.array([ids.dtype.itemsize] * len(found), pa.int32())], names=["doc_id", "ids", "width"])

    return ordered.mapInArrow(run, "doc_id long, ids binary, width int")


# ---- checksums

CHUNK = 256  # words of four bytes in a lane


@functools.cache
def _tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """Two pairs of tables: what a state becomes after one word of zeros, and after CHUNK such words, by the state's low and high half."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0x82F63B78), step >> 1)  # the polynomial of CRC-32C
    half = np.arange(1 << 16, dtype=np.uint32)
    out = []
    for n in (4, 4 * CHUNK):
        pair = []
        for state in (half.copy(), half << np.uint32(16)):
            for _ in range(n):
                state = step[state & 0xFF] ^ (state >> 8)
            pair.append(state)
        out.append(tuple(pair))
    return out


def _after(state: np.ndarray, pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return pair[0][state & 0xFFFF] ^ pair[1][state >> 16]


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record, all at once: records are cut into lanes of CHUNK words, lanes run side by side and are joined by the record."""
    if not records:
        return np.zeros(0, np.uint32)
    word, chunk = _tables()
    sizes = np.array([len(r) for r in records])
    lanes = -(-np.maximum(sizes, 4) // (4 * CHUNK))
    stop = np.cumsum(lanes)
    flat = np.zeros(int(stop[-1]) * 4 * CHUNK, np.uint8)  # zeros in front of a record change nothing: the state is zero there
    for r, n, at in zip(records, sizes.tolist(), (stop * 4 * CHUNK).tolist(), strict=True):
        flat[at - n : at] = np.frombuffer(r, np.uint8)
        if n >= 4:
            flat[at - n : at - n + 4] ^= 0xFF  # the usual first state
    by_step = np.ascontiguousarray(flat.view("<u4").reshape(-1, CHUNK).T)
    state = np.zeros(by_step.shape[1], np.uint32)
    for w in by_step:
        state = _after(state ^ w, word)
    order = np.argsort(-lanes, kind="stable")
    first, n = (stop - lanes)[order], lanes[order]
    out = state[first].copy()
    for k in range(1, int(n[0])):
        live = int(np.searchsorted(-n, -k))  # those with more than k lanes
        out[:live] = _after(out[:live], chunk) ^ state[first[:live] + k]
    back = np.empty_like(out)
    back[order] = out
    for i in np.flatnonzero(sizes < 4):  # shorter than the first state
        c = 0xFFFFFFFF
        for b in records[i]:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        back[i] = c
    return back ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


# ---- the format

HEAD = struct.Struct("<qBBHI")
FRAME = 16  # bytes of a frame beside its sequence


def serialize(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return HEAD.pack(doc_id or 0, doc_id is not None, width, 0, len(ids) // width) + ids


def deserialize(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width, _, n = HEAD.unpack_from(data)
    ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", offset=HEAD.size)
    if len(ids) != n:
        raise ValueError("a sequence's length differs from its header")
    return doc_id if known else None, ids


def frames(data: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(d)) for d in data]
    a, b = masked(crc32c(lengths)), masked(crc32c(data))
    return [x + struct.pack("<I", p) + d + struct.pack("<I", q) for x, d, p, q in zip(lengths, data, a.tolist(), b.tolist(), strict=True)]


def unframed(framed: list[bytes], where: str) -> list[bytes]:
    """The sequences of whole frames, checked."""
    data = [f[12:-4] for f in framed]
    if any(struct.unpack_from("<Q", f)[0] != len(d) for f, d in zip(framed, data, strict=True)):
        raise ValueError(f"{where}: a record's length differs from the index")
    if frames(data) != framed:
        raise ValueError(f"{where}: a record's checksum is wrong")
    return data


@dataclass
class Shard(WriterCommitMessage):
    part: int
    name: str
    records: int = 0
    ids: int = 0
    bytes: int = 0


def read_manifest(path: str) -> list[Shard]:
    fs, root = file_system(path)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return [Shard(**s) for s in json.loads(f.read())["shards"]]


def read_index(fs: pafs.FileSystem, root: str, shard: Shard) -> np.ndarray:
    """One row a record: offset, framed bytes, ids before it."""
    with fs.open_input_stream(f"{root}/{shard.name}.idx") as f:
        raw = f.read()
    if int(masked(crc32c([raw[:-4]]))[0]) != struct.unpack("<I", raw[-4:])[0] or len(raw) != 24 * shard.records + 4:
        raise ValueError(f"{shard.name}.idx: checksum or length differs")
    return np.frombuffer(raw[:-4], "<u8").astype(np.int64).reshape(-1, 3)


class RecordWriter(DataSourceArrowWriter):
    """Takes doc_id long, ids binary, width int. Each task writes a pair of files of its own; the commit names them in the manifest."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        fs, root = file_system(self.path)
        part = TaskContext.get().partitionId()
        shard = Shard(part, f"part-{part:06d}-{uuid.uuid4().hex}")
        index, sink = [], None
        try:
            for b in iterator:
                ids, width = b["ids"].to_pylist(), b["width"].to_pylist()
                framed = frames([serialize(d, x, w) for d, x, w in zip(b["doc_id"].to_pylist(), ids, width, strict=True)])
                if framed and sink is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{shard.name}.rec")
                for f, x, w in zip(framed, ids, width, strict=True):
                    index += (shard.bytes, len(f), shard.ids)
                    shard.bytes, shard.ids, shard.records = shard.bytes + len(f), shard.ids + len(x) // w, shard.records + 1
                if framed:
                    sink.write(b"".join(framed))
        finally:
            if sink is not None:
                sink.close()
        if shard.records:
            raw = np.array(index, "<u8").tobytes()
            with fs.open_output_stream(f"{root}/{shard.name}.idx") as f:
                f.write(raw + struct.pack("<I", int(masked(crc32c([raw]))[0])))
        return shard

    def commit(self, messages: list[Shard | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        shards = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.part)
        with fs.open_output_stream(f"{root}/.{MANIFEST}") as f:
            f.write(json.dumps({"shards": [vars(s) for s in shards]}).encode())
        fs.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")

    def abort(self, messages: list[Shard | None]) -> None:
        fs, root = file_system(self.path)
        for name in (f"{root}/{m.name}.{kind}" for m in messages if m is not None and m.records for kind in ("rec", "idx")):
            if fs.get_file_info(name).is_file:
                fs.delete_file(name)


@dataclass
class Span(InputPartition):
    shard: Shard | None
    number: int = 0
    base: int = 0
    start: int = 0
    end: int = 0


KINDS = {"shard": pa.int32(), "record": pa.int64(), "offset": pa.int64(), "bytes": pa.int64(), "start": pa.int64(), "doc_id": pa.int64(), "ids": pa.binary()}
INDEX = "shard int, record long, offset long, bytes long, start long"


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.index_only = str(options.get("index", "false")).lower() == "true"
        self.range_bytes = int(options.get("rangeBytes", 16 << 20))
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))

    def partitions(self) -> list[Span]:
        out, base = [], 0
        for k, s in enumerate(read_manifest(self.path)):
            n = max(s.bytes if self.index_only else self.range_bytes, 1)
            out += [Span(s, k, base, at, at + n) for at in range(0, s.bytes, n)]
            base += s.ids
        return out or [Span(None)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.shard is None:
            return
        fs, root = file_system(self.path)
        index = read_index(fs, root, p.shard)
        numbers = np.flatnonzero((index[:, 0] >= p.start) & (index[:, 0] < p.end))
        names = list(KINDS)
        if self.index_only:
            columns = [np.full(len(numbers), p.number), numbers, index[numbers, 0], index[numbers, 1], index[numbers, 2] + p.base]
            yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for k, c in zip(names, columns, strict=False)], names=names[:5])
            return
        with fs.open_input_file(f"{root}/{p.shard.name}.rec") as f:
            for some in by_bytes(numbers, index[:, 1], self.batch_bytes):
                f.seek(int(index[some[0], 0]))
                raw, ends = f.read(int(index[some, 1].sum())), np.cumsum(index[some, 1]).tolist()
                data = unframed([raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], p.shard.name)
                found = [deserialize(d) for d in data]
                columns = [np.full(len(some), p.number), some, index[some, 0], index[some, 1], index[some, 2] + p.base, [d for d, _ in found], [i.astype("<u4").tobytes() for _, i in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for k, c in zip(names, columns, strict=True)], names=names)


def by_bytes(numbers: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of neighbours of about `most` bytes."""
    if len(numbers):
        group = (np.cumsum(size[numbers]) - size[numbers]) // most
        yield from np.split(numbers, np.flatnonzero(np.diff(group)) + 1)


class RecordSource(DataSource):
    """format("sieveline_records"): option path; for reading also index (the index alone), rangeBytes, batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "sieveline_records"

    def schema(self) -> str:
        return INDEX if str(self.options.get("index", "false")).lower() == "true" else f"{INDEX}, doc_id long, ids binary"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"])


def write_records(sequences: DataFrame, path: str) -> None:
    """sequences: doc_id long, ids binary, width int; partitions become shards in their order, rows records in theirs."""
    sequences.sparkSession.dataSource.register(RecordSource)
    sequences.write.format("sieveline_records").mode("append").save(path)


def read_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """shard, record, offset, bytes, start (ids before it in the whole write), doc_id, ids (little-endian uint32)."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("sieveline_records").options(**options).load(path)


def shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """(place, shard, record, doc_id, ids): all records in an order that the seed gives; place ascends with it. Only the index is sorted."""
    place = F.xxhash64(F.lit(seed), "shard", "record")
    ordered = read_records(spark, path, index="true").select(place.alias("place"), "shard", "record", "offset", "bytes").repartitionByRange("place", "shard", "record").sortWithinPartitions("place", "shard", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        shards, files = read_manifest(path), {}
        try:
            for b in batches:
                c = {k: b[k].to_pylist() for k in ("place", "shard", "record", "offset", "bytes")}
                for some in by_bytes(np.arange(len(b)), np.array(c["bytes"]), 4 << 20):
                    framed = []
                    for i in some:
                        name = shards[c["shard"][i]].name
                        if name not in files:
                            if len(files) >= 64:
                                files.pop(next(iter(files))).close()
                            files[name] = fs.open_input_file(f"{root}/{name}.rec")
                        files[name].seek(c["offset"][i])
                        framed.append(files[name].read(c["bytes"][i]))
                    found = [deserialize(d) for d in unframed(framed, root)]
                    columns = [pa.array([c[k][i] for i in some], t) for k, t in (("place", pa.int64()), ("shard", pa.int32()), ("record", pa.int64()))]
                    columns += [pa.array([d for d, _ in found], pa.int64()), pa.array([i.astype("<u4").tobytes() for _, i in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["place", "shard", "record", "doc_id", "ids"])
        finally:
            for f in files.values():
                f.close()

    return ordered.mapInArrow(run, "place long, shard int, record long, doc_id long, ids binary")


def op11_records(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "records")
    write_records(sequences(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")), path)
    return read_records(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
