"""Media columns: archives of images in a directory, written by one job and read through a custom Spark data source.

Writing stores each payload as a PNG of 8-bit grey samples, 64 to a row, inside ZIP archives (members stored, one archive a task).
Reading plans byte ranges over the archives of the directory: a member belongs to the range that its header starts in, so ranges
split large archives without a shuffle, and payloads leave the reader as Arrow batches of bounded size. A member that can't be
read is tried again by itself, from its offset on a new handle; one that stays unreadable gives a row with null media and the
error, and the others go on. All file access is by ``pyarrow.fs``, so the directory may be any store that pyarrow knows.

Archives are named after their task and moved into place when complete, so a task that runs again (a lost executor, speculation)
replaces its own archive by the same bytes.

Defined results: null and empty texts are one row of zero bytes; repeated rows are repeated members; texts of any length are kept
whole; an empty table gives an empty directory and no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sieveline.llm.shared import shared_dir, table

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# ---- the stored form


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """payload: a positive multiple of WIDTH bytes; n_bytes: how many of them are not padding."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, n_bytes, width = 8, [], 0, 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes(), n_bytes


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH) if raw else bytes(WIDTH)


def feature(payload: bytes) -> str:
    """Perceptual digest: mean and deviation of the samples, then one bit a column, set if the column's mean is above the whole mean."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sums = a.sum(0, dtype=np.int64)
    total, n = int(sums.sum()), a.size
    squares = int(np.dot(np.bincount(a.ravel(), minlength=256), np.arange(256, dtype=np.int64) ** 2))
    bits = np.packbits(sums * WIDTH > total).tobytes().hex()
    return f"{total / n:.4f}:{max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f}:{bits}"


# ---- writing


def write_archives(df: DataFrame, directory: str) -> tuple[int, int]:
    """df: name string, payload binary, n_bytes long. Writes the archives at once; returns members and bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(directory)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        final, mine = f"{root}/part-{part:06d}.zip", f"{root}/_{uuid.uuid4().hex}.tmp"
        n = size = 0
        try:
            with fs.open_output_stream(mine) as sink, zipfile.ZipFile(_Forward(sink), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                for b in batches:
                    for name, payload, n_bytes in zip(b["name"].to_pylist(), b["payload"].to_pylist(), b["n_bytes"].to_pylist(), strict=True):
                        media = to_png(payload, n_bytes)
                        z.writestr(zipfile.ZipInfo(f"{n:09d}-{name}.png"), media)
                        n, size = n + 1, size + len(media)
            if n:
                fs.move(mine, final)
        finally:
            if fs.get_file_info(mine).type == pafs.FileType.File:
                fs.delete_file(mine)
        yield pa.record_batch({"n": [n], "size": [size]})

    got = df.mapInArrow(write, "n long, size long").agg(F.sum("n"), F.sum("size")).first()
    fs, root = file_system(directory)
    fs.create_dir(root, recursive=True)
    return got[0] or 0, got[1] or 0


class _Forward(io.RawIOBase):
    """A sink that zipfile takes as unseekable."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


# ---- reading


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.directory = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 16 << 20))
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[Range]:
        fs, root = file_system(self.directory)
        files = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(".zip")]
        out = [Range(f.path, at, min(f.size, at + self.range_bytes)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.directory)
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if partition.start <= m.header_offset < partition.end]
        rows, held = [], 0
        handle = fs.open_input_file(partition.path)
        try:
            for m in sorted(members, key=lambda m: m.header_offset):
                media, error = None, None
                for k in range(self.tries):
                    try:
                        media, error = self.member(handle, m), None
                        break
                    except Exception as e:  # noqa: BLE001  a member's failure is its own
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(0.05 * k)
                        handle.close()
                        handle = fs.open_input_file(partition.path)
                rows.append((os.path.basename(partition.path), m.filename, m.header_offset, media, error))
                held += len(media or b"")
                if held >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, held = [], 0
        finally:
            handle.close()
        if rows:
            yield self.batch(rows)

    @staticmethod
    def member(handle, m: zipfile.ZipInfo) -> bytes:
        """Reads one stored member by its offset and checks it."""
        handle.seek(m.header_offset)
        head = handle.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        skip = sum(struct.unpack("<HH", head[26:30]))
        body = handle.read(skip + m.file_size)[skip:]
        if len(body) != m.file_size or zlib.crc32(body) != m.CRC:
            raise ValueError("size or checksum differs")
        return body

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


class ArchiveSource(DataSource):
    """format("sieveline_archives"): option path, and rangeBytes, batchBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "sieveline_archives"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, directory: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("sieveline_archives").options(**options).load(directory)


# ---- the query

RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for b in batches:
        out: dict[str, list] = {k.split()[0]: [] for k in RESULT.split(", ")}
        for member, media, error in zip(b["member"].to_pylist(), b["media"].to_pylist(), b["error"].to_pylist(), strict=True):
            if error:
                raise RuntimeError(f"{member}: {error}")
            payload, n_bytes = from_png(media)
            doc = member[10:-4]
            row = (int(doc) if doc != "null" else None, n_bytes, len(payload), sha(payload), zlib.crc32(payload[-WIDTH:]), len(media), sha(media), feature(payload))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[k.split()[0]], pa.string() if k.endswith("string") else pa.int64()) for k in RESULT.split(", ")], names=list(out))


def payloads(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    missing = F.when(F.length(raw) == 0, WIDTH).otherwise(F.pmod(-F.length(raw), F.lit(WIDTH)))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"),
        F.concat(raw, F.substring(F.unhex(F.lit("00" * WIDTH)), F.lit(1), missing)).alias("payload"),
        F.length(raw).cast("long").alias("n_bytes"),
    )


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    directory = shared_dir(spark, "media")
    write_archives(payloads(table(spark, sf_dir, "documents").select("doc_id", "text")), directory)
    return read_archives(spark, directory).select("member", "media", "error").mapInArrow(_describe, RESULT)
