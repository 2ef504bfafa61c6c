"""Conversation turn reassembly: turns that arrive late, repeated and out of order become conversations, in Structured Streaming.

Conversations are dealt to buckets by a hash. A bucket is one group of ``applyInPandasWithState``; its state holds all its conversations as columns
(Arrow buffers, zstd), and each batch brings it one tick row, so that silence can be noticed. A batch is merged with numpy over the whole bucket:
rows of closed conversations are rejected, repeats of kept turns are dropped (the first arrival wins), the gapless run from `first` is
released, and conversations without arrivals in this batch and the one before are closed. The state keeps unreleased turns, one row for an open
conversation, and the ids of closed ones. A bucket must fit one task, so their number grows with the rows (`buckets_for`).

Defined results: rows without conv_id or turn are dropped, null roles and texts are empty. Of equal turns in one batch the smallest payload
(``role|text``, by UTF-8 bytes) arrives, further ones of that batch do not count. A conversation's `first` is the least that its opening batch carries;
turns before it are kept and never released. Texts of any length are whole. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.storage import _at
from sieveline.llm.shared import shared_dir, table

QUIET = 2  # batches without arrivals that close a conversation
ROWS_PER_BUCKET = 50_000

ARRIVAL = "batch int, bucket int, conv_id long, turn long, first long, role string, text string, tick boolean, last boolean"
EVENT = "event string, conv_id long, turn long, batch long, role string, text string, pending array<long>, n_missing long, n_breaks long"
NAMES = [c.split()[0] for c in EVENT.split(", ")]


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


class Bucket:
    """Conversations of one bucket: open ones by ascending id (conv, first, seen, released, breaks, role), their unreleased turns by conversation and
    turn (at, turn, turn_role, text), and the ids of closed ones in order."""

    OPEN = ("conv", "first", "seen", "released", "breaks")

    def __init__(self):
        for k in (*self.OPEN, "at", "turn", "closed"):
            setattr(self, k, np.zeros(0, np.int64))
        for k in ("role", "turn_role", "text"):
            setattr(self, k, np.zeros(0, object))

    # -- state

    def dump(self) -> bytes:
        tables = (
            {k: pa.array(getattr(self, k)) for k in self.OPEN} | {"role": pa.array(self.role, pa.string())},
            {"at": pa.array(self.at), "turn": pa.array(self.turn), "turn_role": pa.array(self.turn_role, pa.string()), "text": pa.array(self.text, pa.large_string())},
            {"closed": pa.array(np.diff(self.closed, prepend=0))},
        )
        out = []
        for t in tables:
            sink = pa.BufferOutputStream()
            batch = pa.record_batch(t)
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            body = sink.getvalue().to_pybytes()
            out += (struct.pack("<Q", len(body)), body)
        return b"".join(out)

    @classmethod
    def load(cls, state: bytes) -> Bucket:
        b, at = cls(), 0
        while at < len(state):
            (n,) = struct.unpack_from("<Q", state, at)
            batch = pa.ipc.open_stream(pa.py_buffer(state[at + 8 : at + 8 + n])).read_next_batch()
            at += 8 + n
            for k, column in zip(batch.schema.names, batch.columns, strict=True):
                setattr(b, k, column.to_numpy(zero_copy_only=False).copy())
        b.closed = np.cumsum(b.closed)
        return b

    # -- a batch

    def take(self, rows: pd.DataFrame, batch: int, last: bool = False) -> Iterator[pd.DataFrame]:
        """rows: conv_id, turn, first, role, text. Yields events."""
        conv = rows["conv_id"].to_numpy(np.int64)
        late = np.isin(conv, self.closed)
        if late.any():
            yield self._events("reject", batch, rows["conv_id"][late], rows["turn"][late], rows["role"][late], rows["text"][late])
        if not late.all():
            self._keep(rows[~late], batch)
        yield from self._release(batch)
        yield from self._close(batch, last)

    def _keep(self, rows: pd.DataFrame, batch: int) -> None:
        conv, turn, first = (rows[k].to_numpy(np.int64) for k in ("conv_id", "turn", "first"))
        role, text = (rows[k].to_numpy(object) for k in ("role", "text"))
        ids, inverse = np.unique(conv, return_inverse=True)
        self._open(ids, inverse, first)
        where = np.searchsorted(self.conv, ids)
        self.seen[where] = batch
        at = where[inverse]
        since = turn - self.first[at]
        new = (since < 0) | (since >= self.released[at])
        if len(np.unique(np.stack([at, turn]), axis=1).T) < len(at):  # equal turns in one batch
            order = np.array(sorted(np.flatnonzero(new), key=lambda i: f"{role[i]}|{text[i]}".encode()), np.int64)
        else:
            order = np.flatnonzero(new)
        at, turn = np.concatenate([self.at, at[order]]), np.concatenate([self.turn, turn[order]])
        order = np.concatenate([np.arange(len(self.at)), order + len(self.at)])
        sort = np.lexsort((turn, at))  # stable: what is kept stands before what arrives
        at, turn, order = at[sort], turn[sort], order[sort]
        once = np.ones(len(at), bool)
        once[1:] = (at[1:] != at[:-1]) | (turn[1:] != turn[:-1])
        order = order[once]
        self.turn_role, self.text = np.concatenate([self.turn_role, role])[order], np.concatenate([self.text, text])[order]
        self.at, self.turn = at[once], turn[once]

    def _open(self, ids: np.ndarray, inverse: np.ndarray, first: np.ndarray) -> None:
        new = ~np.isin(ids, self.conv)
        if not new.any():
            return
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, first)
        zeros = np.zeros(int(new.sum()), np.int64)
        added = {"conv": ids[new], "first": least[new], "seen": zeros, "released": zeros, "breaks": zeros}
        order = np.argsort(np.concatenate([self.conv, ids[new]]), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        for k, v in added.items():
            setattr(self, k, np.concatenate([getattr(self, k), v])[order])
        self.role = np.concatenate([self.role, _objects([None] * len(zeros))])[order]
        self.at = place[self.at]

    def _release(self, batch: int) -> Iterator[pd.DataFrame]:
        if not len(self.at):
            return
        at, turn = self.at, self.turn
        counts = turn >= self.first[at]
        so_far = np.cumsum(counts)
        rank = so_far - 1 - (so_far - counts)[np.searchsorted(at, at)]
        go = counts & (turn - rank == (self.first + self.released)[at])
        if not go.any():
            return
        before = np.where(rank > 0, np.concatenate([[None], self.turn_role[:-1]]), self.role[at])
        again = go & (before == self.turn_role)  # no role is null, but that of a conversation without released turns
        self.breaks += np.bincount(at[again], minlength=len(self.conv))
        self.released += np.bincount(at[go], minlength=len(self.conv))
        ends = np.flatnonzero(go & ~np.concatenate([go[1:] & (at[1:] == at[:-1]), [False]]))
        self.role[at[ends]] = self.turn_role[ends]
        yield self._events("release", batch, self.conv[at[go]], turn[go], self.turn_role[go], self.text[go])
        self._leave(~go)

    def _leave(self, stay: np.ndarray) -> None:
        self.at, self.turn, self.turn_role, self.text = self.at[stay], self.turn[stay], self.turn_role[stay], self.text[stay]

    def _close(self, batch: int, last: bool) -> Iterator[pd.DataFrame]:
        going = np.ones(len(self.conv), bool) if last else self.seen <= batch - QUIET
        if not going.any():
            return
        at, turn, n = self.at, self.turn, len(self.conv)
        follows = np.zeros(len(at), bool)
        follows[1:] = (at[1:] == at[:-1]) & (turn[1:] == turn[:-1] + 1) & (self.turn_role[1:] == self.turn_role[:-1])
        breaks = self.breaks + np.bincount(at[follows], minlength=n)
        inside = turn >= self.first[at]
        kept = self.released + np.bincount(at[inside], minlength=n)
        most = self.first + self.released - 1
        np.maximum.at(most, at, turn)
        missing = most - self.first + 1 - kept
        cuts = np.searchsorted(at, np.flatnonzero(going), "left"), np.searchsorted(at, np.flatnonzero(going), "right")
        out = self._events("close", batch, self.conv[going], np.full(int(going.sum()), -1))
        out["pending"] = _objects([turn[a:b] for a, b in zip(*cuts, strict=True)])
        out["n_missing"], out["n_breaks"] = missing[going], breaks[going]
        yield out
        self.closed = np.union1d(self.closed, self.conv[going])
        self._leave(~going[at])
        self.at = (np.cumsum(~going) - 1)[self.at]
        for k in (*self.OPEN, "role"):
            setattr(self, k, getattr(self, k)[~going])

    @staticmethod
    def _events(event: str, batch: int, conv, turn, role=None, text=None) -> pd.DataFrame:
        out = pd.DataFrame({"event": event, "conv_id": np.asarray(conv), "turn": np.asarray(turn), "batch": batch})
        for k, v in (("role", role), ("text", text), ("pending", None), ("n_missing", None), ("n_breaks", None)):
            out[k] = _objects([None] * len(out)) if v is None else np.asarray(v)
        return out[NAMES]


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames), ignore_index=True)
    bucket = Bucket.load(state.get[0]) if state.exists else Bucket()
    yield from bucket.take(rows[~rows["tick"]], int(rows["batch"].max()), bool(rows["last"].any()))
    state.update((bucket.dump(),))


def reassemble(arrivals: DataFrame) -> DataFrame:
    """arrivals: a stream of ARRIVAL whose every micro-batch has one tick row a bucket; `last` in a tick closes all. Gives a stream of EVENT."""
    return arrivals.groupBy("bucket").applyInPandasWithState(_step, EVENT, "state binary", "append", "NoTimeout")


def buckets_for(rows: int) -> int:
    return max(16, -(-rows // ROWS_PER_BUCKET))


def bucket_of(conv_id, buckets: int):
    return F.pmod(F.xxhash64(conv_id), F.lit(buckets)).cast("int")


def feed(arrivals: DataFrame, batches: int, buckets: int, path: str) -> None:
    """Writes arrivals (batch from 0, conv_id, turn, first, role, text) below path, a folder a batch, each with its ticks, and one last batch of ticks alone."""
    spark = arrivals.sparkSession
    # equal turns of a batch: the smallest payload arrives; strings compare by their UTF-8 bytes
    rows = (
        arrivals.groupBy("batch", "conv_id", "turn")
        .agg(F.min("first").alias("first"), F.min(F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), "role", "text")).alias("x"))
        .select(F.col("batch").cast("int").alias("batch"), bucket_of("conv_id", buckets).alias("bucket"), "conv_id", "turn", "first", "x.role", "x.text", F.lit(False).alias("tick"), F.lit(False).alias("last"))
    )
    zero = F.lit(0).cast("long")
    ticks = spark.range((batches + 1) * buckets).select(
        F.floor(F.col("id") / buckets).cast("int").alias("batch"),
        F.pmod("id", F.lit(buckets)).cast("int").alias("bucket"),
        zero.alias("conv_id"), zero.alias("turn"), zero.alias("first"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("tick"),
        (F.col("id") >= batches * buckets).alias("last"),
    )
    files = F.pmod("bucket", F.lit(max(1, buckets // 8)))
    rows.union(ticks).withColumn("part", F.col("batch")).repartition("part", files).write.partitionBy("part").parquet(path)


def run_batches(spark: SparkSession, staged: str, batches: int, root: str) -> DataFrame:
    """Moves one batch after the other to the stream's inbox and starts the query anew for each, on one checkpoint. Returns the events as a table."""
    inbox, out, fs = f"{root}/inbox", f"{root}/events", _at(spark, root)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(inbox))
    for b in range(batches + 1):
        fs.rename(path(f"{staged}/part={b}"), path(f"{inbox}/b{b:06d}"))
        arrivals = spark.readStream.schema(ARRIVAL).option("recursiveFileLookup", "true").parquet(inbox)
        query = reassemble(arrivals).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(out)
        query.awaitTermination()
    for done in (staged, inbox):  # the events and the checkpoint stay
        fs.delete(path(done), True)
    return spark.read.schema(EVENT).parquet(out)


# ---- the query

BATCHES = 12


def arrivals_of(conversations: DataFrame) -> DataFrame:
    """Each row in a batch that its hash gives; some again, in another batch, as the user's."""
    rows = conversations.filter("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("first"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "conv_id", "turn"), 256), 1, 8), 16, 10).cast("long")
    rows = rows.join(first, "conv_id").withColumn("h", h)
    once = F.struct((F.col("h") % BATCHES).alias("batch"), "role")
    again = F.struct(((F.col("h") + 5) % BATCHES).alias("batch"), F.lit("user").alias("role"))
    times = F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once))
    return rows.select("conv_id", "turn", "first", "text", F.explode(times).alias("t")).select("t.batch", "conv_id", "turn", "first", "t.role", "text")


def op13_turn_reassembly(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    root = shared_dir(spark, "reassembly")
    feed(arrivals_of(rows), BATCHES, buckets_for(rows.count()), f"{root}/staged")
    events = run_batches(spark, f"{root}/staged", BATCHES, root)
    content = F.when(F.col("event") == "close", F.array_join("pending", ",")).otherwise(F.concat("role", F.lit("|"), "text"))
    return events.select("event", "conv_id", "turn", "batch", F.sha2(content, 256).alias("sha256"), "n_missing", "n_breaks")


SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, ('0x' || substr(sha256(conv_id || ':' || turn), 1, 8))::BIGINT AS h,
    min(turn) OVER (PARTITION BY conv_id) AS first
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (
  SELECT conv_id, turn, first, batch, role, role || '|' || text AS payload
  FROM (SELECT *, h % 12 AS batch FROM r UNION ALL SELECT * REPLACE ('user' AS role), (h + 5) % 12 FROM r WHERE h % 7 < 2)
  QUALIFY row_number() OVER (PARTITION BY batch, conv_id, turn ORDER BY role || '|' || text, role) = 1),
g AS (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS next FROM (SELECT DISTINCT conv_id, batch FROM a)),
c AS (SELECT conv_id, min(CASE WHEN batch < 10 THEN batch + 2 ELSE 12 END) AS closed FROM g WHERE next IS NULL OR next - batch > 2 GROUP BY conv_id),
k AS (
  SELECT conv_id, turn, first, batch, role, payload, closed FROM a JOIN c USING (conv_id) WHERE batch <= closed
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY batch) = 1),
o AS (
  SELECT *, turn - first = row_number() OVER w - 1 AS released, max(batch) OVER w AS ready, lag(turn) OVER w = turn - 1 AND lag(role) OVER w = role AS again
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'reject' AS event, conv_id, turn, batch, sha256(payload) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM a JOIN c USING (conv_id) WHERE batch > closed
UNION ALL SELECT 'release', conv_id, turn, ready, sha256(payload), NULL, NULL FROM o WHERE released
UNION ALL SELECT 'close', conv_id, -1, any_value(closed), sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (NOT released), '')),
  max(turn) - any_value(first) + 1 - count(*), count(*) FILTER (again) FROM o GROUP BY conv_id"""
