"""Conversation prefix trie by partition refinement.

All conversations begin in one class, the root. In each round the members of every class are split by their next turn; a part is the class, and the
node, one turn deeper. A part of one member is retired at once: the rest of its conversation is a unary chain, which is emitted from its length
alone, without further rounds. Rounds go on until every class is retired or ended, so there are as many as the longest shared prefix has
turns. Then child counts, leaves and saved tokens are folded back, depth by depth, from the deepest class to the root.

A class is named by its depth and its least member. Splits are counted by partial aggregation and looked up by a join, which adaptive execution
splits where one part is hot; turns stand as rows beside their digest, so that a conversation of any length is never one value; turn numbers are
counted in blocks of turn numbers. Each round reads what the one before wrote to the shared folder.

`ends_sha256` of one node is one hash over all its ids in their order. The ids are sorted and joined to chunks over range partitions; then the
chunks of a node pass through one task, which holds one at a time, as the hash can't be computed in parts.

Defined results: null roles and texts are empty; rows of one turn number are ordered by role and text, null numbers come first, and repeated
rows stay repeated turns; rows without conv_id belong to no conversation and make none; a text of any length is compared by the SHA-256 of role and
text; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.shared import Scratch, cut, table

#: Turn numbers in a block; a conversation's turns are counted by block, then blocks are added up.
BLOCK = 4096
#: Ids in one chunk of a node's list.
CHUNK = 1 << 15

EMPTY = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """Two turns have one digest if and only if role and text are equal: the role's length is part of it."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, role, text): turns in order, nulls empty."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62))).alias("block"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "block").count().select("conv_id", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return rows.withColumn("within", within).join(before, ["conv_id", "block"]).select("conv_id", (F.col("before") + F.col("within")).alias("depth"), "role", "text")


def refine(members: DataFrame, turns: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame], DataFrame, DataFrame] | None:
    """members: conv_id, n_turns. turns: conv_id, depth, digest, size. By depth from 0: classes (id, parent, n, size) and the counts of parts of one
    member by parent (parent, singles); then the chains (conv_id, parent, depth, n_turns) and the ended members of classes (depth, id, conv_id)."""
    root = members.agg(F.min("conv_id").alias("id"), F.count("*").alias("n")).first()
    if not root["n"]:
        return None
    spark = members.sparkSession
    active = members.select("conv_id", "n_turns", F.lit(root["id"]).alias("cls"))
    classes = [spark.createDataFrame([(root["id"], None, root["n"], 0)], "id long, parent long, n long, size long")]
    singles, chains = [], []
    ended = [active.filter("n_turns = 0").select(F.lit(0).alias("depth"), F.lit(root["id"]).alias("id"), "conv_id")]
    depth = 0
    while True:
        depth += 1
        now = turns.filter(F.col("depth") == depth).select("conv_id", "digest", "size")
        step = scratch.cut(active.filter(F.col("n_turns") >= depth).join(now, "conv_id"), "trie-step")
        parts = scratch.cut(
            step.groupBy("cls", "digest").agg(F.count("*").alias("n"), F.min("conv_id").alias("id"), F.max("size").alias("size"), F.max("n_turns").alias("n_turns")), "trie-parts"
        )
        alone = parts.filter("n = 1")
        chains.append(alone.select(F.col("id").alias("conv_id"), F.col("cls").alias("parent"), F.lit(depth).alias("depth"), "n_turns"))
        singles.append(alone.groupBy(F.col("cls").alias("parent")).agg(F.count("*").alias("singles")))
        shared = parts.filter("n > 1")
        if shared.isEmpty():
            return classes, singles, _all(chains), _all(ended)
        classes.append(shared.select("id", F.col("cls").alias("parent"), "n", "size"))
        active = scratch.cut(step.select("conv_id", "n_turns", "cls", "digest").join(shared.select("cls", "digest", "id"), ["cls", "digest"]).select("conv_id", "n_turns", F.col("id").alias("cls")), "trie-active")
        ended.append(active.filter(F.col("n_turns") == depth).select(F.lit(depth).alias("depth"), F.col("cls").alias("id"), "conv_id"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out, *rest = parts
    for p in rest:
        out = out.union(p)
    return out


def fold(classes: list[DataFrame], singles: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(depth, id, parent, n, n_children, n_leaves, saved) of all classes, from the deepest up."""
    done, below = [], None
    for depth in reversed(range(len(classes))):
        found = singles[depth].select("parent", F.col("singles").alias("n_children"), F.col("singles").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
        if below is not None:
            found = found.union(below.select("parent", F.lit(1).cast("long"), "n_leaves", "saved"))
        sums = found.groupBy("parent").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")))
        at = classes[depth].select("id", "n", F.col("parent").alias("above"), ((F.col("n") - 1) * F.col("size")).alias("own"))
        below = scratch.cut(
            at.join(sums, at["id"] == sums["parent"], "left").select(
                F.lit(depth).alias("depth"),
                "id",
                F.col("above").alias("parent"),
                "n",
                F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
                (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved"),
            ),
            "trie-fold",
        )
        done.append(below)
    return _all(done)


def id_hashes(ended: DataFrame) -> DataFrame:
    """(depth, id, ends_sha256) of ended (depth int, id, conv_id): the hash over each node's ids, ascending, with commas between."""
    order = ["depth", "id", "conv_id"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["depth", "id", "first", "ids"])

        for b in batches:
            for *x, conv in zip(*(b[c].to_pylist() for c in order), strict=True):
                if ids and (x != node or len(ids) >= CHUNK):
                    yield out()
                    ids = []
                node = x
                ids.append(conv)
        if ids:
            yield out()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        done: list[tuple] = []
        for b in batches:
            for *x, ids in zip(*(b[c].to_pylist() for c in ("depth", "id", "ids")), strict=True):
                if x == node:
                    h.update(b",")
                else:
                    if h:
                        done.append((*node, h.hexdigest()))
                    node, h = x, hashlib.sha256()
                h.update(ids.encode())
            if len(done) >= 10_000:
                yield _columns(done)
                done = []
        if h:
            done.append((*node, h.hexdigest()))
        if done:
            yield _columns(done)

    joined = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth int, id long, first long, ids string")
    return joined.repartition("depth", "id").sortWithinPartitions("depth", "id", "first").mapInArrow(hashes, "depth int, id long, ends_sha256 string")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("depth", pa.int32()), ("id", pa.int64()), ("ends_sha256", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node. members: conv_id, each once, those without turns too. turns: conv_id, depth (1 to its number of turns), role, text.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (UTF-8 bytes), ends_sha256, all long but the last.
    """
    with Scratch(members.sparkSession) as scratch:
        keyed = turns.select("conv_id", "depth", digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"))
        keyed = scratch.cut(keyed.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth"), "trie-turns")  # a round reads the row groups of its depth
        lengths = keyed.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
        members = scratch.cut(members.select("conv_id").join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns")), "trie-members")
        refined = refine(members, keyed, scratch)
        if refined is None:
            return cut(members.sparkSession.createDataFrame([], NODE), "trie")
        classes, singles, chains, ended = refined
        folded = fold(classes, singles, scratch)
        shared = folded.join(id_hashes(ended), ["depth", "id"], "left").select(
            F.col("id").alias("conv_id"),
            F.col("depth").cast("long").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        )
        links = chains.select("conv_id", "parent", F.col("depth").cast("long").alias("top"), "n_turns").select("*", F.explode(F.sequence("top", "n_turns")).alias("depth"))
        one, last = F.lit(1).cast("long"), F.col("depth") == F.col("n_turns")
        alone = links.select(
            "conv_id",
            "depth",
            F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            one.alias("n_convs"),
            F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
            one.alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
        )
        return cut(shared.union(alone), "trie")


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds role and text of each node's last turn; null at the root."""
    return nodes.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")


# ---- the query

GROUP, SHARED = 5, 9


def regrown(turns: DataFrame) -> DataFrame:
    """Every conversation c: the first h turns of conversation c - c % 5, then its own after its first h; h = crc32(c) % 9. turns: as `turns_of` gives them."""
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h")
    lengths = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    heads = lengths.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    plan = lengths.select("conv_id", h, (F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))).alias("head")).join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("head_n", F.lit(0))))
    first = turns.filter(F.col("depth") < SHARED).withColumnRenamed("conv_id", "head")
    given = plan.select("conv_id", "head", "taken").join(first, "head").filter("depth <= taken").select("conv_id", "depth", "role", "text")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    return given.union(own)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    with Scratch(spark) as scratch:
        turns = scratch.cut(turns_of(rows), "trie-input")
        return trie(turns.select("conv_id").distinct(), regrown(turns))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1))))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth
  FROM (SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c.head AND k <= h
    UNION ALL SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND k > h)),
p AS (
  SELECT conv_id, depth, strlen(text) AS size,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key
  FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT conv_id, depth, size, min(conv_id) OVER (PARTITION BY depth, key) AS node, max(depth) OVER (PARTITION BY conv_id) AS n_turns FROM p),
n AS (
  SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * max(size) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n_turns = depth), '')) AS ends_sha256
  FROM m GROUP BY node, depth),
u AS (SELECT n.node, n.depth, m.node AS parent FROM n JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM u GROUP BY ALL),
s AS (
  SELECT a.node, a.depth, sum(n.own) AS saved, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM n LEFT JOIN k USING (node, depth) JOIN m a ON a.conv_id = n.node AND a.depth <= n.depth GROUP BY a.node, a.depth)
SELECT n.node AS conv_id, n.depth, u.parent AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (node, depth) LEFT JOIN u USING (node, depth) LEFT JOIN k USING (node, depth)"""
