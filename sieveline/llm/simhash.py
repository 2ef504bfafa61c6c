"""SimHash near-duplicates: fingerprints, exact pairs within a Hamming radius by vantage points, connected components.

Fingerprints of word shingles are 64-bit majority votes. Texts with equal fingerprints collapse to one point before the search.
The 64 bits are four blocks of 16, and two points at distance 3 or less agree in one block at least. In each of the four projections points are dealt
to shards by the Hamming distances of their block to a few vantage points: points that agree there have the same distances, so the boundary
overlaps that the search needs are empty, and no linked pair is split over shards (each point stands in four). The number of vantage points grows
with the number of points, which sets the size of shards and nothing else. A shard too large for one task is dealt again by its block, then by four
sub-blocks of the remaining bits, by the same argument, until it is small or so few bits remain free that it can't be large. Inside a shard a
vantage-point tree parts the points at the median distance; pairs across the part are sought only among points within the radius of the
boundary, as the triangle inequality rules out all others.

A shard emits a spanning forest of its links rather than all pairs, which keeps reachability and grows with points, not with
their square. Components come from `components.connected_components`.

Defined results: null and empty texts have fingerprint zero and link like any other; texts under three words use the whole word
sequence as one shingle; repeated rows share a fingerprint; ties between doc ids take the least, a null doc id never names a component
unless nothing else is in it; very long texts are read whole, their votes counted in pieces; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.components import connected_components
from sieveline.llm.shared import Scratch, cut, free_names, table

RADIUS = 3
SHINGLE = 3
SEED = 42

#: A shard with more points is dealt again by its remaining bits.
SHARD_POINTS = 20_000
#: Points that a shard should have in the mean, and the most vantage points a block is measured from.
SHARD_MEAN, VANTAGE = 2_000, 5
#: Below this a tree node compares all its pairs at once.
LEAF = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit. bytes.lower and bytes.split treat A-Z and U+0009-U+000D, U+0020 only."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(p, SEED) for p in parts), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[at : at + (1 << 16)].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t) for t in b["text"].to_pylist()), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# ---- pairs within the radius, inside a shard


class Forest:
    """Union-find over the points of a shard."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def _link_all(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """Compares all of a with all of b; dense matches are first contracted by minimum labels, so few links reach the forest."""
    near = np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= radius
    i, j = np.nonzero(near)
    if len(i) > 2 * (len(a) + len(b)):
        mine, theirs = np.arange(len(a)), np.full(len(b), len(a))
        while True:
            theirs = np.minimum(theirs, np.where(near, mine[:, None], len(a)).min(0))
            now = np.minimum(mine, np.where(near, theirs[None, :], len(a)).min(1))
            if (now == mine).all():
                break
            mine = now
        forest.link(a, a[mine])
        met = theirs < len(a)
        forest.link(b[met], a[theirs[met]])
        return
    forest.link(a[i], b[j])


def _cross(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """Links between the index sets a and b: all pairs if few, else both are parted at a vantage point of the larger set."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if len(a) == 0 or len(b) == 0:
            continue
        if len(a) * len(b) <= LEAF * LEAF:
            _link_all(points, a, b, radius, forest)
            continue
        v = points[a[0]] if len(a) >= len(b) else points[b[0]]
        da, db = (np.bitwise_count(points[x] ^ v).astype(np.int16) for x in (a, b))
        m = min(int(np.median(np.concatenate([da, db]))), int(max(da.max(), db.max())) - 1)
        parts = [(a[da <= m], b[db <= m]), (a[da > m], b[db > m]), (a[(da <= m) & (da > m - radius)], b[(db > m) & (db <= m + radius)]), (a[(da > m) & (da <= m + radius)], b[(db <= m) & (db > m - radius)])]
        if any(len(x) == len(a) and len(y) == len(b) for x, y in parts):  # a dense spot that no boundary parts: halve it
            long, other = (a, b) if len(a) >= len(b) else (b, a)
            parts = [(long[: len(long) // 2], other), (long[len(long) // 2 :], other)]
        todo += parts


def link_points(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For different uint64 points the index of each one's root in the forest of links within the radius."""
    forest = Forest(len(points))
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            _link_all(points, at, at, radius, forest)
            continue
        d = np.bitwise_count(points[at] ^ points[at[0]]).astype(np.int16)
        m = min(int(np.median(d)), int(d.max()) - 1)  # different points: the vantage point is at 0, some other is farther
        todo += [at[d <= m], at[d > m]]
        _cross(points, at[(d <= m) & (d > m - radius)], at[(d > m) & (d <= m + radius)], radius, forest)
    return np.fromiter((forest.root(i) for i in range(len(points))), np.int64, len(points))


# ---- shards


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    edges = [bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _dealt(points: DataFrame, free: str, width: int, radius: int) -> DataFrame:
    """Each point once for every block of its free bits: block, value there, and the bits that stay free."""
    sides = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.col(free), at).bitwiseAND((1 << n) - 1).alias("value"),
                      _without(F.col(free), at, n, width).alias("rest")) for k, (at, n) in enumerate(_blocks(width, radius + 1))]
    return points.withColumn("b", F.explode(F.array(*sides)))


def _without(bits, at: int, n: int, width: int):
    """bits without the n from position at: what lies above moves down."""
    low = bits.bitwiseAND((1 << at) - 1) if at else F.lit(0).cast("long")
    high = F.shiftrightunsigned(bits, at + n) if at + n < width else F.lit(0).cast("long")
    return F.shiftleft(high, at).bitwiseOR(low)


def vantage_points(n: int, bits: int = 16) -> list[int]:
    """For n points the blocks that distances are measured from: each parts points about eight ways."""
    count = min(VANTAGE, max(1, -(-max(n // SHARD_MEAN, 1).bit_length() // 3)))
    return [xxhash.xxh64_intdigest(bytes([j]), SEED) & ((1 << bits) - 1) for j in range(count)]


def shard(points: DataFrame, radius: int = RADIUS, most: int = SHARD_POINTS, scratch: Scratch | None = None) -> DataFrame:
    """(fp, shard): two points within the radius share a shard at least."""
    _, widest = max(_blocks(64, radius + 1), key=lambda b: b[1])
    now, width, by_block, done = _dealt(points.select("fp", F.col("fp").alias("free")), "free", 64, radius), 64 - widest, False, None
    seen = [F.bit_count(F.col("b.value").bitwiseXOR(F.lit(v))) for v in vantage_points(points.count(), widest)]
    write = scratch.cut if scratch else cut
    now = now.select("fp", F.xxhash64("b.k", *seen).alias("shard"), F.col("b.value").alias("block"), F.col("b.rest").alias("free"))
    while True:
        large = write(now.groupBy("shard").count().filter(F.col("count") > most).select("shard"), "simhash-large")
        if large.isEmpty() or (by_block and 1 << width <= max(most, 1 << 14)):
            rest = now.select("fp", "shard")
            return rest if done is None else done.union(rest)
        small = now.join(large, "shard", "left_anti").select("fp", "shard")
        done = small if done is None else done.union(small)
        now = now.join(large, "shard", "left_semi")
        if not by_block:
            now, by_block = now.withColumn("shard", F.xxhash64("shard", "block")), True
            continue
        now = _dealt(now, "free", width, radius).select("fp", F.xxhash64("shard", "b.k", "b.value").alias("shard"), F.lit(0).cast("long").alias("block"), F.col("b.rest").alias("free"))
        width -= -(-width // (radius + 1))


#: In shards up to this size neighbours are compared for all shards of a batch at once.
TINY = 6


def _shard_links(fp: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole shards; rows sorted by key."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.repeat(np.diff(cuts), np.diff(cuts))
    u, v = [], []
    bits = fp.view(np.uint64)
    for k in range(1, TINY):
        same = np.flatnonzero((key[k:] == key[:-k]) & (sizes[k:] <= TINY))
        near = same[np.bitwise_count(bits[same] ^ bits[same + k]) <= radius]
        u.append(fp[near]), v.append(fp[near + k])
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if z - a > TINY:
            own = np.sort(fp[a:z])
            root = link_points(own.view(np.uint64), radius)
            far = root != np.arange(z - a)
            u.append(own[far]), v.append(own[root[far]])
    return np.concatenate(u), np.concatenate(v)


def links(points: DataFrame, radius: int = RADIUS, most: int = SHARD_POINTS, scratch: Scratch | None = None) -> DataFrame:
    """(u, v): as many components as all pairs of different points within the radius have, by few links a point. points: fp, all different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, key = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            fp, key = np.concatenate([fp, b["fp"].to_numpy()]), np.concatenate([key, b["shard"].to_numpy()])
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last shard may go on
            if whole > 50_000:
                yield out(*_shard_links(fp[:whole], key[:whole], radius))
                fp, key = fp[whole:], key[whole:]
        if len(key):
            yield out(*_shard_links(fp, key, radius))

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return shard(points, radius, most, scratch).repartition(F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = SHARD_POINTS) -> DataFrame:
    """(doc_id, fp, component_id): every row of docs; component_id is the least doc id that can be reached over links."""
    with Scratch(docs.sparkSession) as scratch:
        fps = scratch.cut(fingerprints(docs), "simhash-fp")
        points = scratch.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
        nodes = connected_components(links(points.select("fp"), radius, most, scratch), "simhash-components", scratch)
        rooted = points.join(nodes, points["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        rooted = scratch.cut(rooted, "simhash-roots")
        named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        by_fp = rooted.join(named, "root").select("fp", "component_id")
        return cut(fps.join(by_fp, "fp").select("doc_id", "fp", "component_id"), "simhash-named")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs, all columns as they are, with one row of each component: of least doc id, then of least text hash. Rows without an id can't be named and all stay;
    of rows that are equal in id and text any one stays, with its other columns. Columns of any name may stand beside them."""
    its_id, its_mark = free_names(docs, "chosen_id", "chosen_mark")
    named = docs.filter("doc_id is not null")
    rows = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    with Scratch(docs.sparkSession) as scratch:
        marks = scratch.cut(rows.select("mark", "text").dropDuplicates(["mark"]), "simhash-marks")
        # a text's component does not depend on its id: the search runs over the different texts, named by their hashes
        found = near_duplicates(marks.select(F.col("mark").alias("doc_id"), "text"), radius).select(F.col("doc_id").alias("mark"), F.col("component_id").alias("part"))
        chosen = rows.select("doc_id", "mark").join(found, "mark").groupBy("part").agg(F.min(F.struct("doc_id", "mark")).alias("c"))
        chosen = cut(chosen.select(F.col("c.doc_id").alias(its_id), F.col("c.mark").alias(its_mark)), "simhash-chosen")
    kept = named.join(chosen, (F.col("doc_id") == F.col(its_id)) & (F.xxhash64("text") == F.col(its_mark)), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(docs.columns).union(docs.filter("doc_id is null"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
