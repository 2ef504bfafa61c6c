"""Connected components of a link table: alternating star contraction on DataFrames, nothing on the driver.

A table of at most `ONE_TASK` links is contracted by one task instead, which gives the same roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.shared import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's least neighbour (or itself)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are linked to the least of them. links: u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


#: So many links (16 bytes each) go to one task.
ONE_TASK = 100_000


def _by_one_task(links: DataFrame) -> DataFrame:
    """(u, v): v is the least node that u can be reached from. links: at most ONE_TASK rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for b in batches:
            for x, y in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return links.coalesce(1).mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, label: str = "components", scratch: Scratch | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): root is the least node that can be reached. links: u, v (long), u <> v, in any order, repeats allowed.

    Each round is written to the shared folder, so no round depends on an executor's memory or disk, and the round before is deleted; the number of
    rounds grows with the logarithm of the longest chain. Only a count and a checksum reach the driver. A hub's links are many rows of one
    key only in joins, which adaptive execution splits; its minimum is found by partial aggregation. The result goes with scratch, if that is given.
    """
    own = Scratch(links.sparkSession)
    now = own.cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), label)
    if now.count() <= one_task:
        now = own.renew(_by_one_task(now), label)
        if scratch:
            scratch.paths += own.paths
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = None
    while True:
        now = own.renew(_small_star(_large_star(now).distinct()).distinct(), label)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            if scratch:
                scratch.paths += own.paths
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
