"""Positions in a total order without sending all rows through one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.storage import shared_path, written

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def numbered(df: DataFrame, order: list[Column], name: str = "rank", first: int = 1) -> DataFrame:
    """Adds the position of each row in `order`, which must be total. Rows are range-partitioned, sorted in place and written with their places to the
    shared folder: a second computation could draw other bounds. The sizes of the partitions, one number each, come to the driver and become offsets."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, shared_path(df.sparkSession, "numbered"))
    sizes = {r["p"]: r["count"] for r in placed.groupBy(F.shiftright("_at", _ROW_BITS).alias("p")).count().collect()}
    offsets = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)), initial=first))
    start = F.get(F.array(*map(F.lit, offsets)), F.shiftright("_at", _ROW_BITS).cast("int"))
    return placed.withColumn(name, (start + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).cast("long")).drop("_at")
