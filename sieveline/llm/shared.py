"""What several operators of this package need: inputs, the shared folder, whole-text word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.storage import delete, written
from sieveline.functions.storage import shared_path as shared_dir
from sieveline.functions.workers import send_package

#: The white space that separates words: space and U+0009 to U+000D, nothing else. ``bytes.split()`` splits on the same set.
BLANKS = "\t\n\x0b\x0c\r "

#: Bytes of an Arrow batch that goes to a Python worker: few long texts make one as well as many short ones.
BATCH_BYTES = 8 << 20


def reachable(spark: SparkSession) -> None:
    """Sends this package to the Python workers, bounds their batches in bytes, and lets each query's shuffle files go when it ends."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    send_package(spark)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again. A lost executor costs nothing that is written."""
    return written(df, shared_dir(df.sparkSession, label))


class Scratch:
    """Tables that are cut and no longer needed when the block ends: their files go then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(shared_dir(self.spark, label))
        return written(df, self.paths[-1])

    def renew(self, df: DataFrame, label: str) -> DataFrame:
        """`cut`, after which the tables cut before go."""
        old, self.paths = self.paths, []
        df = self.cut(df, label)
        self._delete(old)
        return df

    def _delete(self, paths: list[str]) -> None:
        for p in paths:
            delete(self.spark, p)

    def __exit__(self, *_) -> None:
        self._delete(self.paths)
        self.paths = []


def words(text: Column) -> Column:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
