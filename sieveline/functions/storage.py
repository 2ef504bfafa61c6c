"""Tables written into the folder that all machines share, so that a lost executor costs nothing that is written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a local one is made on a local master where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: While this holds, the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes df and reads it again; what it was shuffled to on the way is gone then. The session's setting stays as it was."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: For columns of long values that many rows share. A dictionary that holds them writes each once a row group, where Parquet's own limit of 1 MB would have
#: them written and held once a row; and sizes are looked at every few rows, not every hundred to ten thousand, as so many long values fill a task's memory.
_LONG = {
    "parquet.dictionary.page.size": str(128 << 20),
    "parquet.page.size.row.check.min": "8",
    "parquet.page.size.row.check.max": "64",
    "parquet.block.size.row.check.min": "8",
    "parquet.block.size.row.check.max": "64",
}


def expect_long_values(spark: SparkSession) -> None:
    """Parquet files that this session writes from now on take long values that repeat, whoever writes them. What the session has set itself stays."""
    for k, v in _LONG.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def version(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: another value means another table."""
    fs, p = _at(spark, path)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))
