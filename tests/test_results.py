"""The sink of results: documents, commits, lost tasks."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveline.sources import results

ROWS = [(1, "a", ["x", None]), (1, "a", ["x", None]), (2, None, None), (3, "", []), (4, 'q"\\\n é😀' * 5000, ["\t"])]
SCHEMA = "id long, `odd.name` string, list array<string>"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_append_replace_vacuum(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert results.read_results(spark, path, SCHEMA).count() == 0
    results.write_results(df, path)
    assert rows_of(results.read_results(spark, path, SCHEMA)) == rows_of(df)
    results.write_results(df, path)
    assert rows_of(results.read_results(spark, path, SCHEMA)) == sorted(rows_of(df) * 2)
    before = results.read_results(spark, path, SCHEMA)
    results.write_results(df.filter("id = 2"), path, replace=True)
    assert [r["id"] for r in results.read_results(spark, path, SCHEMA).collect()] == [2]
    assert before.count() == 10  # an earlier reader goes on
    assert results.vacuum(path) > 0 == results.vacuum(path)
    assert [r["id"] for r in results.read_results(spark, path, SCHEMA).collect()] == [2]
    results.write_results(df.filter("false"), path, replace=True)
    assert results.read_results(spark, path, SCHEMA).count() == 0


def test_documents_are_lines_with_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    results.write_results(spark.createDataFrame([(2, None, None)], SCHEMA), path)
    (part,) = results.committed(path)
    raw = (tmp_path / "t" / "parts" / part.name).read_bytes()
    assert (len(raw), part.rows) == (part.bytes, 1) and json.loads(raw) == {"id": 2, "odd.name": None, "list": None}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("v"))
    results.write_results(spark.range(3).select(F.col("id").cast("string").alias("v")), path)
    with pytest.raises(Exception, match="broken"):
        results.write_results(bad, path)
    assert results.read_results(spark, path, "v string").count() == 3
    assert {p.name for p in (tmp_path / "t" / "parts").iterdir()} == {p.name for p in results.committed(path)}


KILLED = """
import os, signal, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from sieveline.sources import results
path = sys.argv[1]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.execution.arrow.maxRecordsPerBatch", "100").getOrCreate()

def dies_once(batches):
    t = TaskContext.get()
    for i, b in enumerate(batches):
        if t.partitionId() == 1 and t.attemptNumber() == 0 and i == 5:
            os.kill(os.getpid(), signal.SIGKILL)
        yield b

results.write_results(spark.range(0, 4000, 1, 4).mapInArrow(dies_once, "id long"), path)
got = sorted(r["id"] for r in results.read_results(spark, path, "id long").collect())
assert got == list(range(4000)), len(got)
print("parts", len(results.committed(path)))
"""


def test_a_killed_task_is_done_again(tmp_path):
    """A worker is killed in the midst of a part; its second attempt counts, once."""
    said = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path / "t")], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=180)
    assert said.returncode == 0, said.stderr[-3000:]
    assert said.stdout.split()[-2:] == ["parts", "4"]
