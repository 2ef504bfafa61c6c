"""The package on the Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def send_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application; functions that tasks import by name are then found on every machine."""
    if spark.conf.get("sieveline.sent", None):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="sieveline-")  # the driver serves the file from here as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    spark.conf.set("sieveline.sent", "true")
