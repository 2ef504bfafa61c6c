"""What the two classifiers share: which rows teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def label_rows(labels: DataFrame, column: str, modulus: int, kept_out: int) -> DataFrame:
    """(doc_id, y) of the labels that may teach: 0 or 1, one row a document (the greatest, should they differ)."""
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    return mine.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder("doc_id", modulus) != kept_out)).groupBy("doc_id").agg(F.max("y").alias("y"))


def bounded_sample(rows: DataFrame, most: int, n_rows: int, seed: int = 7) -> DataFrame:
    """About `most` rows of n_rows, by a hash of the document id; all of them if there are no more. The same rows on every run."""
    if n_rows <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most / n_rows))
