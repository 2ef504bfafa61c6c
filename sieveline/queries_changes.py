"""Queries on an index that took changes, and the same in SQL over the corpus as it is after them.

The documents come in four steps: seven tenths at first; then a tenth is new and a tenth changed; then a tenth is new, a tenth deleted and a part
of what was changed changed back; at last the later segments are merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import queries
from sieveline.functions import storage
from sieveline.operators import segments, textindex
from sieveline.sources import tables

AFTER_FIRST, AFTER_CHANGES, AFTER_MERGE = 1, 3, 4
_MADE: dict[tuple, str] = {}


def changed_index(spark: SparkSession, d: str) -> segments.SegmentedIndex:
    """Made once an application and table."""
    at = spark.sparkContext.applicationId, storage.version(spark, f"{d}/documents.parquet")
    if at not in _MADE or not storage.exists(spark, f"{_MADE[at]}/versions/{AFTER_MERGE:08d}.json"):
        index = segments.SegmentedIndex(spark, storage.shared_path(spark, "changed-index"))
        docs, part = tables.documents(spark, d), F.col("ord") % 10
        other = docs.withColumn("text", F.concat("text", F.lit(" license software")))
        index.apply(docs.filter(part < 7))
        index.apply(docs.filter(part == 7).union(other.filter(part == 2)))
        index.apply(docs.filter((part == 8) | (F.col("ord") % 30 == 2)), docs.filter(part == 4).select("key"))
        index.merge(1)
        _MADE[at] = index.path
    return segments.SegmentedIndex(spark, _MADE[at])


def chg_first(spark: SparkSession, d: str) -> DataFrame:
    """The version before the changes, read after them."""
    return textindex.search(changed_index(spark, d).open(AFTER_FIRST), queries.SEARCH_TEXT, 20, 0.05).select("key", "score", "rank")


def chg_search(spark: SparkSession, d: str) -> DataFrame:
    return textindex.search(changed_index(spark, d).open(AFTER_CHANGES), queries.SEARCH_TEXT, 20, 0.05).select("key", "score", "rank")


def chg_idf(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies as sums of differences; no norms are asked for."""
    index = changed_index(spark, d)
    return index.idf(index.version(AFTER_CHANGES)).select("term", "df", F.round("idf", 6).alias("idf"))


def chg_merged(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text against the merged index."""
    asked = tables.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return textindex.search_batch(changed_index(spark, d).open(AFTER_MERGE), asked).select("query_id", "key", "score", "rank")


_TEXT_AFTER = "CASE WHEN doc_id % 10 = 2 AND doc_id % 30 <> 2 THEN text || ' license software' ELSE text END"
FIRST_SQL = "\ndoc AS (SELECT doc_id AS ord, upper(lang) || '-' || doc_id AS key, text FROM documents WHERE doc_id % 10 < 7)"
AFTER_SQL = f"\ndoc AS (SELECT doc_id AS ord, upper(lang) || '-' || doc_id AS key, {_TEXT_AFTER} AS text FROM documents WHERE doc_id % 10 NOT IN (4, 9))"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {f.__name__: f for f in (chg_first, chg_search, chg_idf, chg_merged)}
_HITS = "key, score, CAST(rank AS INTEGER) AS rank"
SQL: dict[str, str] = {
    "chg_first": queries.search_sql(queries.terms_sql(queries.SEARCH_TEXT), 20, 0.05, docs=FIRST_SQL).format(_HITS),
    "chg_search": queries.search_sql(queries.terms_sql(queries.SEARCH_TEXT), 20, 0.05, docs=AFTER_SQL).format(_HITS),
    "chg_idf": f"WITH {queries.text_sql(AFTER_SQL)}\nSELECT term, df, round(idf, 6) AS idf FROM idf",
    "chg_merged": queries.search_sql(queries.BENCH_SQL, 5, 0.1, docs=AFTER_SQL).format(f"query_id, {_HITS}"),
}
