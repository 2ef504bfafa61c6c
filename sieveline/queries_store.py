"""Filters on the clustered store of tickets; the SQL is that of the same filters on the tickets themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline import queries
from sieveline.functions import storage
from sieveline.queries import Query
from sieveline.sources import store, tables

_WRITTEN: dict[tuple, str] = {}
_TABLES = ("orders", "customer", "nation", "region", "lineitem", "part")


def stored(spark: SparkSession, d: str, arrays: bool = True) -> DataFrame:
    """Written once an application and state of the tables, whole: tickets clustered, and their labels and components by ord, which stand apart so that
    they need not travel with the tickets. arrays=False leaves these two columns empty on reading."""
    at = spark.sparkContext.applicationId, *(storage.version(spark, f"{d}/{t}.parquet") for t in _TABLES)
    if at not in _WRITTEN or not storage.exists(spark, _WRITTEN[at]):
        path = storage.shared_path(spark, "tickets-store")
        store.write(tables.order_rows(spark, d), f"{path}/tickets", fields=tables.order_fields())
        storage.written(tables.order_lists(spark, d).withColumnRenamed("o_orderkey", "ord"), f"{path}/lists")
        _WRITTEN[at] = path
    tickets = store.read(spark, f"{_WRITTEN[at]}/tickets")
    return store.with_lists(tickets, store.read(spark, f"{_WRITTEN[at]}/lists")) if arrays else tickets


NAMES = {f"sto_{n.removeprefix('flt_')}": n for n in ("flt_eq", "flt_in_scalar", "flt_is_null", "flt_date_ge", "flt_date_lt", "flt_date_zoneless", "flt_date_unreadable", "flt_days_ago", "flt_weeks_ago", "flt_hours_ago", "flt_conj", "flt_or")}


def _filter(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return store.apply(stored(spark, d, name in queries._NEEDS_ARRAYS), (queries.FILTERS | queries.RELATIVE)[name], queries.NOW, ordered=False).select("ord", "key", "status", "priority")

    return run


QUERIES: dict[str, Query] = {new: _filter(old) for new, old in NAMES.items()}
SQL: dict[str, str] = {new: queries.SQL[old] for new, old in NAMES.items()}
