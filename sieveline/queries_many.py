"""Queries of many saved filters at once, and the same in SQL: one filter a customer against all tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import filtertable
from sieveline.queries import NOW, Query
from sieveline.sources import tables

#: Filters by the customer's number modulo their count; {name} and {n} are the customer's. Beside each the same over iss and c.
FORMS = (
    ("assignee = '{name}' AND status != Done", "assignee = c_name AND status <> 'Done'"),
    ("assignee = '{name}' OR key = 'ASIA-{n}'", "assignee = c_name OR key = 'ASIA-' || c_custkey"),
    ("priority IN (Critical, High) AND labels = 'promo'", "priority IN ('Critical', 'High') AND list_contains(labels, 'promo')"),
    ("(project = asia OR project = EUROPE) AND assignee = '{name}' ORDER BY created DESC", "split_part(key, '-', 1) IN ('ASIA', 'EUROPE') AND assignee = c_name"),
    ("assignee IS NULL AND resolution = fixed", "assignee IS NULL AND resolution = 'Fixed'"),
    ("summary ~ FURN AND created >= 1998-01-01", "contains(summary, 'furn') AND created_at >= TIMESTAMP '1998-01-01'"),
    ("", "true"),
    ("status is whatever", "false"),
    ("labels IN (promo, small) AND issuetype != Bug", "list_has_any(labels, ['promo', 'small']) AND (type IS NULL OR type <> 'Bug')"),
    ("resolution NOT IN (Fixed) AND (components = 'Brand#11' OR assignee = '{name}') AND created < -200d", "(resolution IS NULL OR resolution <> 'Fixed') AND (list_contains(components, 'Brand#11') OR assignee = c_name) AND created_at < TIMESTAMP '1997-08-13 06:00:00'"),
    ("assignee IN ({name}, nobody) AND description IS NOT EMPTY", "assignee = c_name AND description <> ''"),
)
BROKEN = 7


def saved_filters(spark: SparkSession, d: str) -> DataFrame:
    """(filter_id, text)."""
    n, name = F.col("c_custkey"), F.col("c_name")
    made: list[Column] = [F.replace(F.replace(F.lit(t), F.lit("{name}"), name), F.lit("{n}"), n.cast("string")) for t, _ in FORMS]
    return tables.read(spark, d, "customer").select(n.alias("filter_id"), F.get(F.array(*made), (n % len(FORMS)).cast("int")).alias("text"))


def _matches(spark: SparkSession, d: str) -> filtertable.Matches:
    return filtertable.match(tables.order_issues(spark, d), saved_filters(spark, d), NOW)


def flt_saved(spark: SparkSession, d: str) -> DataFrame:
    """How many tickets each customer's filter keeps, the sum of their numbers, or what is wrong with it."""
    return _matches(spark, d).totals("ord").select("filter_id", "error", "n", F.col("ord").alias("ord_sum"))


def flt_saved_rows(spark: SparkSession, d: str) -> DataFrame:
    """The tickets themselves, of filters that name their customer."""
    found = _matches(spark, d)
    found.filters = found.filters.filter(F.contains("text", F.lit("Customer#")))
    return found.rows().select("filter_id", "key")


_CASES = " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(FORMS))
_NAMED = ", ".join(str(i) for i, (text, _) in enumerate(FORMS) if "{name}" in text)
_JOIN = f"customer LEFT JOIN iss ON CASE c_custkey % {len(FORMS)} {_CASES} END"

QUERIES: dict[str, Query] = {f.__name__: f for f in (flt_saved, flt_saved_rows)}
SQL: dict[str, str] = {
    "flt_saved": f"""WITH {tables.ISSUES_SQL}
SELECT c_custkey AS filter_id, CASE WHEN c_custkey % {len(FORMS)} = {BROKEN} THEN 'Unable to parse JQL clause: {FORMS[BROKEN][0]}' END AS error,
  CASE WHEN c_custkey % {len(FORMS)} <> {BROKEN} THEN count(iss.key) END AS n, CAST(sum(ord) AS BIGINT) AS ord_sum
FROM {_JOIN} GROUP BY c_custkey""",
    "flt_saved_rows": f"""WITH {tables.ISSUES_SQL}
SELECT c_custkey AS filter_id, key FROM customer JOIN iss ON CASE c_custkey % {len(FORMS)} {_CASES} END WHERE c_custkey % {len(FORMS)} IN ({_NAMED})""",
}
