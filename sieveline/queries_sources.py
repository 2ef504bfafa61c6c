"""Tables written out as one JSON object each, read back by ranges, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import storage
from sieveline.operators import access, filterlang, textindex
from sieveline.queries import Query
from sieveline.sources import bigjson, tables
from sieveline.sources.issues import ISSUE, Corpus

#: Least bytes of a range: small, so that the small tables have several.
RANGE = 256 << 10
_WRITTEN: dict[tuple, str] = {}


def _object(spark: SparkSession, d: str, name: str, write) -> str:
    """Written once an application and table."""
    at = name, spark.sparkContext.applicationId, storage.version(spark, f"{d}/orders.parquet")
    if at not in _WRITTEN or not storage.exists(spark, _WRITTEN[at]):
        path = storage.shared_path(spark, f"json-{name}")
        write(path)
        _WRITTEN[at] = path
    return _WRITTEN[at]


def json_corpus(spark: SparkSession, d: str) -> Corpus:
    """Orders as tickets, from one JSON object of issues and declared domains."""

    def write(path: str) -> None:
        issues = tables.order_issues(spark, d).select("ord", F.to_json(F.struct(*[f.name for f in ISSUE.fields])).alias("element"))
        listed = {"projects": [{"key": p, "name": p.title()} for p in tables.DOMAINS.projects], "statuses": list(tables.DOMAINS.statuses), "priorities": list(tables.DOMAINS.priorities), "issue_types": list(tables.DOMAINS.types)}
        bigjson.write_object(path, {"issues": issues}, listed)

    path = _object(spark, d, "corpus", write)
    return bigjson.load_corpus(spark, path, bigjson.range_bytes_for(path, RANGE))


def json_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile of every customer, from one JSON object; some leave fields out."""

    def write(path: str) -> None:
        n = F.col("c_custkey")
        none = F.lit(None)
        profile = F.struct(
            F.slice(F.array(*map(F.lit, tables.DOMAINS.projects)), (n % 5 + 1).cast("int"), (n % 2 + 1).cast("int")).alias("projects"),
            F.when(n % 3 == 0, True).when(n % 3 == 1, False).otherwise(none).alias("can_view_all_issues"),
            F.when(n % 3 != 0, F.array(F.concat(F.lit("Brand#1"), (n % 5 + 1).cast("string")))).alias("viewable_components"),
            F.when(n % 4 == 0, False).otherwise(none).alias("can_view_comments"),
            F.when(n % 7 == 0, F.array(F.lit("*"))).when(n % 7 == 1, F.array(F.lit("promo"))).alias("restricted_labels"),
        )
        rows = tables.read(spark, d, "customer").select(n.alias("ord"), F.col("c_name").alias("member"), F.to_json(profile).alias("element"))
        bigjson.write_object(path, {"permissions": rows})

    path = _object(spark, d, "profiles", write)
    return bigjson.load_profiles(spark, path, bigjson.range_bytes_for(path, RANGE))


def src_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every ticket of the object with its position."""
    i = json_corpus(spark, d).issues
    return i.select("ord", "key", "summary", "description", "status", "assignee.displayName", "created", "resolution", F.array_join("labels", ",").alias("labels"), F.size("comments").cast("long").alias("n_comments"))


def src_filter(spark: SparkSession, d: str) -> DataFrame:
    """A filter over the object."""
    return filterlang.apply(json_corpus(spark, d).issues, "status = Done AND labels = 'promo' AND resolution != Fixed", ordered=False).select("ord", "key")


def src_text(spark: SparkSession, d: str) -> DataFrame:
    """The object's searchable texts: their length."""
    return textindex.document_text(json_corpus(spark, d).issues).select("key", F.length("text").cast("long").alias("chars"))


def src_domains(spark: SparkSession, d: str) -> DataFrame:
    """How many tickets have each declared status, in the order of the declaration."""
    c = json_corpus(spark, d)
    declared = spark.createDataFrame(list(enumerate(c.domains.statuses)), "place long, status string")
    return declared.join(c.issues.groupBy("status").count(), "status", "left").select("place", "status", F.coalesce("count", F.lit(0)).alias("n"))


def src_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = json_profiles(spark, d)
    return p.select("user_id", F.array_join("projects", ",").alias("projects"), "can_view_all_issues", F.array_join("viewable_components", ",").alias("components"), "can_view_comments", F.array_join("restricted_labels", ",").alias("restricted"))


def src_access(spark: SparkSession, d: str) -> DataFrame:
    """Both objects together: what every customer's profile leaves of the tickets."""
    profiles = json_profiles(spark, d)
    return access.classify(json_corpus(spark, d).issues, profiles, profiles).summary()


_PROJECTS = "[" + ", ".join(f"'{p}'" for p in tables.DOMAINS.projects) + "]"
_PROF = f"""prof AS (
  SELECT c_name AS user_id, list_slice({_PROJECTS}, c_custkey % 5 + 1, c_custkey % 5 + 1 + c_custkey % 2) AS projects, c_custkey % 3 = 0 AS view_all,
    CASE WHEN c_custkey % 3 <> 0 THEN ['Brand#1' || (c_custkey % 5 + 1)] ELSE CAST([] AS VARCHAR[]) END AS comps, c_custkey % 4 <> 0 AS view_comments,
    CASE c_custkey % 7 WHEN 0 THEN ['*'] WHEN 1 THEN ['promo'] ELSE CAST([] AS VARCHAR[]) END AS restricted
  FROM customer)"""
_ISS = f"WITH {tables.ISSUES_SQL},\npos AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS place FROM iss)"

QUERIES: dict[str, Query] = {f.__name__: f for f in (src_issues, src_filter, src_text, src_domains, src_profiles, src_access)}
SQL: dict[str, str] = {
    "src_issues": f"{_ISS}\nSELECT place AS ord, key, summary, description, status, assignee AS displayName, created, resolution, array_to_string(labels, ',') AS labels, CAST(1 AS BIGINT) AS n_comments FROM pos",
    "src_filter": f"{_ISS}\nSELECT place AS ord, key FROM pos WHERE status = 'Done' AND list_contains(labels, 'promo') AND (resolution IS NULL OR resolution <> 'Fixed')",
    "src_text": f"""{_ISS}
SELECT key, length(concat_ws(' ', key, summary, coalesce(description, ''), status, priority, type, array_to_string(labels, ' '), array_to_string(components, ' '), assignee, 'Please hurry')) AS chars FROM pos""",
    "src_domains": f"{_ISS}\nSELECT i - 1 AS place, s[i] AS status, (SELECT count(*) FROM pos WHERE status = s[i]) AS n FROM (SELECT {list(tables.DOMAINS.statuses)} AS s, unnest(range(1, {len(tables.DOMAINS.statuses) + 1})) AS i)",
    "src_profiles": f"WITH {_PROF}\nSELECT user_id, array_to_string(projects, ',') AS projects, view_all AS can_view_all_issues, array_to_string(comps, ',') AS components, view_comments AS can_view_comments, array_to_string(restricted, ',') AS restricted FROM prof",
    "src_access": f"""{_ISS},
{_PROF},
cls AS (SELECT split_part(key, '-', 1) AS project, components, len(labels) > 0 AS labelled, list_contains(labels, 'promo') AS promo, count(*) AS n FROM iss GROUP BY ALL),
kind AS (SELECT projects, view_all, comps, restricted, list(user_id) AS users FROM prof GROUP BY ALL),
ok AS (
  SELECT kind.users, sum(n) AS total, coalesce(sum(n) FILTER (list_contains(projects, project) AND (view_all OR list_has_any(components, comps)) AND NOT (restricted = ['*'] AND labelled) AND NOT (promo AND list_contains(restricted, 'promo'))), 0) AS allowed
  FROM cls CROSS JOIN kind GROUP BY kind.users)
SELECT unnest(users) AS user_id, CAST(total AS BIGINT) AS total_before_filter, CAST(allowed AS BIGINT) AS allowed, CAST(total - allowed AS BIGINT) AS filtered_count FROM ok""",
}
