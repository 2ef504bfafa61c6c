"""The ticket corpus: declared schema, JSON loaders, and one normalised view that every operator works on.

The normalised view has `ord` (input position, the tie-breaker of every order), clean arrays without nulls, and person structs
that may be null. It is what `load_corpus` returns and what the adapters of `tables` build from other data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERSON = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "displayName", "email")])
COMMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("author", "body", "created")])
ISSUE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("key", "summary", "description", "status", "priority", "type")]
    + [T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("components", T.ArrayType(T.StringType()))]
    + [T.StructField("assignee", PERSON), T.StructField("reporter", PERSON)]
    + [T.StructField(n, T.StringType()) for n in ("created", "updated", "resolution", "project", "sprint")]
    + [T.StructField("storyPoints", T.IntegerType()), T.StructField("comments", T.ArrayType(COMMENT))]
)
_NAMED = lambda *names: T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
CORPUS = T.StructType(
    [
        T.StructField("issues", T.ArrayType(ISSUE)),
        T.StructField("users", _NAMED("id", "displayName", "email", "team", "role")),
        T.StructField("projects", _NAMED("key", "name", "lead")),
        T.StructField("statuses", T.ArrayType(T.StringType())),
        T.StructField("priorities", T.ArrayType(T.StringType())),
        T.StructField("issue_types", T.ArrayType(T.StringType())),
    ]
)
PROFILE = T.StructType(
    [
        T.StructField("projects", T.ArrayType(T.StringType())),
        T.StructField("can_view_all_issues", T.BooleanType()),
        T.StructField("viewable_components", T.ArrayType(T.StringType())),
        T.StructField("can_view_comments", T.BooleanType()),
        T.StructField("restricted_labels", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Domains:
    """Declared values, in declared order."""

    projects: tuple[str, ...]
    statuses: tuple[str, ...]
    priorities: tuple[str, ...]
    types: tuple[str, ...]


@dataclass(frozen=True)
class Corpus:
    issues: DataFrame
    domains: Domains


def normalise(df: DataFrame, *more: str) -> DataFrame:
    """Adds what is missing of the view's columns, empties null arrays and drops null elements; df needs ord and key. more: other columns that stay."""
    out = {}
    for f in ISSUE.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast(f.dataType))
        out[f.name] = c
    return df.select(F.col("ord").cast("long").alias("ord"), *[c.alias(n) for n, c in out.items()], *more)


def load_corpus(spark: SparkSession, path: str) -> Corpus:
    """One JSON object with arrays. Only the declared domains come to the driver."""
    raw = spark.read.option("multiLine", True).schema(CORPUS).json(path)
    issues = normalise(raw.select(F.posexplode("issues").alias("ord", "i")).select("ord", "i.*"))
    head = raw.select("statuses", "priorities", "issue_types", F.transform("projects", lambda p: p["key"]).alias("projects")).first()
    return Corpus(issues, Domains(tuple(head["projects"] or ()), tuple(head["statuses"] or ()), tuple(head["priorities"] or ()), tuple(head["issue_types"] or ())))


def assert_unique_keys(issues: DataFrame) -> None:
    again = issues.groupBy("key").count().filter("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"keys stand there twice: {[r['key'] for r in again]}")


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row a user: user_id and the profile's fields with their defaults."""
    schema = T.StructType([T.StructField("permissions", T.MapType(T.StringType(), PROFILE))])
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    return with_defaults(raw.select(F.explode("permissions").alias("user_id", "p")).select("user_id", "p.*"))


def with_defaults(profiles: DataFrame) -> DataFrame:
    arrays = {c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>")) for c in ("projects", "viewable_components", "restricted_labels")}
    return profiles.select(
        "user_id", *[v.alias(c) for c, v in arrays.items()],
        F.coalesce("can_view_all_issues", F.lit(False)).alias("can_view_all_issues"), F.coalesce("can_view_comments", F.lit(True)).alias("can_view_comments"),
    )
