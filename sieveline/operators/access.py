"""Row-level access: one nullable deny reason a row and user, first failing check first, and comment redaction.

Decisions for many users are made for classes. Tickets of one class have the same project and the same of those labels and components that any
profile names; users of one class have the same rights. `classify` deals both to classes by a digest of these values, meets the classes by
project, and decides each pair once; counts come from the classes alone, rows from the membership of tickets and users. No row meets a user
before it is decided.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.columns import chain, project_of


def deny_reason(user_known: Column, project: Column) -> Column:
    """Null if the row is allowed. Needs the issue's labels, components and the profile's columns in one row."""
    hidden = F.array_intersect("labels", "restricted_labels")
    return chain(
        [
            (~user_known, F.lit("unknown_user")),
            (~F.array_contains("projects", project), F.concat(F.lit("no_project_access:"), project)),
            (~F.col("can_view_all_issues") & ~F.arrays_overlap("components", "viewable_components"), F.lit("no_component_access")),
            ((F.array_distinct("restricted_labels") == F.array(F.lit("*"))) & (F.size("labels") > 0), F.lit("all_labels_restricted")),
            ((F.array_distinct("restricted_labels") != F.array(F.lit("*"))) & (F.size(hidden) > 0), F.concat(F.lit("restricted_labels:"), F.array_join(F.array_sort(hidden), ","))),
        ],
        F.lit(None).cast("string"),
    )


#: Labels and components that profiles name, up to this number each, are written into the plan and all others left out of the classes; beyond it
#: classes are by all labels and components, which gives the same decisions.
NAMED = 10_000
_RIGHTS = ["projects", "can_view_all_issues", "viewable_components", "can_view_comments", "restricted_labels"]


@dataclass
class Classes:
    tickets: DataFrame  # the issues and their ticket_class
    decisions: DataFrame  # ticket_class, n (tickets), profile_class, deny_reason, can_view_comments
    members: DataFrame  # user_id, profile_class

    def decided(self, *columns: str) -> DataFrame:
        """tickets x users with user_id, deny_reason and can_view_comments: a row for each pair, as asked for. columns: of the tickets, else all."""
        rows = self.tickets.select(*columns, "ticket_class") if columns else self.tickets
        return rows.join(self.decisions.drop("n"), "ticket_class").join(self.members, "profile_class").drop("ticket_class", "profile_class")

    def reasons(self) -> DataFrame:
        """(user_id, deny_reason, n)."""
        per = self.decisions.filter("deny_reason is not null").groupBy("profile_class", "deny_reason").agg(F.sum("n").alias("n"))
        return per.join(self.members, "profile_class").select("user_id", "deny_reason", "n")

    def summary(self) -> DataFrame:
        """Per user: rows before, allowed, filtered."""
        denied = F.when(F.col("deny_reason").isNotNull(), F.col("n")).otherwise(0)
        per = self.decisions.groupBy("profile_class").agg(F.sum("n").alias("total_before_filter"), F.sum(denied).alias("filtered_count"))
        return per.join(self.members, "profile_class").select("user_id", "total_before_filter", (F.col("total_before_filter") - F.col("filtered_count")).alias("allowed"), "filtered_count")


def _digest(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _sorted(c: str) -> Column:
    return F.array_sort(F.array_distinct(c)).alias(c)


def _named(column: str, profiles: DataFrame, by: str, most: int) -> Column:
    """The values of an issue's array that profiles name, in order, each once."""
    some = [r["v"] for r in profiles.select(F.explode(by).alias("v")).distinct().limit(most + 1).collect()]
    kept = F.col(column) if len(some) > most else F.filter(column, lambda x: x.isin(some) if some else F.lit(False))
    return F.array_sort(F.array_distinct(kept)).alias(column)


def classify(issues: DataFrame, users: DataFrame, profiles: DataFrame, named: int = NAMED) -> Classes:
    """issues: key, labels, components, and more. users: user_id; who has no profile is in the class of the unknown."""
    parts = [
        project_of(F.col("key")).alias("project"),
        (F.size("labels") > 0).alias("labelled"),
        _named("labels", profiles, "restricted_labels", named),
        _named("components", profiles, "viewable_components", named),
    ]
    tickets = issues.withColumn("ticket_class", _digest(*parts))
    classes = issues.select(*parts).groupBy("project", "labelled", "labels", "components").agg(F.count("*").alias("n"))
    classes = classes.withColumn("ticket_class", _digest(*map(F.col, ("project", "labelled", "labels", "components"))))
    # a class without named labels may have labels all the same, which `*` hides
    classes = classes.withColumn("labels", F.when(F.col("labelled") & (F.size("labels") == 0), F.array(F.lit(None).cast("string"))).otherwise(F.col("labels")))
    rights = profiles.select("user_id", *map(_sorted, ("projects", "viewable_components", "restricted_labels")), "can_view_all_issues", "can_view_comments")
    rights = rights.withColumn("profile_class", _digest(*map(F.col, _RIGHTS)))
    asked = users.select("user_id").distinct().join(rights, "user_id", "left").withColumn("profile_class", F.coalesce("profile_class", F.lit("unknown")))
    kinds = asked.select("profile_class", *_RIGHTS).distinct()
    meet = classes.select("project").distinct().crossJoin(kinds)  # projects x kinds of rights, neither of which grows with rows or users as such
    pairs = classes.join(meet, classes["project"].eqNullSafe(meet["project"])).drop(meet["project"])
    reason = deny_reason(F.col("profile_class") != "unknown", F.col("project"))
    return Classes(tickets, pairs.select("ticket_class", "n", "profile_class", reason.alias("deny_reason"), "can_view_comments"), asked.select("user_id", "profile_class"))


def decide(issues: DataFrame, users: DataFrame, profiles: DataFrame) -> DataFrame:
    """issues x users with user_id, deny_reason and can_view_comments: by definition a row for each pair."""
    return classify(issues, users, profiles).decided()


def for_user(issues: DataFrame, user_id: str, profiles: DataFrame) -> DataFrame:
    """`decide` for one user, whose profile is one row beside each issue."""
    spark = issues.sparkSession
    own = spark.createDataFrame([(user_id,)], "user_id string").join(profiles.filter(F.col("user_id") == user_id).withColumn("known", F.lit(True)).limit(1), "user_id", "left")
    both = issues.crossJoin(F.broadcast(own))
    return both.withColumn("deny_reason", deny_reason(F.coalesce("known", F.lit(False)), project_of(F.col("key")))).drop("known", *(c for c in _RIGHTS if c != "can_view_comments"))


def redacted(decided: DataFrame) -> DataFrame:
    """Allowed rows; comments emptied and marked where the user may not read them."""
    hide = ~F.col("can_view_comments")
    allowed = decided.filter("deny_reason is null")
    return allowed.withColumn("_comments_redacted", hide).withColumn("comments", F.when(hide, F.slice("comments", 1, 0)).otherwise(F.col("comments"))).drop("deny_reason", "can_view_comments")


def check_access(issue: DataFrame, user_id: str, profiles: DataFrame) -> tuple[bool, str | None]:
    r = for_user(issue, user_id, profiles).select("deny_reason").first()
    return (r is not None and r[0] is None), (r[0] if r else None)


def user_permissions(profiles: DataFrame, user_id: str) -> dict:
    r = profiles.filter(F.col("user_id") == user_id).first()
    if r is None:
        return {"exists": False, "user_id": user_id, "access_level": "none"}
    return {"exists": True, "user_id": user_id, "projects": r["projects"], "can_view_all": r["can_view_all_issues"], "can_view_comments": r["can_view_comments"]}
