"""One call for one result: functions over a corpus file, and envelopes that become plain dictionaries.

Paths default to the settings sieveline.corpus and sieveline.profiles of the session. For many calls keep an `Assistant` or a
`TextIndex` instead; these functions read and index anew.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import access, filterlang, grounding, textindex
from sieveline.plans.assistant import Answer, Assistant
from sieveline.plans.router import DEFAULT_DOMAINS, Route, classify
from sieveline.sources.issues import Corpus, Domains, load_corpus, load_profiles


def _path(spark: SparkSession, given: str | None, name: str) -> str:
    path = given or spark.conf.get(f"sieveline.{name}", None)
    if not path:
        raise ValueError(f"give a path, or set sieveline.{name}")
    return path


def corpus_of(spark: SparkSession, path: str | None = None) -> Corpus:
    return load_corpus(spark, _path(spark, path, "corpus"))


def profiles_of(spark: SparkSession, path: str | None = None) -> DataFrame:
    return load_profiles(spark, _path(spark, path, "profiles"))


def execute_jql(spark: SparkSession, text: str, corpus: str | None = None) -> filterlang.FilterOutcome:
    return filterlang.execute(corpus_of(spark, corpus).issues, text)


def semantic_search(spark: SparkSession, text: str, top_k: int = 5, min_score: float = 0.1, corpus: str | None = None) -> textindex.SearchOutcome:
    return textindex.run_search(textindex.build(textindex.document_text(corpus_of(spark, corpus).issues)), text, top_k, min_score)


def find_similar(spark: SparkSession, key: str, top_k: int = 3, corpus: str | None = None) -> textindex.SearchOutcome:
    return textindex.run_similar(textindex.build(textindex.document_text(corpus_of(spark, corpus).issues)), key, top_k)


def classify_query(query: str, domains: Domains = DEFAULT_DOMAINS) -> Route:
    return classify(query, domains)


@dataclass
class Validation:
    valid: bool
    original_response: str
    validated_response: str | None
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    hallucinated_keys: list[str] = field(default_factory=list)
    hallucinated_values: dict[str, list[dict]] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)


#: Names of the groups of wrong values, by kind of error.
GROUPS = {"count": "counts", "status": "statuses", "priority": "priorities", "assignee": "assignees"}


def _answer_rows(rows: DataFrame) -> DataFrame:
    """Tickets as the rows of answer 0, in input order."""
    return rows.select(F.lit(0).alias("answer_id"), F.col("ord").alias("pos"), "key", "summary", "status", "priority", F.col("assignee.displayName").alias("assignee"), "labels")


def validate_response(spark: SparkSession, response: str, retrieved: DataFrame, corpus: str | None = None, strict: bool = False) -> Validation:
    """Checks one answer against the tickets it was made from."""
    c = corpus_of(spark, corpus)
    answers, rows, keys = spark.createDataFrame([(0, response)], "answer_id int, text string"), _answer_rows(retrieved), c.issues.select("key")
    found = grounding.errors(answers, rows, keys, c.domains.statuses, c.domains.priorities, strict).collect()
    warned = [r["message"] for r in grounding.unretrieved_keys(answers, keys, rows).collect()]
    values: dict[str, list[dict]] = {}
    for r in found:
        if r["kind"] in GROUPS:
            values.setdefault(GROUPS[r["kind"]], []).append({k: r[k] for k in ("key", "claimed", "actual") if r[k] is not None})
    return Validation(not found, response, None if found else response, [r["message"] for r in found], [] if strict else warned, sorted({r["key"] for r in found if r["kind"] == "key"}), values)


@dataclass
class Grounded:
    text: str
    source_issues: list[str]
    citations: dict[str, object]
    confidence: float = 1.0


def create_grounded_response(issues: DataFrame, kind: str, include_details: bool = True) -> Grounded:
    r = grounding.grounded(_answer_rows(issues), kind, include_details=include_details).first()
    if r is None:
        return Grounded(grounding.EMPTY_TEXT, [], {})
    keys = r["citations"].split(",")
    return Grounded(r["text"], keys, {"count": keys} if kind == "count" else {k: k for k in keys})


@dataclass
class Access:
    """Lazy allowed rows; `to_dict` has the counts and the reason of each denied key."""

    user_id: str
    decided: DataFrame

    @property
    def allowed(self) -> DataFrame:
        return access.redacted(self.decided).drop("user_id")

    def to_dict(self) -> dict:
        rows = self.decided.select("key", "deny_reason").collect()
        reasons = {r["key"]: r["deny_reason"] for r in rows if r["deny_reason"] is not None}
        return {"user_id": self.user_id, "total_before_filter": len(rows), "filtered_count": len(reasons), "allowed_count": len(rows) - len(reasons), "filter_reasons": reasons}


def filter_for_user(spark: SparkSession, issues: DataFrame, user_id: str, profiles: str | None = None) -> Access:
    return Access(user_id, access.for_user(issues, user_id, profiles_of(spark, profiles)))


def process_query(spark: SparkSession, query: str, user_id: str, corpus: str | None = None, profiles: str | None = None, **options) -> Answer:
    return Assistant(corpus_of(spark, corpus), profiles_of(spark, profiles), **options).ask(query, user_id)
