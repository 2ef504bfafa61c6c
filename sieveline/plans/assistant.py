"""From a question and a user to an answer: route, retrieve, filter by access, answer, check.

Retrieval and access are lazy plans; only the rows of one answer (all permitted rows for its count and summary are aggregated) come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.ranking import numbered
from sieveline.operators import access, filterlang, grounding, textindex
from sieveline.plans.router import DEFAULT_DOMAINS, Mode, classify
from sieveline.sources.issues import Corpus, Domains, load_corpus, load_profiles

SEMANTIC_TOP_K = 10
COUNT_WORDS = ("how many", "count", "number of", "total")


def hybrid(issues: DataFrame, index: textindex.TextIndex, filter_text: str, search_text: str, rank_scope: str = "all", min_score: float = 0.1) -> DataFrame:
    """Rows of the filter with `score` and `rank`: those among the best hits first, by score, then the others in the filter's order.

    rank_scope "all" takes as many best hits of the whole corpus as the filter has rows; "filtered" ranks the filter's rows only.
    """
    q = filterlang.parse(filter_text)
    kept = issues.filter(filterlang.compile_tree(q.where))
    scored = textindex.similarities_to(index, search_text)
    if rank_scope == "filtered":
        scored = scored.join(kept.select("key"), "key", "left_semi")
    best = scored.filter(F.col("score") >= min_score).select("key", "ord", F.round("score", 4).alias("score"))
    hits = numbered(best, [F.col("score").desc(), F.col("ord")], "hit").filter(F.col("hit") <= kept.count())
    order = [F.col("hit").asc_nulls_last(), *filterlang.sort_keys(q.order_field, q.descending)]
    return numbered(kept.join(hits.select("key", "score", "hit"), "key", "left"), order).drop("hit")


@dataclass
class Answer:
    success: bool
    answer: str
    issues: DataFrame | None
    total_count: int
    query_mode: str
    jql_used: str | None = None
    semantic_query: str | None = None
    validation_passed: bool = True
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    debug_info: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        rows = self.issues.select("key", "summary", "status").collect() if self.issues is not None else []
        return {
            "success": self.success, "answer": self.answer, "issues": [r.asDict() for r in rows], "total_count": self.total_count, "query_mode": self.query_mode, "jql_used": self.jql_used,
            "semantic_query": self.semantic_query, "validation_passed": self.validation_passed, "warnings": self.warnings, "errors": self.errors,
        }


class Assistant:
    """strict: keys of other rows in an answer are errors. fallback: a filter that can't be read becomes a search. tell_hidden: warn of hidden rows.
    access_first: filter before the best hits are cut off. index: one made before, such as a stored one, or a function that opens it when the first search
    asks for it; without it the corpus is indexed anew then."""

    def __init__(self, corpus: Corpus, profiles: DataFrame, route_domains: Domains = DEFAULT_DOMAINS, strict: bool = False, fallback: bool = False, tell_hidden: bool = True, rank_scope: str = "all", access_first: bool = False, index: textindex.TextIndex | Callable[[], textindex.TextIndex] | None = None):
        self.issues, self.domains, self.profiles = corpus.issues, corpus.domains, profiles
        self._index = index
        self.route_domains, self.strict, self.fallback, self.tell_hidden, self.rank_scope, self.access_first = route_domains, strict, fallback, tell_hidden, rank_scope, access_first

    @cached_property
    def index(self) -> textindex.TextIndex:
        """A question that only filters needs none."""
        if self._index is None:
            return textindex.persist(textindex.build(textindex.document_text(self.issues)))
        return self._index() if callable(self._index) else self._index

    @classmethod
    def from_files(cls, spark: SparkSession, corpus: str, profiles: str, **options) -> Assistant:
        return cls(load_corpus(spark, corpus), load_profiles(spark, profiles), **options)

    def retrieve(self, mode: Mode, filter_text: str | None, search_text: str | None, visible: DataFrame | None = None) -> DataFrame:
        """Rows with `rank`."""
        issues = self.issues if visible is None else visible
        if mode == Mode.HYBRID:
            return hybrid(issues, self.index, filter_text, search_text, self.rank_scope)
        if mode == Mode.JQL:
            q = filterlang.parse(filter_text)
            return numbered(issues.filter(filterlang.compile_tree(q.where)), filterlang.sort_keys(q.order_field, q.descending))
        index = self.index
        if visible is not None:
            index = replace(index, postings=index.postings.join(visible.select("key"), "key", "left_semi"))
        hits = textindex.search(index, search_text, SEMANTIC_TOP_K)
        return self.issues.join(F.broadcast(hits.select("key", "score", "rank")), "key")  # at most SEMANTIC_TOP_K rows

    def ask(self, query: str, user_id: str) -> Answer:
        r = classify(query, self.route_domains)
        debug: dict = {"classification": r.to_dict()}
        if r.mode == Mode.CLARIFY:
            return Answer(True, r.clarification_prompt, None, 0, "clarification", debug_info=debug)
        visible = None
        if self.access_first:
            visible = access.redacted(access.for_user(self.issues, user_id, self.profiles)).drop("user_id", "_comments_redacted")
        mode, search_text = r.mode, r.semantic_query
        try:
            found = self.retrieve(mode, r.jql_query, search_text, visible)
        except filterlang.FilterSyntaxError as e:
            if not self.fallback:
                return Answer(False, f"An error occurred while searching: JQL execution failed: {e}", None, 0, mode.value, errors=[f"JQL execution failed: {e}"], debug_info=debug)
            mode, search_text = Mode.SEMANTIC, query
            found = self.retrieve(mode, None, query, visible)
        decided = access.for_user(found, user_id, self.profiles).persist()
        try:
            return self._answer(query, mode, r.jql_query, search_text, decided, debug)
        finally:
            decided.unpersist()

    def _answer(self, query: str, mode: Mode, jql: str | None, search_text: str | None, decided: DataFrame, debug: dict) -> Answer:
        n = decided.agg(F.count("*").alias("before"), F.count_if(F.col("deny_reason").isNull()).alias("after")).first()
        debug["permission_filter"] = {"before": n["before"], "after": n["after"], "filtered": n["before"] - n["after"]}
        allowed = access.redacted(decided).orderBy("rank")
        spark = allowed.sparkSession
        shown = allowed.select(F.lit(0).alias("answer_id"), "rank", "key", "summary", "status", "priority", F.col("assignee.displayName").alias("assignee"), "labels")
        rows = numbered(shown, [F.col("rank")], "pos", 0)
        counting = any(w in query.lower() for w in COUNT_WORDS)
        text = grounding.answer(rows, F.lit(counting)).first()["text"] if n["after"] else grounding.NO_RESULT_TEXT
        answers = spark.createDataFrame([(0, text)], "answer_id int, text string")
        found = [e["message"] for e in grounding.errors(answers, rows, self.issues.select("key"), self.domains.statuses, self.domains.priorities, self.strict).collect()]
        debug["validation"] = {"passed": not found, "errors": found}
        if found:
            text = grounding.grounded(rows, "list").first()["text"] if n["after"] else grounding.EMPTY_TEXT
            debug["fallback_to_grounded"] = True
        hidden = n["before"] - n["after"]
        warnings = [f"{hidden} issue(s) hidden due to permissions"] if hidden and self.tell_hidden else []
        return Answer(True, text, allowed.drop("user_id"), n["after"], mode.value, jql, search_text, not found, warnings, debug_info=debug)
