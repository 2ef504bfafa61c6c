"""Many questions at once: routed, retrieved, filtered by access, answered and checked in one plan, without a round of the driver for each.

Questions are reduced to what their answers depend on. A plan is a mode with its filter and search text; a case is a plan, a class of rights
(`access.classify`) and whether a count is asked for. Filters of all plans are matched at once (`filtertable`), search texts are one batch, rows are
decided by classes, and answers are made and checked once a case; questions look theirs up. Which rows come first in an answer is found in
`SALTS` parts of a case and then among the best of each, so no case is sorted in one task, but for the ranks of a hybrid's hits, which are
positions among all hits of its text. The result is a join of the questions with the cases' texts, made when it is read. A list for an answer that fails its check holds all its rows, as it is defined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.storage import delete, expect_long_values, shared_path, written
from sieveline.operators import access, filtertable, grounding, textindex
from sieveline.plans.assistant import COUNT_WORDS, SEMANTIC_TOP_K
from sieveline.plans.router import CLARIFY_TEXT, DEFAULT_DOMAINS, Mode, route
from sieveline.sources.issues import Corpus, Domains

SALTS = 64
COPIES = 8
FIRST = 5
#: Hits come before all other rows of a hybrid.
_AHEAD = -(1 << 62)

ROW = ["key", "summary", "status", "priority", "assignee", "labels"]


def _digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _ranked_hits(index: textindex.TextIndex, texts: DataFrame, least: float = 0.1) -> DataFrame:
    """(semantic_query, key, hit): all documents of at least that score by their place."""
    asked = texts.select(F.col("semantic_query").alias("query_id"), F.col("semantic_query").alias("text"))
    scored = textindex.similarities(index, textindex.query_terms(asked)).filter(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 4).desc(), "ord"))
    return scored.select(F.col("query_id").alias("semantic_query"), "key", place.cast("long").alias("hit"))


def retrieve(issues: DataFrame, index: textindex.TextIndex, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """plans: plan, mode, jql_query, semantic_query. (plan, key, o): the rows of each plan, before access, in the order of o; and the filters'
    errors (jql_query, error)."""
    of = lambda *modes: plans.filter(F.col("mode").isin([m.value for m in modes]))
    saved = of(Mode.JQL, Mode.HYBRID).select("jql_query").distinct()
    matched = filtertable.match(issues, saved.select(F.col("jql_query").alias("filter_id"), F.col("jql_query").alias("text")))
    kept = matched.rows().select(F.col("filter_id").alias("jql_query"), "key", "ord")
    by_filter = of(Mode.JQL).join(kept, "jql_query").select("plan", "key", F.col("ord").alias("o"))

    texts = of(Mode.SEMANTIC).select("semantic_query").distinct()
    asked = texts.select(F.col("semantic_query").alias("query_id"), F.col("semantic_query").alias("text"))
    best = textindex.search_batch(index, asked, SEMANTIC_TOP_K).select(F.col("query_id").alias("semantic_query"), "key", F.col("rank").cast("long").alias("o"))
    by_text = of(Mode.SEMANTIC).join(best, "semantic_query").select("plan", "key", "o")

    hybrid = of(Mode.HYBRID)
    hits = _ranked_hits(index, hybrid.select("semantic_query").distinct())
    sizes = matched.totals().select(F.col("filter_id").alias("jql_query"), F.col("n").alias("size"))
    rows = hybrid.join(sizes, "jql_query").join(kept, "jql_query").join(hits, ["semantic_query", "key"], "left")
    by_both = rows.select("plan", "key", F.when(F.col("hit") <= F.col("size"), F.col("hit") + _AHEAD).otherwise(F.col("ord")).alias("o"))
    return by_filter.union(by_text).union(by_both), matched.filters.filter("error is not null").select(F.col("text").alias("jql_query"), "error")


def _placed(rows: DataFrame) -> DataFrame:
    """rows: plan, profile_class, key, o, least_o. Adds pos: 0 to FIRST - 1 for the first rows, above for the others, in the order of o."""
    group = ["plan", "profile_class"]
    local = F.row_number().over(Window.partitionBy(*group, F.pmod(F.xxhash64("key"), F.lit(SALTS))).orderBy("o", "key"))
    near = rows.withColumn("_local", local)
    place = F.row_number().over(Window.partitionBy(*group).orderBy("o", "key"))
    firsts = near.filter(F.col("_local") <= FIRST).withColumn("_place", place).select(*group, F.col("key"), "_place").filter(F.col("_place") <= FIRST)
    both = rows.join(firsts, [*group, "key"], "left")
    return both.withColumn("pos", F.coalesce((F.col("_place") - 1).cast("long"), FIRST + F.col("o") - F.col("least_o"))).drop("_place", "o", "least_o")


@dataclass
class Said:
    questions: DataFrame  # question_id, answer_id: the case, fixed: an answer that no case has, and the result's other columns but those of texts
    texts: DataFrame  # answer_id, text, validation_errors

    def rows(self) -> DataFrame:
        """What `ask_all` returns. A text meets its questions here and stands nowhere once a question; those of one case are dealt to COPIES tasks. The number
        of partitions is held, as the size of what they read says nothing of the texts that they repeat, and a case's rows follow each other."""
        n = int(self.questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked = self.questions.withColumn("_copy", F.pmod(F.xxhash64("question_id"), F.lit(COPIES))).repartition(n, "answer_id", "_copy")
        every = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)).cast("array<bigint>")).alias("_copy")
        out = asked.join(self.texts.select("*", every).repartition(n, "answer_id", "_copy"), ["answer_id", "_copy"], "left")
        wrong = F.coalesce("validation_errors", F.array().cast("array<string>"))
        return out.select(
            "question_id", "success", "query_mode", "jql_used", "semantic_query", "total_count", F.coalesce("fixed", "text").alias("answer"),
            (F.size(wrong) == 0).alias("validation_passed"), wrong.alias("validation_errors"), "warnings", "errors",
        )


def ask_all(corpus: Corpus, index: textindex.TextIndex, profiles: DataFrame, questions: DataFrame, route_domains: Domains = DEFAULT_DOMAINS, strict: bool = False, tell_hidden: bool = True) -> DataFrame:
    """questions: question_id, query, user_id. One row each: question_id, success, query_mode, jql_used, semantic_query, total_count, answer,
    validation_passed, validation_errors, warnings, errors. A null query is an empty one."""
    return say_all(corpus, index, profiles, questions, route_domains, strict, tell_hidden).rows()


def say_all(corpus: Corpus, index: textindex.TextIndex, profiles: DataFrame, questions: DataFrame, route_domains: Domains = DEFAULT_DOMAINS, strict: bool = False, tell_hidden: bool = True) -> Said:
    """`ask_all` with questions and texts apart, so that a text that many questions have is kept once. Sets `expect_long_values` for the session, as a list of
    all rows of a case may be megabytes long and its askers follow each other."""
    spark, paths = questions.sparkSession, []

    def cut(df: DataFrame, label: str, read_by_result: bool = False) -> DataFrame:
        path = shared_path(spark, f"questions-{label}")
        if not read_by_result:
            paths.append(path)
        return written(df, path)

    expect_long_values(spark)
    issues = corpus.issues
    query = F.coalesce("query", F.lit(""))
    counting = F.lower("query").rlike("|".join(COUNT_WORDS))
    routed = route(questions.select("question_id", query.alias("query"), "user_id"), route_domains).withColumn("counting", counting)
    routed = routed.withColumn("plan", F.when(F.col("mode") != Mode.CLARIFY.value, _digest("mode", "jql_query", "semantic_query")))
    classes = access.classify(issues, routed.select("user_id"), profiles)
    members = classes.members.withColumnRenamed("user_id", "_user")
    asked = cut(routed.join(members, F.col("user_id").eqNullSafe(F.col("_user"))).drop("_user").withColumn("answer_id", F.when(F.col("plan").isNotNull(), _digest("plan", "profile_class", "counting"))), "asked", True)

    plans = asked.filter("plan is not null").select("plan", "mode", "jql_query", "semantic_query").distinct()
    found, broken = retrieve(issues, index, plans)
    seen_by = asked.filter("plan is not null").select("plan", "profile_class").distinct()
    tickets = classes.tickets.select("key", "summary", "status", "priority", F.col("assignee.displayName").alias("assignee"), "labels", "ticket_class")
    decided = found.join(tickets, "key").join(seen_by, "plan").join(classes.decisions.select("ticket_class", "profile_class", "deny_reason"), ["ticket_class", "profile_class"])
    decided = cut(decided.select("plan", "profile_class", *ROW, "o", "deny_reason"), "decided")
    allowed = F.col("deny_reason").isNull()
    counts = cut(decided.groupBy("plan", "profile_class").agg(F.count("*").alias("before"), F.count_if(allowed).alias("after"), F.min(F.when(allowed, F.col("o"))).alias("least_o")), "counts", True)

    cases = cut(asked.filter("plan is not null").select("answer_id", "plan", "profile_class", "counting").distinct(), "cases")
    shown = _placed(decided.filter(allowed).drop("deny_reason").join(counts.select("plan", "profile_class", "least_o"), ["plan", "profile_class"]))
    rows = cut(cases.join(shown, ["plan", "profile_class"]).select("answer_id", "counting", "pos", *ROW), "rows")
    texts = grounding.answer(rows, F.col("counting"), first=FIRST)
    answers = cut(cases.select("answer_id").join(texts, "answer_id", "left").select("answer_id", F.coalesce("text", F.lit(grounding.NO_RESULT_TEXT)).alias("text")), "answers")
    wrong = grounding.errors(answers, rows, issues.select("key"), corpus.domains.statuses, corpus.domains.priorities, strict)
    wrong = cut(wrong.groupBy("answer_id").agg(F.array_sort(F.collect_list("message")).alias("validation_errors")), "wrong")
    lists = grounding.grounded(rows.join(wrong.select("answer_id"), "answer_id", "left_semi"), "list").select("answer_id", F.col("text").alias("list"))
    checked = answers.join(wrong, "answer_id", "left").join(lists, "answer_id", "left")
    failed = F.col("validation_errors").isNotNull()
    checked = checked.select("answer_id", F.when(failed, F.coalesce("list", F.lit(grounding.EMPTY_TEXT))).otherwise(F.col("text")).alias("text"), F.coalesce("validation_errors", F.array().cast("array<string>")).alias("validation_errors"))
    # a row a case; a list may be long, so few of them share a file and a batch of its reader
    checked = cut(checked.repartition("answer_id"), "checked", True)

    out = asked.join(counts, ["plan", "profile_class"], "left").join(broken, "jql_query", "left")
    clarify, unread = F.col("plan").isNull(), F.col("error").isNotNull()
    hidden = F.coalesce(F.col("before") - F.col("after"), F.lit(0))
    none = F.array().cast("array<string>")
    problem = F.concat(F.lit("JQL execution failed: "), "error")
    result = out.select(
        "question_id",
        "answer_id",
        (~unread).alias("success"),
        F.when(clarify, "clarification").otherwise(F.col("mode")).alias("query_mode"),
        F.when(~unread, F.col("jql_query")).alias("jql_used"),
        F.when(~unread, F.col("semantic_query")).alias("semantic_query"),
        F.coalesce("after", F.lit(0)).alias("total_count"),
        F.when(clarify, CLARIFY_TEXT).when(unread, F.concat(F.lit("An error occurred while searching: "), problem)).alias("fixed"),
        F.when((hidden > 0) & F.lit(tell_hidden), F.array(F.format_string("%d issue(s) hidden due to permissions", hidden))).otherwise(none).alias("warnings"),
        F.when(unread, F.array(problem)).otherwise(none).alias("errors"),
    )
    for p in paths:
        delete(spark, p)
    return Said(result, checked)
