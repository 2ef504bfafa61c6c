"""Checks answers against the rows they were made from, for many answers in one plan, and builds answers that hold by construction.

Tables: answers (answer_id, text); retrieved (answer_id, pos, key, summary, status, priority, assignee, labels): the rows behind each
answer; corpus (key). Every check gives rows (answer_id, kind, key, claimed, actual, message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.columns import chain, joined_in_order, stripped

#: How keys and counts are recognised.
KEY = r"\b([A-Z]{2,10}-\d{1,6})\b"
COUNT_CLAIMS = (r"(\d+)\s+issues?\b", r"(\d+)\s+tickets?\b", r"there\s+are\s+(\d+)", r"found\s+(\d+)", r"total\s+of\s+(\d+)")
ASSIGNED = r"assigned\s+to\s+([A-Za-z\s]+?)(?:\.|,|$)"

def mentions(answers: DataFrame) -> DataFrame:
    """(answer_id, key, text): each key once an answer."""
    keys = F.array_distinct(F.regexp_extract_all("text", F.lit("(?U)" + KEY), F.lit(1)))
    return answers.select("answer_id", "text", F.explode(keys).alias("key"))


def _error(kind: str, key: Column, claimed: Column, actual: Column, message: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.struct(F.lit(kind).alias("kind"), s(key).alias("key"), s(claimed).alias("claimed"), s(actual).alias("actual"), message.alias("message"))


def _rows(rows: DataFrame, *errors: Column) -> DataFrame:
    """answer_id and the errors of each row. errors: arrays, null elements are none."""
    return rows.select("answer_id", F.inline(F.filter(F.concat(*errors), lambda e: e.isNotNull())))


def _unknown() -> Column:
    return _error("key", F.col("key"), F.col("key"), F.lit(None), F.format_string("Hallucinated issue key: %s does not exist", "key"))


def _unretrieved() -> Column:
    return _error("unretrieved", F.col("key"), F.col("key"), F.lit(None), F.format_string("Issue %s mentioned but not in retrieved results", "key"))


def unknown_keys(answers: DataFrame, corpus: DataFrame) -> DataFrame:
    return _rows(mentions(answers).join(corpus.select("key"), "key", "left_anti"), F.array(_unknown()))


def unretrieved_keys(answers: DataFrame, corpus: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Warnings, or errors for a strict caller: keys that exist but are not among the answer's rows."""
    found = mentions(answers).join(corpus.select("key"), "key", "left_semi").join(retrieved.select("answer_id", "key"), ["answer_id", "key"], "left_anti")
    return _rows(found, F.array(_unretrieved()))


def wrong_counts(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row for each pattern's hit whose number differs from the rows retrieved; a claim can hit twice."""
    low = F.lower("text")
    hits = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(1)) for p in COUNT_CLAIMS]))
    claims = F.transform(hits, lambda n: F.regexp_replace(n, "^0+(?=.)", ""))
    actual = retrieved.groupBy("answer_id").agg(F.count("*").alias("actual"))
    # texts meet the counts: a task takes a given size of exchanged rows, and of the claims alone, which are short, that would be millions of answers
    both = answers.select("answer_id", "text").join(actual, "answer_id", "left").select("answer_id", claims.alias("claims"), F.coalesce("actual", F.lit(0)).alias("actual"))
    message = lambda n: F.format_string("Count mismatch: response claims %s but retrieved %d", n, "actual")
    wrong = F.filter("claims", lambda n: n != F.col("actual").cast("string"))
    return _rows(both, F.transform(wrong, lambda n: _error("count", F.lit(None), n, F.col("actual"), message(n))))


def _tails() -> Column:
    """What follows the occurrences of a row's key in its text, from the key's last character on, up to the line's end for claims on one line.

    The key is sought ignoring case and as a plain part, as in `AB-1` within `AB-12`.
    """
    at = lambda line: F.instr(F.lower(line), F.lower("key"))
    tail = lambda line: F.substring(line, at(line) + F.length("key") - 1, F.length(line))
    return F.transform(F.filter(F.split("text", "\n"), lambda x: at(x) > 0), tail)


def _wrong_values(column: str, values: tuple[str, ...]) -> Column:
    # from the key's last character on, so that a word right behind the key is no word of its own
    says = lambda v: F.exists("tails", lambda t: t.rlike(rf"(?iU)^.[^\n]*?\b\Q{v}\E\b"))
    message = lambda v: F.format_string(column.capitalize() + " mismatch for %s: claimed '%s' but actual is '%s'", "key", F.lit(v), column)
    wrong = lambda v: F.when((F.lower(F.lit(v)) != F.lower(F.col(column))) & says(v), _error(column, F.col("key"), F.lit(v), F.col(column), message(v)))
    return F.array(*map(wrong, values))


def _assigned() -> Column:
    """What the text says behind the row's key of who has it: empty if nothing; the name may run over lines."""
    pattern = F.concat(F.lit(r"(?iUd)\Q"), F.col("key"), F.lit(r"\E.*?" + ASSIGNED))
    return F.when(F.col("text").rlike(r"(?iU)assigned\s+to\s"), F.call_function("regexp_extract", F.col("text"), pattern, F.lit(1))).otherwise("")


def _wrong_assignee() -> Column:
    """The first `assigned to NAME` behind the key must be part of the actual name. Needs `assigned`."""
    claimed, actual = stripped(F.col("assigned")), F.col("assignee")
    message = F.when(actual.isNull(), F.format_string("Assignee mismatch for %s: claimed '%s' but issue is unassigned", "key", claimed)).otherwise(
        F.format_string("Assignee mismatch for %s: claimed '%s' but actual is '%s'", "key", claimed, "assignee")
    )
    wrong = (F.col("assigned") != "") & (actual.isNull() | ~F.contains(F.lower(actual), F.lower(claimed)))
    return F.when(wrong, _error("assignee", F.col("key"), claimed, F.coalesce(actual, F.lit("Unassigned")), message))


def _claims(answers: DataFrame, retrieved: DataFrame, *columns: str) -> DataFrame:
    return mentions(answers).join(retrieved.select("answer_id", "key", *columns), ["answer_id", "key"])


def wrong_statuses(answers: DataFrame, retrieved: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    return _rows(_claims(answers, retrieved, "status").withColumn("tails", _tails()), _wrong_values("status", statuses))


def wrong_priorities(answers: DataFrame, retrieved: DataFrame, priorities: tuple[str, ...]) -> DataFrame:
    return _rows(_claims(answers, retrieved, "priority").withColumn("tails", _tails()), _wrong_values("priority", priorities))


def wrong_assignees(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    return _rows(_claims(answers, retrieved, "assignee").withColumn("assigned", _assigned()), F.array(_wrong_assignee()))


def errors(answers: DataFrame, retrieved: DataFrame, corpus: DataFrame, statuses: tuple[str, ...], priorities: tuple[str, ...], strict: bool = False) -> DataFrame:
    """All checks: each mention meets the corpus and its answer's rows once, and its errors are one array. Rows of retrieved are unique by answer and key."""
    here = F.lit(True)
    known = corpus.select("key", here.alias("known")).distinct()
    rows = mentions(answers).join(known, "key", "left").join(retrieved.select("answer_id", "key", "status", "priority", "assignee", here.alias("given")), ["answer_id", "key"], "left")
    known, given = F.col("known").isNotNull(), F.col("given").isNotNull()
    rows = rows.withColumns({"tails": F.when(given, _tails()), "assigned": F.when(given, _assigned()).otherwise("")})
    per_key = [F.when(~known, _unknown()), _wrong_assignee()]
    if strict:
        per_key.append(F.when(known & ~given, _unretrieved()))
    return _rows(rows, F.array(*per_key), _wrong_values("status", statuses), _wrong_values("priority", priorities)).union(wrong_counts(answers, retrieved))


def verdicts(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(answer_id, valid, n_errors, validated_text, messages, hallucinated_keys): one row an answer. found: rows of `errors`."""
    per = found.groupBy("answer_id").agg(
        F.count("*").alias("n_errors"), F.array_sort(F.collect_list("message")).alias("messages"), F.array_sort(F.collect_set(F.when(F.col("kind") == "key", F.col("key")))).alias("hallucinated_keys")
    )
    empty = F.array().cast("array<string>")
    rows = answers.join(per, "answer_id", "left").withColumns({"n_errors": F.coalesce("n_errors", F.lit(0)), "messages": F.coalesce("messages", empty), "hallucinated_keys": F.coalesce("hallucinated_keys", empty)})
    valid = F.col("n_errors") == 0
    return rows.select("answer_id", valid.alias("valid"), "n_errors", F.when(valid, F.col("text")).alias("validated_text"), "messages", "hallucinated_keys")


# ---- grounded texts

#: Texts of empty answers.
EMPTY_TEXT = "No issues found matching your query."
NO_RESULT_TEXT = (
    "No issues found matching your query. This could mean:\n• No issues match your criteria\n• You may not have permission to view matching issues\n• Try broadening your search terms"
)


def _name(c: str = "assignee") -> Column:
    return F.coalesce(F.col(c), F.lit("Unassigned"))


def grounded(rows: DataFrame, kind: str, group: str = "answer_id", include_details: bool = True) -> DataFrame:
    """(group, text, citations): a text of the rows of each group, in order of pos. kind: count, list, detail, or anything else for keys alone."""
    n = F.count("*").cast("string")
    pos = F.col("pos")
    if kind == "count":
        text = F.concat(F.lit("Found "), n, F.lit(" issue(s) matching your query."))
    elif kind == "list":
        line = F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.col("summary"), F.lit(" ["), F.col("status"), F.lit("]"))
        text = F.concat(F.lit("Found "), n, F.lit(" issue(s):\n"), joined_in_order(pos, line, "\n"))
    elif kind == "detail" and include_details:
        labels = F.when(F.size("labels") > 0, F.concat(F.lit("  Labels: "), F.array_join("labels", ", ")))
        block = F.concat_ws(
            "\n", F.concat(F.lit("**"), F.col("key"), F.lit("**: "), F.col("summary")), F.concat(F.lit("  Status: "), F.col("status"), F.lit(" | Priority: "), F.col("priority")),
            F.concat(F.lit("  Assignee: "), _name()), labels, F.lit(""),
        )
        text = joined_in_order(pos, block, "\n")
    else:
        text = F.concat(F.lit("Issues: "), joined_in_order(pos, F.col("key"), ", "))
    return rows.groupBy(group).agg(text.alias("text"), joined_in_order(pos, F.col("key"), ",").alias("citations"))


def status_summary(rows: DataFrame, group: str = "answer_id") -> DataFrame:
    """(group, status_summary): counts by status in order of first appearance."""
    per = rows.groupBy(group, "status").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return per.groupBy(group).agg(joined_in_order(F.col("first"), F.concat_ws(" ", F.col("n").cast("string"), "status"), ", ").alias("status_summary"))


def answer(rows: DataFrame, counting: Column, group: str = "answer_id", first: int = 5) -> DataFrame:
    """(group, text): a count, up to `first` rows in full, or a summary by status with the first rows. rows: pos from 0; counting: a boolean over rows."""
    bullet = F.concat(F.lit("• **"), F.col("key"), F.lit("**: "), F.col("summary"), F.lit(" ["), F.col("status"), F.lit("]"))
    head = F.when(F.col("pos") < first, bullet)
    full = F.concat(bullet, F.lit(" - "), _name())
    agg = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.bool_or(counting).alias("counts"),
        F.array_sort(F.collect_list(F.when(F.col("pos") < first, F.struct(F.col("pos").alias("o"), head.alias("short"), full.alias("full"))))).alias("lines"),
    )
    both = agg.join(status_summary(rows, group), group)
    n = F.col("n").cast("string")
    short, long = F.array_join(F.transform("lines", lambda x: x["short"]), "\n"), F.array_join(F.transform("lines", lambda x: x["full"]), "\n")
    text = chain(
        [
            (F.col("counts"), F.concat(F.lit("There are "), n, F.lit(" issue(s) matching your query."))),
            (F.col("n") <= first, F.concat(F.lit("Found "), n, F.lit(" issue(s):\n"), long)),
        ],
        F.concat(F.lit("Found "), n, F.lit(" issue(s) ("), F.col("status_summary"), F.lit("):\n"), short, F.lit("\n... and "), (F.col("n") - first).cast("string"), F.lit(" more")),
    )
    return both.select(group, text.alias("text"))
