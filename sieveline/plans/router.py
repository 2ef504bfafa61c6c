"""Routing of natural-language questions: to the filter language, to search, or to both.

`classify` works on one question on the driver; `route` does the same for a column of questions with built-in expressions.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.columns import chain, stripped
from sieveline.sources.issues import Domains


class Mode(StrEnum):
    JQL = "jql"
    SEMANTIC = "semantic"
    HYBRID = "hybrid"
    CLARIFY = "clarification_needed"
    ERROR = "error"


#: The domains assumed without others, and the cues.
DEFAULT_DOMAINS = Domains(
    projects=("FIN", "SEC"), statuses=("To Do", "In Progress", "In Review", "Done", "Blocked"), priorities=("Critical", "High", "Medium", "Low"), types=("Bug", "Story", "Task", "Spike", "Epic")
)
SEMANTIC_CUES = (
    r"\b(?:related to|about|regarding|concerning)\b",
    r"\b(?:similar to|like)\b",
    r"\b(?:issues? with|problems? with)\b",
    r"\b(?:what|which|find|show|get)\s+(?:are|issues?|tickets?)\b",
    r"\b(?:working on|dealing with)\b",
)
COUNT_CUES = (r"\bhow many\b", r"\bcount\b", r"\bnumber of\b", r"\btotal\b")
TYPE_WORDS = (("bug", "Bug"), ("bugs", "Bug"), ("story", "Story"), ("stories", "Story"), ("task", "Task"), ("tasks", "Task"), ("spike", "Spike"), ("spikes", "Spike"), ("epic", "Epic"), ("epics", "Epic"))
ASSIGNEE = r"assigned to\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
LABEL = r"label[s]?\s+(?:is|=|:)?\s*(\w+)"
PROJECT = r"\b([A-Z]{2,10})\b"
LEADING = r"^(?:what|which|show|find|get|list)\s+"
PHRASES = (r"assigned to\s+\w+(?:\s+\w+)?", r"in\s+(?:project\s+)?\w+", r"with\s+status\s+\w+")
CLARIFY_TEXT = "Could you provide more details about what you're looking for?"

FIELDS = ("project", "status", "priority", "type", "assignee", "assignee_null", "labels")


@dataclass(frozen=True)
class Route:
    mode: Mode
    confidence: float
    jql_query: str | None = None
    semantic_query: str | None = None
    reasoning: str = ""
    clarification_prompt: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)


def _fields(query: str, d: Domains) -> dict[str, str]:
    low = query.lower()
    first = lambda pairs: next((v for w, v in pairs if w in low), None)
    assignee = re.search(ASSIGNEE, query, re.IGNORECASE)
    label = re.search(LABEL, low)
    found = {
        "project": next((m for m in re.findall(PROJECT, query) if m in d.projects), None),
        "status": first((s.lower(), s) for s in d.statuses),
        "priority": first((p.lower(), p) for p in d.priorities),
        "type": first(TYPE_WORDS),
        "assignee": assignee and assignee[1],
        "assignee_null": "yes" if "unassigned" in low else None,
        "labels": label and label[1],
    }
    return {k: v for k, v in found.items() if v}


def _filter_text(f: dict[str, str]) -> str:
    forms = {"project": "project = {}", "status": "status = '{}'", "priority": "priority = {}", "type": "type = {}", "assignee": "assignee = '{}'", "assignee_null": "assignee IS NULL", "labels": "labels = '{}'"}
    return " AND ".join(forms[k].format(f[k]) for k in FIELDS if k in f)


def classify(query: str, domains: Domains = DEFAULT_DOMAINS) -> Route:
    low = query.lower().strip()
    if len(low) < 3:
        return Route(Mode.CLARIFY, 1.0, reasoning="Query too short", clarification_prompt=CLARIFY_TEXT)
    f = _fields(query, domains)
    cue = any(re.search(p, low) for p in SEMANTIC_CUES)
    counts = any(re.search(p, low) for p in COUNT_CUES)
    if f and counts:
        return Route(Mode.JQL, 0.95, _filter_text(f), reasoning="Count query with explicit filters")
    if f and not cue:
        return Route(Mode.JQL, 0.9, _filter_text(f), reasoning=f"Detected JQL fields: {list(f)}")
    if f:
        rest = query
        for k, v in f.items():
            if k != "assignee_null":
                rest = re.sub(re.escape(v), "", rest, flags=re.IGNORECASE)
        for p in PHRASES:
            rest = re.sub(p, "", rest, flags=re.IGNORECASE)
        return Route(Mode.HYBRID, 0.8, _filter_text(f), rest.strip(), "Both structured filters and conceptual elements detected")
    if cue:
        return Route(Mode.SEMANTIC, 0.85, None, re.sub(r"\?$", "", re.sub(LEADING, "", query, flags=re.IGNORECASE)).strip(), "Conceptual/fuzzy query detected")
    return Route(Mode.SEMANTIC, 0.6, None, query, "No clear structure detected, defaulting to semantic search")


# ---- the same for a column

_I, _U = "(?iu)", "(?U)"


def _absent_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _removed(text: Column, value: Column) -> Column:
    """text without any occurrence of a value that is one of few: done by one literal pattern each where values are declared."""
    return F.when(value.isNull(), text).otherwise(F.regexp_replace(text, F.concat(F.lit(_I + r"\Q"), value, F.lit(r"\E")), F.lit("")))


def route(questions: DataFrame, domains: Domains = DEFAULT_DOMAINS, query: str = "query") -> DataFrame:
    """Adds mode, confidence, jql_query, semantic_query and the found fields to each question."""
    q = F.col(query)
    low = F.lower(q)
    has = lambda pairs: chain([(F.contains(low, F.lit(w)), F.lit(v)) for w, v in pairs], F.lit(None).cast("string"))
    any_of = lambda cues: stripped(low).rlike(_U + "|".join(f"(?:{c})" for c in cues))
    df = questions.withColumns(
        {
            "f_project": F.get(F.filter(F.regexp_extract_all(q, F.lit(_U + PROJECT), F.lit(1)), lambda x: x.isin(list(domains.projects))), 0),
            "f_status": has((s.lower(), s) for s in domains.statuses),
            "f_priority": has((p.lower(), p) for p in domains.priorities),
            "f_type": has(TYPE_WORDS),
            "f_assignee": _absent_to_null(F.regexp_extract(q, _I + _U + ASSIGNEE, 1)),
            "f_assignee_null": F.when(F.contains(low, F.lit("unassigned")), F.lit("yes")),
            "f_labels": _absent_to_null(F.regexp_extract(low, _U + LABEL, 1)),
        }
    )
    quoted = lambda name, c: F.concat(F.lit(f"{name} = '"), c, F.lit("'"))
    plain = lambda name, c: F.concat(F.lit(f"{name} = "), c)
    built = F.concat_ws(
        " AND ", plain("project", F.col("f_project")), quoted("status", F.col("f_status")), plain("priority", F.col("f_priority")), plain("type", F.col("f_type")),
        quoted("assignee", F.col("f_assignee")), F.when(F.col("f_assignee_null").isNotNull(), F.lit("assignee IS NULL")), quoted("labels", F.col("f_labels")),
    )
    df = df.withColumns({"f_built": built, "f_cue": any_of(SEMANTIC_CUES), "f_counts": any_of(COUNT_CUES)})
    found = F.col("f_built") != ""
    rest = q
    for name in FIELDS:
        if name != "assignee_null":
            rest = _removed(rest, F.col(f"f_{name}"))
    for p in PHRASES:
        rest = F.regexp_replace(rest, _I + _U + p, "")
    mode = chain(
        [
            (F.length(stripped(low)) < 3, F.lit(Mode.CLARIFY.value)),
            (found & (F.col("f_counts") | ~F.col("f_cue")), F.lit(Mode.JQL.value)),
            (found, F.lit(Mode.HYBRID.value)),
        ],
        F.lit(Mode.SEMANTIC.value),
    )
    df = df.withColumn("mode", mode)
    is_ = lambda m: F.col("mode") == m.value
    cleaned = stripped(F.regexp_replace(F.regexp_replace(q, _I + LEADING, ""), r"\?$", ""))
    return df.withColumns(
        {
            "confidence": chain([(is_(Mode.CLARIFY), F.lit(1.0)), (is_(Mode.JQL) & F.col("f_counts"), F.lit(0.95)), (is_(Mode.JQL), F.lit(0.9)), (is_(Mode.HYBRID), F.lit(0.8)), (F.col("f_cue"), F.lit(0.85))], F.lit(0.6)),
            "jql_query": F.when(is_(Mode.JQL) | is_(Mode.HYBRID), F.col("f_built")),
            "semantic_query": chain([(is_(Mode.HYBRID), stripped(rest)), (is_(Mode.SEMANTIC) & F.col("f_cue"), cleaned), (is_(Mode.SEMANTIC), q)], F.lit(None).cast("string")),
        }
    ).drop("f_built", "f_cue", "f_counts", *[f"f_{n}" for n in FIELDS])


