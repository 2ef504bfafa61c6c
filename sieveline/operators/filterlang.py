"""The filter language: text to syntax tree on the driver, tree to one Column, so Catalyst sees a plain filter.

    query  := [any] [ORDER BY field [ASC|DESC]]
    any    := all (OR all)*          all := unit (AND unit)*          unit := ( any ) | clause
    clause := field [NOT] IN (v, ...) | field IS [NOT] NULL|EMPTY | field ~ v | field (= != > < >= <=) v

Keywords and field names ignore case. Values may be quoted, or run to the next connector. Whatever follows the one sort key is ignored,
as is text after NULL and EMPTY; an empty query keeps every row. Null tests differ from SQL: a missing scalar compares as the text
``None``, so negations keep it. Comparisons by size work on created and updated only and are true elsewhere, as are unknown fields.
Dates without a zone, and offsets like -7d, are read in UTC.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.columns import chain, project_of, strings
from sieveline.sources.issues import Domains


class FilterSyntaxError(ValueError):
    pass


# ---- the tree


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    field: str
    negated: bool = False


@dataclass(frozen=True)
class IsEmpty:
    field: str
    negated: bool = False


@dataclass(frozen=True)
class Contains:
    field: str
    value: str


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Query:
    where: object
    order_field: str | None = None
    descending: bool = False


# ---- parsing

_FLAGS = re.IGNORECASE
_ORDER = re.compile(r"\s+ORDER\s+BY\s+(\w+)(?:\s+(ASC|DESC)\b)?", _FLAGS)
_WORD = re.compile(r"\w+")
_CONNECTOR = re.compile(r"\s+(AND|OR)(?=\s|\()|\s*\)", _FLAGS)
_IN = re.compile(r"\s+(NOT\s+)?IN\s*\(", _FLAGS)
_IS = re.compile(r"\s+IS\s+(NOT\s+)?(NULL|EMPTY)", _FLAGS)
_OP = re.compile(r"\s*(!=|>=|<=|=|>|<|~)\s*")


def _outside_quotes(text: str, pattern: re.Pattern, at: int) -> re.Match | None:
    """The first match that does not begin inside a quoted part."""
    quote = None
    while at < len(text):
        if quote is None and (m := pattern.match(text, at)):
            return m
        c = text[at]
        if quote is None and c in "'\"" and (at == 0 or not text[at - 1].isalnum()):
            quote = c
        elif c == quote:
            quote = None
        at += 1
    return None


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def keyword(self, *words: str) -> bool:
        m = re.compile(r"\s*(?:" + "|".join(words) + r")(?=\s|\(|$)", _FLAGS).match(self.text, self.at)
        if m:
            self.at = m.end()
        return bool(m)

    def any(self):
        parts = [self.all()]
        while self.keyword("OR"):
            parts.append(self.all())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def all(self):
        parts = []
        while True:
            while self.keyword("AND"):  # blank clauses are skipped
                pass
            self.blank()
            if self.at >= len(self.text) or self.text[self.at] == ")":
                break
            parts.append(self.unit())
            if not self.keyword("AND"):
                break
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def unit(self):
        if self.text[self.at] != "(":
            return self.clause()
        self.at += 1
        inside = self.any()
        self.blank()
        if self.text[self.at : self.at + 1] != ")":
            raise FilterSyntaxError(f"Unable to parse JQL clause: {self.text.strip()}")
        self.at += 1
        return inside

    def rest(self) -> str:
        """The raw text up to the next connector or closing bracket."""
        m = _outside_quotes(self.text, _CONNECTOR, self.at)
        start, self.at = self.at, m.start() if m else len(self.text)
        return self.text[start : self.at]

    def clause(self):
        start = self.at
        word = _WORD.match(self.text, self.at)
        field = word[0].lower() if word else ""
        after = word.end() if word else self.at
        if word and (m := _IN.match(self.text, after)):
            close = _outside_quotes(self.text, re.compile(r"\)"), m.end())
            inside = self.text[m.end() : close.start()] if close else ""
            if inside:
                self.at = close.end()
                self.rest()
                return In(field, tuple(v.strip().strip("\"'") for v in inside.split(",")), bool(m[1]))
        elif word and (m := _IS.match(self.text, after)):
            self.at = m.end()
            self.rest()
            return (IsNull if m[2].upper() == "NULL" else IsEmpty)(field, bool(m[1]))
        elif word and (m := _OP.match(self.text, after)):
            self.at = m.end()
            raw = self.rest().lstrip()
            value = re.match(r"[\"']?([^\"']+)", raw)
            if value:
                return Contains(field, value[1].strip()) if m[1] == "~" else Compare(field, m[1], value[1].strip())
        self.at = start
        raise FilterSyntaxError(f"Unable to parse JQL clause: {self.rest().strip()}")


def parse(text: str) -> Query:
    order = _outside_quotes(text, _ORDER, 0)
    body = text[: order.start()] if order else text
    p = _Parser(body)
    where = p.any()
    p.blank()
    if p.at < len(body):
        raise FilterSyntaxError(f"Unable to parse JQL clause: {body[p.at :].strip()}")
    return Query(where, order[1].lower() if order else None, bool(order and (order[2] or "").upper() == "DESC"))


# ---- compiling

_SCALARS = {"status", "priority", "type", "summary", "description", "created", "updated", "resolution", "sprint", "key"}
_ARRAYS = {"labels", "components"}


def _known(field: str) -> bool:
    return field in _SCALARS or field in ("project", "issuetype", "assignee", "reporter")


def _scalar(field: str) -> Column | None:
    if field == "project":
        return project_of(F.col("key"))
    if field == "issuetype":
        return F.col("type")
    if field in ("assignee", "reporter"):
        return F.col(f"{field}.displayName")
    return F.col(field) if field in _SCALARS else None


def parse_date(value: str, now: datetime | None = None) -> datetime | None:
    """An instant in UTC; None if the value is no date."""
    value = value.strip()
    if m := re.match(r"-(\d+)([dwh])", value):
        unit = {"d": "days", "w": "weeks", "h": "hours"}[m[2]]
        return (now or datetime.now(UTC)) - timedelta(**{unit: int(m[1])})
    try:
        found = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        for form in ("%Y/%m/%d", "%d/%m/%Y"):
            try:
                found = datetime.strptime(value, form)
                break
            except ValueError:
                found = None
    return found if found is None or found.tzinfo else found.replace(tzinfo=UTC)


def _compare_dates(field: str, op: str, value: str, now: datetime | None) -> Column:
    when = parse_date(value, now) if field in ("created", "updated") else None
    if when is None:
        warnings.warn(f"{field} {op} {value}: not a date comparison, keeps every row", stacklevel=2)
        return F.lit(True)
    left, right = F.try_to_timestamp(F.col(field)), F.lit(when)
    return {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]


def compile_tree(node: object, now: datetime | None = None) -> Column:
    if isinstance(node, (And, Or)):
        parts = [compile_tree(p, now) for p in node.parts]
        return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), parts) if parts else F.lit(True)
    field = node.field
    if field in _ARRAYS:
        return _on_array(F.col(field), node)
    c = _scalar(field)
    if c is None:
        warnings.warn(f"unknown field {field}: keeps every row", stacklevel=2)
        return F.lit(True)
    text = F.coalesce(c, F.lit("None"))
    match node:
        case IsNull():
            return c.isNotNull() if node.negated else c.isNull()
        case IsEmpty():
            return (c.isNotNull() & (c != "")) if node.negated else (c.isNull() | (c == ""))
        case In():
            return ~text.isin(list(node.values)) if node.negated else text.isin(list(node.values))
        case Contains():
            return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(node.value.lower()))
        case Compare(op="="):
            return F.lower(text) == node.value.lower()
        case Compare(op="!="):
            return F.lower(text) != node.value.lower()
    return _compare_dates(field, node.op, node.value, now)


def _on_array(c: Column, node: object) -> Column:
    match node:
        case IsNull():
            return F.lit(node.negated)
        case IsEmpty():
            return F.size(c) > 0 if node.negated else F.size(c) == 0
        case In():
            met = F.arrays_overlap(c, strings(node.values))
            return ~met if node.negated else met
        case Contains():
            return F.exists(c, lambda x: F.contains(F.lower(x), F.lit(node.value.lower())))
        case Compare(op="="):
            return F.array_contains(c, node.value)
        case Compare(op="!="):
            return ~F.array_contains(c, node.value)
    return F.lit(True)


#: The order of priorities, and the rank of any other.
PRIORITY_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
OTHER_RANK = 99


def sort_keys(field: str | None, descending: bool = False) -> list[Column]:
    """Ties, and fields without an order of their own, keep the input order in both directions."""
    if field in ("created", "updated"):
        key = F.coalesce(F.col(field), F.lit(""))
    elif field == "priority":
        key = chain([(F.col("priority") == p, F.lit(r)) for p, r in PRIORITY_RANK.items()], F.lit(OTHER_RANK))
    elif field in ("key", "status"):
        key = F.col(field)
    else:
        return [F.col("ord").asc()]
    return [key.desc() if descending else key.asc(), F.col("ord").asc()]


def apply(issues: DataFrame, text: str, now: datetime | None = None, ordered: bool = True) -> DataFrame:
    """Rows that the query keeps, in its order. ordered=False leaves out the sort where the caller sorts anyway."""
    q = parse(text)
    kept = issues.filter(compile_tree(q.where, now))
    return kept.orderBy(*sort_keys(q.order_field, q.descending)) if ordered else kept


@dataclass
class FilterOutcome:
    """Lazy rows; counting runs the plan."""

    success: bool
    query: str
    issues: DataFrame | None = None
    error: str | None = None

    @property
    def total_count(self) -> int:
        return self.issues.count() if self.success else 0

    def to_dict(self) -> dict:
        rows = [r.asDict(recursive=True) for r in self.issues.collect()] if self.success else []
        return {"success": self.success, "issues": rows, "total_count": len(rows), "query": self.query, "error": self.error}


def execute(issues: DataFrame, text: str, now: datetime | None = None) -> FilterOutcome:
    """`apply` with errors as an outcome."""
    try:
        return FilterOutcome(True, text, apply(issues, text, now))
    except FilterSyntaxError as e:
        return FilterOutcome(False, text, error=str(e))
    except Exception as e:  # noqa: BLE001  an envelope, as callers expect
        return FilterOutcome(False, text, error=f"JQL execution error: {e}")


def valid_values(issues: DataFrame, domains: Domains, field: str) -> DataFrame:
    """(value): declared values, or those that occur, sorted; empty for other fields."""
    spark = issues.sparkSession
    declared = {"status": domains.statuses, "priority": domains.priorities, "type": domains.types, "project": domains.projects}
    if field in declared:
        return spark.createDataFrame([(v,) for v in declared[field]], "value string")
    if field == "assignee":
        return issues.select(F.col("assignee.displayName").alias("value")).filter("value is not null").distinct().orderBy("value")
    if field in _ARRAYS:
        return issues.select(F.explode(field).alias("value")).distinct().orderBy("value")
    return spark.createDataFrame([], "value string")
