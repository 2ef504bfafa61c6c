"""Tickets as Parquet that filters can skip in: typed instants and folded values beside the texts, rows clustered by month, project and time.

A filter of the filter language compares texts: dates are parsed and values folded for each row, which no scan can push down. The store keeps the
parsed and folded values as columns of their own. `restriction` derives from a filter what these columns must meet, as plain comparisons that reach
the Parquet reader, which leaves out row groups whose statistics rule them out. The filter itself is still evaluated on what is read, so results
are those of the filter alone.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import storage
from sieveline.functions.columns import project_of
from sieveline.operators import filterlang
from sieveline.operators.filterlang import And, Compare, In, IsNull, Or
from sieveline.sources.issues import normalise

#: Bytes of a row group, the least that a scan leaves out.
GROUP_BYTES = 16 << 20

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_TEXTS = ("project", "status", "priority", "type", "key", "assignee")
_DATES = ("created", "updated")


def _folded(field: str, fields: dict[str, Column]) -> Column:
    at = lambda f: fields.get(f, F.col(f))
    text = {"project": lambda: project_of(at("key")), "assignee": lambda: at("assignee").getField("displayName")}.get(field, lambda: at(field))()
    return F.lower(F.coalesce(text, F.lit("None")))


def _micros(field: str, fields: dict[str, Column]) -> Column:
    return F.unix_micros(F.try_to_timestamp(fields.get(field, F.col(field))))


def write(issues: DataFrame, path: str, files: int | None = None, group_bytes: int = GROUP_BYTES, fields: dict[str, Column] | None = None) -> DataFrame:
    """Writes the normalised view; rows of a month stand together, in it those of a project, by time. Rows without a readable date come first.

    files: how many; otherwise adaptive execution cuts them to its size. A month or project with a third of all rows is cut into many files by time and position.
    fields: what makes a ticket's fields of issues, if those are narrower rows. Rows are dealt out as they come, so all else that is stored is made behind that.
    """
    made = fields or {}
    created = _micros("created", made)
    keys = {"_month": F.date_trunc("month", F.timestamp_micros(created)), "_project": _folded("project", made), "_created": created}
    ord_ = made.get("ord", F.col("ord"))
    dealt = issues.repartitionByRange(*([files] if files else []), *keys.values(), ord_)
    rows = dealt.withColumns(keys).sortWithinPartitions(*keys, ord_)
    extra = {f"_{f}": F.col(f"_{f}") if f"_{f}" in keys else _folded(f, {}) for f in _TEXTS} | {f"_{f}": F.col(f"_{f}") if f"_{f}" in keys else _micros(f, {}) for f in _DATES}
    if fields:
        rows = normalise(rows.select(*[c.alias(n) for n, c in made.items()], *keys), "_project", "_created")
    return storage.written(rows.drop("_month").withColumns(extra), path, **{"parquet.block.size": str(group_bytes)})


def with_lists(stored: DataFrame, lists: DataFrame) -> DataFrame:
    """A store written without labels and components, with those of lists (ord, labels, components); a ticket without a row there has none."""
    names = ("labels", "components")
    both = stored.drop(*names).join(lists, "ord", "left")
    return both.select([F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in names else F.col(c) for c in stored.columns])


def restriction(node: object, now: datetime | None = None) -> Column | None:
    """What the store's columns meet in every row that the filter keeps; None if they say nothing of it. Each part is a comparison with a literal."""
    if isinstance(node, (And, Or)):
        parts = [restriction(p, now) for p in node.parts]
        said = [p for p in parts if p is not None]
        if isinstance(node, And):
            return reduce(lambda a, b: a & b, said) if said else None
        return reduce(lambda a, b: a | b, said) if said and len(said) == len(parts) else None
    field = {"issuetype": "type"}.get(node.field, node.field)
    if field in _TEXTS:
        c = F.col(f"_{field}")
        match node:
            case Compare(op="="):
                return c == node.value.lower()
            case In(negated=False) if all(v.isascii() for v in node.values):
                return c.isin([v.lower() for v in node.values])
            case IsNull(negated=False):
                return c == "none"
    if field in _DATES and isinstance(node, Compare) and node.op not in ("=", "!="):
        when = filterlang.parse_date(node.value, now)
        if when is not None:
            c, past = F.col(f"_{field}"), when - _EPOCH
            micros = F.lit((past.days * 86400 + past.seconds) * 1_000_000 + past.microseconds).cast("long")
            return {">": c > micros, "<": c < micros, ">=": c >= micros, "<=": c <= micros}[node.op]
    return None


def apply(stored: DataFrame, text: str, now: datetime | None = None, ordered: bool = True) -> DataFrame:
    """`filterlang.apply` on a store: the same rows with the view's columns."""
    held = restriction(filterlang.parse(text).where, now)
    kept = filterlang.apply(stored if held is None else stored.filter(held), text, now, ordered)
    return kept.drop(*(f"_{f}" for f in (*_TEXTS, *_DATES)))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
