"""Small Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that the search ignores.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between under again further then once "
    "and but or nor so yet both either neither not only own same than too very just also now here there when where why how "
    "all each every any this that these those it its"
).split()


def strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def project_of(key: Column) -> Column:
    return F.split_part(key, F.lit("-"), F.lit(1))


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, without stopwords and single characters; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS) & (F.length(t) > 1))


#: All white space, line breaks and tabs too.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def joined_in_order(order: Column, line: Column, separator: str) -> Column:
    """Aggregate: lines joined by their order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), separator)


def chain(rules: Iterable[tuple[Column, Column]], other: Column) -> Column:
    """The value of the first rule that holds."""
    out = other
    for test, value in reversed(list(rules)):
        out = F.when(test, value).otherwise(out)
    return out
