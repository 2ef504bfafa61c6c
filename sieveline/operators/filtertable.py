"""A table of saved filters against all tickets, in one plan whose size does not depend on how many filters there are.

1. Texts are made distinct and parsed in tasks. A filter becomes a Boolean form over atoms. Equality and IN, on fields and on arrays, become atoms
   that name a field and a value, so that a ticket finds its true ones by a join: it probes with the values it has. All other atoms
   (contains, null and empty tests, dates) are made distinct and evaluated once a ticket, `BLOCK` in a projection.
2. Tickets with the same true atoms are one class, and filters are tried on classes.
3. A form becomes clauses, one of which must hold; filters share clauses, and each clause is tried once. A clause names atoms that must be true; its
   rarest, by the tickets behind it, is its key, and only classes that have it are tried. Clauses that can hold with no atom true (negations,
   an empty query) are tried on every class: they are the ones that most tickets match. A form of more than `CLAUSES` clauses is one whole.
4. A text's clauses that other texts have too are its base. Classes are found once a base, however many texts stand on it, and a text keeps those
   alone that its own clauses add. Totals are sums of both; rows are made where they are asked for.

A text that can't be parsed gives an error instead of tickets, as it does alone. Order clauses are read and have no effect on what matches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.storage import shared_path, written
from sieveline.functions.workers import send_package
from sieveline.operators import filterlang as lang

#: Atoms that are evaluated in one projection.
BLOCK = 500

#: Tickets of a shared set that each of its filters has at a time.
PART = 256

#: Clauses that a form is taken apart into at most.
CLAUSES = 32

PARSED = "text string, error string, clauses array<struct<clause: string, atoms: array<string>, keys: array<array<string>>>>"
#: Kinds of atoms that a ticket finds by its values: equal ignoring case, equal, element of an array.
EQUAL, EXACT, ELEMENT = "=", "==", "in"
#: Between the parts of an atom's name, of which only the last may be any text.
SEP = "\x1f"


# ---- texts to forms


def _name(*parts: str) -> str:
    return SEP.join(parts)


def _any(names: list[str]) -> list:
    return [names[0]] if len(names) == 1 else ["or", *([n] for n in names)]


def form_of(node: object) -> list:
    """["and", ...], ["or", ...], ["not", form] or [atom]; no parts: always true."""
    if isinstance(node, (lang.And, lang.Or)):
        parts = [form_of(p) for p in node.parts]
        return parts[0] if len(parts) == 1 else ["and" if isinstance(node, lang.And) or not parts else "or", *parts]
    array, known = node.field in lang._ARRAYS, node.field in lang._ARRAYS or lang._known(node.field)
    match node:
        case lang.In() if known:
            some = _any([_name(ELEMENT if array else EXACT, node.field, v) for v in dict.fromkeys(node.values)])
            return ["not", some] if node.negated else some
        case lang.Compare(op="=" | "!=") if known:
            one = [_name(ELEMENT, node.field, node.value) if array else _name(EQUAL, node.field, node.value.lower())]
            return one if node.op == "=" else ["not", one]
        case lang.Contains():
            return [_name("~", node.field, node.value.lower())]
        case lang.IsNull() | lang.IsEmpty():
            one = [_name("null" if isinstance(node, lang.IsNull) else "empty", node.field)]
            return ["not", one] if node.negated and known else one
        case lang.In() | lang.Compare():
            return [_name("other", node.field, getattr(node, "op", "in"), getattr(node, "value", ""))]
    raise TypeError(node)


def atom_of(name: str) -> object:
    """The clause behind an atom that is evaluated."""
    kind, field, *rest = name.split(SEP, 3 if name.startswith("other") else 2)
    match kind:
        case "~":
            return lang.Contains(field, rest[0])
        case "null":
            return lang.IsNull(field)
        case "empty":
            return lang.IsEmpty(field)
    return lang.Compare(field, *rest) if rest[0] != "in" else lang.In(field, ())


def atoms_in(form: list) -> set[str]:
    head, *rest = form
    return set().union(*map(atoms_in, rest)) if head in ("and", "or", "not") else {head}


def keys_of(form: list) -> list[list[str]]:
    """Sets of atoms of each of which one must be true for the form to hold; none if it can hold without any."""
    head, *rest = form
    if head == "not":
        return []
    if head == "and":
        return [k for p in rest for k in keys_of(p)]
    if head == "or":
        each = [keys_of(p) for p in rest]
        return [sorted(set().union(*(min(k, key=len) for k in each)))] if all(each) else []
    return [[head]]


def holds(form: list, true: frozenset[str]) -> bool:
    head, *rest = form
    if head == "and":
        return all(holds(p, true) for p in rest)
    if head == "or":
        return any(holds(p, true) for p in rest)
    return not holds(rest[0], true) if head == "not" else head in true


def clauses_of(form: list, negated: bool = False) -> list[tuple[frozenset[str], frozenset[str]]] | None:
    """(true atoms, false atoms) of each clause; None if they are too many."""
    head, *rest = form
    if head == "not":
        return clauses_of(rest[0], not negated)
    if head not in ("and", "or"):
        return [(frozenset(), frozenset([head]))] if negated else [(frozenset([head]), frozenset())]
    parts = [clauses_of(p, negated) for p in rest]
    if any(p is None for p in parts):
        return None
    if (head == "and") == negated:  # any of them
        out = [c for p in parts for c in p]
    else:
        out = [(frozenset(), frozenset())]
        for p in parts:
            out = [(a | c, b | d) for a, b in out for c, d in p]
            if len(out) > CLAUSES:
                return None
    out = [c for c in dict.fromkeys(out) if not c[0] & c[1]]
    return out if len(out) <= CLAUSES else None


def _clauses(form: list) -> list[tuple[str, list[str], list[list[str]]]]:
    """Each clause as text, its atoms and the sets of atoms of which one must be true."""
    found = clauses_of(form)
    if found is None:
        return [(json.dumps(form, ensure_ascii=False), sorted(atoms_in(form)), keys_of(form))]
    return [(json.dumps({"true": sorted(t), "false": sorted(f)}, ensure_ascii=False), sorted(t | f), [[a] for a in sorted(t)]) for t, f in found]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("clause", pa.string()), ("atoms", pa.list_(pa.string())), ("keys", pa.list_(pa.list_(pa.string())))]))
    for b in batches:
        errors, clauses = [], []
        for text in b["text"].to_pylist():
            try:
                clauses.append([dict(zip(("clause", "atoms", "keys"), c, strict=True)) for c in _clauses(form_of(lang.parse(text).where))])
                errors.append(None)
            except lang.FilterSyntaxError as e:
                clauses.append([])
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([b["text"], pa.array(errors, pa.string()), pa.array(clauses, kind)], names=["text", "error", "clauses"])


@lru_cache(100_000)
def _loaded(clause: str) -> list | tuple[frozenset[str], frozenset[str]]:
    c = json.loads(clause)
    return c if isinstance(c, list) else (frozenset(c["true"]), frozenset(c["false"]))


def _holds(clause: str, met: frozenset[str]) -> bool:
    c = _loaded(clause)
    return holds(c, met) if isinstance(c, list) else c[0] <= met and not c[1] & met


def _try(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(clause_id, class, met, clause) to those (clause_id, class) that hold."""
    for b in batches:
        sets: dict[int, frozenset[str]] = {}
        met, keep = b["met"], []
        for i, (c, clause) in enumerate(zip(b["class"].to_pylist(), b["clause"].to_pylist(), strict=True)):
            if c not in sets:
                sets[c] = frozenset(met[i].as_py())
            keep.append(_holds(clause, sets[c]))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b["clause_id"].filter(mask), b["class"].filter(mask)], names=["clause_id", "class"])


# ---- tickets to atoms


def _probes(families: list[tuple[str, str]]) -> list[Column]:
    """Arrays of the names that a ticket's own values give."""

    def named(kind: str, field: str) -> Column:
        head = F.lit(_name(kind, field, ""))
        if kind == ELEMENT:
            return F.transform(field, lambda v: F.concat(head, v))
        text = F.coalesce(lang._scalar(field), F.lit("None"))
        return F.array(F.concat(head, F.lower(text) if kind == EQUAL else text))

    return [named(*f) for f in families]


@dataclass
class Matches:
    filters: DataFrame  # filter_id, text, text_id, error
    texts: DataFrame  # text_id, base_id: the set of those of its clauses that other texts have too; null if it has none
    base_pairs: DataFrame  # base_id, class: which sets hold for which classes
    own_pairs: DataFrame  # text_id, class: for which classes a text holds by a clause of its own alone
    members: DataFrame  # class and the tickets' columns
    sizes: DataFrame  # class, n: its tickets

    def rows(self) -> DataFrame:
        """(filter_id, the tickets' columns): one row for each ticket of each filter. The rows of a shared set meet its filters last, in parts of some PART tickets,
        and are not exchanged behind that. A filter has all tickets of a part in one order, so files of the rows repeat a few values and stay small
        however many filters a set has. The number of partitions is held, as the size of what they read says nothing of the rows that they make."""
        named = self.filters.filter("error is null").select("filter_id", "text_id")
        columns = [c for c in self.members.columns if c != "class"]
        own = named.join(self.own_pairs, "text_id").join(self.members, "class").select("filter_id", *columns)
        n = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = self.base_pairs.join(self.sizes, "class").groupBy("base_id").agg(F.ceil(F.sum("n") / PART).alias("_parts"))
        part = F.pmod(F.xxhash64(*columns), F.col("_parts")).alias("_part")
        tickets = self.base_pairs.join(parts, "base_id").join(self.members, "class").select("base_id", part, *columns).repartition(n, "base_id", "_part")
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part")
        asking = named.join(self.texts, "text_id").join(parts, "base_id").select("filter_id", "base_id", every).repartition(n, "base_id", "_part")
        return own.union(asking.join(tickets, ["base_id", "_part"]).select("filter_id", *columns))

    def totals(self, *sums: str) -> DataFrame:
        """(filter_id, error, n, sums): counted by class, set and text before filters are looked up. n is null where there is an error."""
        per_class = self.members.groupBy("class").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
        added = lambda pairs, by, head: pairs.join(per_class, "class").groupBy(by).agg(*(F.sum(c).alias(head + c) for c in ("n", *sums)))
        both = self.texts.join(added(self.base_pairs, "base_id", "_b_"), "base_id", "left").join(added(self.own_pairs, "text_id", "_o_"), "text_id", "left")
        total = lambda c: F.coalesce(F.col(f"_b_{c}") + F.col(f"_o_{c}"), F.col(f"_b_{c}"), F.col(f"_o_{c}")).alias(c)
        per_text = both.select("text_id", *(total(c) for c in ("n", *sums)))
        n = F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).alias("n")
        return self.filters.join(per_text, "text_id", "left").select("filter_id", "error", n, *sums)


def match(issues: DataFrame, saved: DataFrame, now: datetime | None = None, columns: tuple[str, ...] = ("ord", "key"), block: int = BLOCK) -> Matches:
    """issues: the ticket view, keys unique. saved: filter_id, text; a null text is an empty one. columns: of the tickets, kept in the result."""
    spark = issues.sparkSession
    send_package(spark)
    cut = lambda df, label: written(df, shared_path(spark, f"filters-{label}"))
    numbered = lambda name: F.monotonically_increasing_id().alias(name)  # noqa: E731  stays, as what is numbered is written
    saved = saved.select("filter_id", F.coalesce("text", F.lit("")).alias("text"))
    parsed = cut(saved.select("text").distinct().mapInArrow(_parse, PARSED).select("*", numbered("text_id")), "parsed")
    parts = parsed.select("text_id", F.inline("clauses"))
    clauses = cut(parts.groupBy("clause").agg(F.first("atoms").alias("atoms"), F.first("keys").alias("keys")).select("*", numbered("clause_id")), "clauses")
    atoms = clauses.select(F.explode("atoms").alias("atom")).distinct()
    kind, field = (F.split_part("atom", F.lit(SEP), F.lit(i)) for i in (1, 2))
    found_by_value = kind.isin(EQUAL, EXACT, ELEMENT)
    families = [(r["kind"], r["field"]) for r in atoms.filter(found_by_value).select(kind.alias("kind"), field.alias("field")).distinct().collect()]  # kinds x fields
    evaluated = sorted(r["atom"] for r in atoms.filter(~found_by_value).collect())

    keep = list(dict.fromkeys((*columns, "key")))
    hits = issues.select("key", F.lit(None).cast("string").alias("atom")).limit(0)
    if families:
        probes = issues.select("key", F.explode(F.array_distinct(F.concat(*_probes(families)))).alias("atom"))
        hits = hits.union(probes.join(atoms.filter(found_by_value), "atom").select("key", "atom"))
    for at in range(0, len(evaluated), block):
        tests = [F.when(lang.compile_tree(atom_of(a), now), F.lit(a)) for a in evaluated[at : at + block]]
        hits = hits.union(issues.select("key", F.explode(F.array_compact(F.array(*tests))).alias("atom")))
    sets = hits.groupBy("key").agg(F.sort_array(F.collect_set("atom")).alias("met"))
    rows = cut(issues.select(*keep).join(sets, "key", "left").withColumn("met", F.coalesce("met", F.array().cast("array<string>"))), "rows")
    classes = cut(rows.groupBy("met").agg(F.count("*").alias("n")).select("*", numbered("class")), "classes")
    members = rows.join(classes.select("met", "class"), "met").select(*keep, "class")
    filters = saved.join(parsed.select("text", "text_id", "error"), "text")
    hold = cut(_clause_classes(clauses, classes), "hold")
    uses = cut(parts.join(clauses.select("clause", "clause_id"), "clause").select("text_id", "clause_id"), "uses")
    shared = uses.groupBy("clause_id").agg(F.count("*").alias("texts")).select("clause_id", (F.col("texts") > 1).alias("shared"))
    by_text = uses.join(shared, "clause_id").groupBy("text_id").agg(F.sort_array(F.collect_set(F.when(F.col("shared"), F.col("clause_id")))).alias("base"))
    by_text = cut(by_text, "bases-of-texts")
    bases = cut(by_text.filter(F.size("base") > 0).select("base").distinct().select("*", numbered("base_id")), "bases")
    texts = cut(by_text.join(bases, "base", "left").select("text_id", "base_id"), "texts")
    base_pairs = cut(bases.select("base_id", F.explode("base").alias("clause_id")).join(hold, "clause_id").select("base_id", "class").distinct(), "base-pairs")
    own = uses.join(shared.filter(~F.col("shared")), "clause_id").join(hold, "clause_id").select("text_id", "class").distinct()
    own = own.join(texts, "text_id").join(base_pairs, ["base_id", "class"], "left_anti").select("text_id", "class")
    return Matches(filters, texts, base_pairs, cut(own, "own-pairs"), members, classes.select("class", "n"))


def _clause_classes(clauses: DataFrame, classes: DataFrame) -> DataFrame:
    """(clause_id, class) that hold."""
    has = classes.select("class", "n", F.explode("met").alias("atom"))
    tickets = has.groupBy("atom").agg(F.sum("n").alias("n"))
    choices = clauses.select("clause_id", F.posexplode("keys").alias("choice", "key")).select("clause_id", "choice", F.explode("key").alias("atom"))
    cost = choices.join(tickets, "atom", "left").groupBy("clause_id", "choice").agg(F.sum(F.coalesce("n", F.lit(0))).alias("cost"))
    chosen = cost.groupBy("clause_id").agg(F.min(F.struct("cost", "choice")).alias("best")).select("clause_id", "best.choice")
    keyed = choices.join(chosen, ["clause_id", "choice"]).select("clause_id", "atom").join(has.select("class", "atom"), "atom").select("clause_id", "class").distinct()
    always = clauses.filter(F.size("keys") == 0).select("clause_id").crossJoin(classes.select("class"))  # clauses that hold for most tickets, with the classes
    tried = keyed.union(always).join(clauses.select("clause_id", "clause"), "clause_id").join(classes.select("class", "met"), "class")
    return tried.select("clause_id", "class", "met", "clause").mapInArrow(_try, "clause_id long, class long")
