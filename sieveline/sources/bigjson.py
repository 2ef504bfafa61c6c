"""One large JSON object read in parallel: byte ranges that find the boundaries of elements by themselves.

An element is an element of an array, or a member of an object, that is itself a member of the object at the top. Where a range begins, nobody
knows whether that is inside a string or how deep. So a range is read twice. First for both cases, to a small summary: whether it ends in a
string, the containers that it closes and those that it leaves open, each with its commas. The driver walks through the summaries in order, two
rows a range, and so knows what every range is entered with. Then each range yields the elements whose opening bracket or comma lies in it, with
their position, and reads on behind its end for the last one. Elements are text; Spark parses them with a declared schema.

The path is a file, or a directory whose files, in the order of their names, are one text (names that begin with ``_`` or ``.`` are left out). A text that
ends inside a string or a value is an error; other faults show in the elements alone, as no range sees the whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.workers import send_package
from sieveline.sources.issues import CORPUS, PROFILE, Corpus, Domains, normalise, with_defaults

RANGE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20

_MARKS = re.compile(rb'["\[\]{},]')
_QUOTE = re.compile(rb'["\\]')
_SPACE = re.compile(rb"[ \t\r\n]*")
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"[ \t\r\n]*:[ \t\r\n]*$', re.DOTALL)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)


class Text:
    """The files of a path as one text of bytes."""

    def __init__(self, path: str):
        self.fs, root = file_system(path)
        info = self.fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else [f for f in self.fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name[0] not in "_."]
        self.parts = [(f.path, f.size) for f in sorted(found, key=lambda f: f.path)]
        self.size = sum(n for _, n in self.parts)

    def read(self, start: int, end: int) -> bytes:
        out, at = [], 0
        for name, n in self.parts:
            a, b = max(start, at), min(end, at + n)
            if a < b:
                with self.fs.open_input_file(name) as f:
                    f.seek(a - at)
                    out.append(f.read(b - a))
            at += n
        return b"".join(out)

    def before(self, at: int, pattern: re.Pattern) -> re.Match | None:
        """pattern, which ends with $, on what stands before `at`; more is read until it matches or the text begins."""
        n = 64
        while True:
            m = pattern.search(self.read(max(0, at - n), at))
            if m or n >= at:
                return m
            n *= 8

    def escaped(self, at: int) -> bool:
        """Whether an odd run of backslashes stands before `at`."""
        n = 16
        while True:
            raw = self.read(max(0, at - n), at)
            run = len(raw) - len(raw.rstrip(b"\\"))
            if run < len(raw) or n >= at:
                return run % 2 == 1
            n *= 8


def _string_end(raw: bytes, at: int) -> int:
    """The place behind the quote that ends a string; -1 if it does not end in raw."""
    while m := _QUOTE.search(raw, at):
        if m[0] == b'"':
            return m.end()
        at = m.end() + 1
    return -1


@dataclass
class Open:
    """A container that is open: its bracket, the bracket's place, the commas in it so far."""

    kind: str
    at: int
    commas: int = 0


@dataclass
class Summary:
    inside: bool = False
    levels: list[int] = field(default_factory=lambda: [0])  # commas in the container at the entry, in the one around it, and so on, as they are closed
    opened: list[Open] = field(default_factory=list)


_KINDS = np.zeros(256, np.int8)
for _c, _k in (("[", 1), ("{", 1), ("]", -1), ("}", -1), (",", 2)):
    _KINDS[ord(_c)] = _k


def _marks(raw: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, their kinds (1 opens, -1 closes, 2 a comma), the number of string bounds before each, and of all. escaped: an odd run
    of backslashes stands before raw."""
    a = np.frombuffer(raw, np.uint8)
    quotes = np.flatnonzero(a == 34)
    behind = quotes[(quotes > 0) & (a[quotes - 1] == 92)] if len(quotes) else quotes
    if len(behind):
        slashes = np.flatnonzero(a == 92)
        runs = slashes[np.diff(slashes, prepend=-2) > 1]  # where runs of backslashes begin
        begins = runs[np.searchsorted(runs, behind - 1, "right") - 1]
        odd = (behind - begins + ((begins == 0) & escaped)) % 2 == 1
        quotes = np.setdiff1d(quotes, behind[odd], assume_unique=True)
    if escaped and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    kinds = _KINDS[a]
    at = np.flatnonzero(kinds)
    return at, kinds[at], np.searchsorted(quotes, at), len(quotes)


def _steps(kinds: np.ndarray) -> np.ndarray:
    """How many more containers are open behind each mark than at the entry."""
    return np.cumsum(np.where(kinds == 2, 0, kinds), dtype=np.int64)


def _summary(raw: bytes, start: int, inside: bool, marks: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> Summary:
    at, kinds, bounds, n = marks
    out = (bounds + inside) % 2 == 0
    at, kinds = at[out], kinds[out]
    depth = _steps(kinds)
    lowest = np.minimum(np.minimum.accumulate(depth), 0) if len(depth) else depth
    comma = kinds == 2
    closed = int(-lowest[-1]) if len(depth) else 0
    levels = np.bincount(-lowest[comma & (depth == lowest)], minlength=closed + 1).tolist()
    least_behind = np.minimum.accumulate(depth[::-1])[::-1]
    opened = []
    for i in np.flatnonzero((kinds == 1) & (least_behind >= depth)).tolist():
        commas = int(np.count_nonzero(comma[i:] & (depth[i:] == depth[i])))
        opened.append(Open(chr(raw[at[i]]), start + int(at[i]), commas))
    return Summary((n + inside) % 2 == 1, levels, opened)


def summarise(raw: bytes, start: int, inside: bool, escaped: bool) -> Summary:
    return _summary(raw, start, inside, _marks(raw, escaped))


def entered(stack: list[Open], s: Summary) -> list[Open]:
    """The containers that are open behind a range that was entered with `stack`."""
    stack = [Open(o.kind, o.at, o.commas) for o in stack]
    for k, commas in enumerate(s.levels):
        if stack:
            stack[-1].commas += commas
        if k < len(s.levels) - 1:
            if not stack:
                raise ValueError("a bracket closes what was not open")
            stack.pop()
    return stack + s.opened


class Walker:
    """The elements that a range of the text has to give."""

    def __init__(self, text: Text, start: int, end: int, inside: bool, depth: int, second: Open | None):
        self.text, self.start, self.inside, self.depth, self.second = text, start, inside, depth, second
        self.raw = text.read(start, end)
        self.limit = len(self.raw)

    def more(self) -> None:
        at = self.start + len(self.raw)
        new = self.text.read(at, min(self.text.size, at + max(1 << 16, len(self.raw))))
        if not new:
            raise ValueError("the text ends inside a value")
        self.raw += new

    def string(self, at: int) -> int:
        while (to := _string_end(self.raw, at)) < 0:
            self.more()
        return to

    def value(self, at: int) -> int:
        """The place of the comma or bracket behind the element that begins at `at`."""
        depth = 0
        while True:
            m = _MARKS.search(self.raw, at)
            if not m:
                self.more()
                continue
            c, at = m[0], m.end()
            if c == b'"':
                at = self.string(at)
            elif c in b"[{":
                depth += 1
            elif depth == 0:
                return m.start()
            elif c in b"]}":
                depth -= 1

    def elements(self) -> Iterator[tuple[Open, str]]:
        """Its container, whose commas are the element's position, and its text."""
        at, kinds, bounds, _ = _marks(self.raw[: self.limit], self.inside and self.text.escaped(self.start))
        out = (bounds + self.inside) % 2 == 0
        at, kinds = at[out], kinds[out]
        depth = self.depth + _steps(kinds)
        opens = (kinds == 1) & (depth == 2)
        begins = opens | ((kinds == 2) & (depth == 2))
        edges = begins | ((kinds == -1) & (depth == 1))
        at, opens, begins = at[edges].tolist(), opens[edges].tolist(), begins[edges].tolist()
        second, last = self.second, len(at) - 1
        for i, (a, new, begin) in enumerate(zip(at, opens, begins, strict=True)):
            if not begin:
                continue
            second = Open(chr(self.raw[a]), self.start + a) if new else Open(second.kind, second.at, second.commas + 1)
            to = at[i + 1] if i < last else self.value(a + 1)  # which may read on
            found = self.raw[a + 1 : to].strip(b" \t\r\n")
            if found:
                yield second, found.decode()


ELEMENTS = "name string, ord long, member string, element string"


@dataclass
class Range:
    """With what a range is entered, and the one container at the second level that it lies in as a whole, if it does."""

    number: int
    inside: bool
    depth: int
    second: Open | None
    whole: bool


def _bounds(k: int, size: int, range_bytes: int) -> tuple[int, int]:
    return k * range_bytes, min(size, (k + 1) * range_bytes)


def _name_of(text: Text, at: int) -> str:
    """The name that stands before a container."""
    m = text.before(at, _NAME)
    return json.loads(b'"' + m[1] + b'"') if m else ""


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[Range]:
    """The first reading: all ranges in order."""
    send_package(spark)
    size = Text(path).size
    n = max(1, -(-size // range_bytes))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Text(path)
        for b in batches:
            for k in b["id"].to_pylist():
                start, end = _bounds(k, size, range_bytes)
                raw = own.read(start, end)
                marks = _marks(raw, own.escaped(start))
                found = [_summary(raw, start, inside, marks) for inside in (False, True)]
                said = [json.dumps([s.inside, s.levels, [[o.kind, o.at, o.commas] for o in s.opened]]) for s in found]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array(said[:1]), pa.array(said[1:])], names=["number", "outside", "within"])

    numbers = spark.range(0, n, 1, n)
    said = {r["number"]: r for r in numbers.mapInArrow(summaries, "number long, outside string, within string").collect()}  # a small row a range
    out, inside, stack = [], False, []
    for k in range(n):
        into, levels, opened = json.loads(said[k]["within" if inside else "outside"])
        out.append(Range(k, inside, len(stack), stack[1] if len(stack) > 1 else None, len(levels) < len(stack)))
        inside, stack = into, entered(stack, Summary(into, levels, [Open(*o) for o in opened]))
    if inside or stack:
        raise ValueError(f"{path} ends inside a {'string' if inside else 'value'}")
    return out


def cut(spark: SparkSession, path: str, found: list[Range], range_bytes: int, names: tuple[str, ...] | None = None) -> DataFrame:
    """The second reading: `elements`. names: only those of these members of the top; ranges that lie in another member are not read."""
    text = Text(path)
    size = text.size
    if names is not None:
        known = {at: _name_of(text, at) for at in {r.second.at for r in found if r.whole}}
        found = [r for r in found if not r.whole or known[r.second.at] in names]
    entries = [(r.number, r.inside, r.depth, r.second.kind if r.second else None, r.second.at if r.second else None, r.second.commas if r.second else None) for r in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Text(path), {}

        def name_of(o: Open) -> str:
            if o.at not in seen:
                seen[o.at] = _name_of(own, o.at)
            return seen[o.at]

        for b in batches:
            for k, inside, depth, kind, at, commas in zip(*(b[c].to_pylist() for c in b.schema.names), strict=True):
                rows, held = [], 0
                for o, e in Walker(own, *_bounds(k, size, range_bytes), inside, depth, Open(kind, at, commas) if kind else None).elements():
                    name = name_of(o)
                    if names is not None and name not in names:
                        continue
                    member = None
                    if o.kind == "{":
                        raw = e.encode()
                        to = _string_end(raw, 1)
                        member, e = json.loads(raw[:to]), _SPACE.sub(b"", raw[to:], count=1)[1:].strip(b" \t\r\n").decode()
                    rows.append((name, o.commas, member, e))
                    held += len(e)
                    if held >= BATCH_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["name", "ord", "member", "element"])

    told = spark.createDataFrame(entries, "number long, inside boolean, depth int, kind string, at long, commas long")
    return told.repartition(max(1, len(entries)), "number").mapInArrow(run, ELEMENTS)


def elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(name, ord, member, element): name of the top's member, position in it from 0, name of the element where it has one, its JSON text."""
    return cut(spark, path, ranges(spark, path, range_bytes), range_bytes)


def range_bytes_for(path: str, least: int, count: int = 256) -> int:
    """A size of ranges that gives about `count` of them, from `least` up to RANGE_BYTES: tasks grow with the text only where it is very long."""
    return max(least, min(RANGE_BYTES, -(-Text(path).size // count)))


def load_corpus(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> Corpus:
    """`issues.load_corpus` by ranges: the same rows with the same positions. Only the declared domains come to the driver."""
    found = ranges(spark, path, range_bytes)
    issues = cut(spark, path, found, range_bytes, ("issues",)).select("ord", F.from_json("element", CORPUS["issues"].dataType.elementType).alias("i"))
    declared: dict[str, list] = {"statuses": [], "priorities": [], "issue_types": [], "projects": []}
    for r in cut(spark, path, found, range_bytes, tuple(declared)).orderBy("name", "ord").collect():
        v = json.loads(r["element"])
        declared[r["name"]].append(v["key"] if isinstance(v, dict) else v)
    return Corpus(normalise(issues.select("ord", "i.*")), Domains(*map(tuple, (declared["projects"], declared["statuses"], declared["priorities"], declared["issue_types"]))))


def load_profiles(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`issues.load_profiles` by ranges."""
    found = cut(spark, path, ranges(spark, path, range_bytes), range_bytes, ("permissions",))
    return with_defaults(found.select(F.col("member").alias("user_id"), F.from_json("element", PROFILE).alias("p")).select("user_id", "p.*"))


def write_object(path: str, members: dict[str, DataFrame], listed: dict[str, list] | None = None) -> None:
    """One JSON object below path, in parts: `listed` members as they are, then each of members, whose rows (ord, element) are put in order of ord as an
    array, or (ord, member, element) as an object. Rows are written by tasks; the driver writes brackets and names."""
    spark = next(iter(members.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def mark(name: str, text: str) -> None:
        out = fs.create(at(f"{path}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    before = "{" + "".join(f"{json.dumps(k)}: {json.dumps(v)}, " for k, v in (listed or {}).items())
    for k, (name, rows) in enumerate(members.items()):
        named = "member" in rows.columns
        mark(f"{k:03d}-0", f"{before}{json.dumps(name)}: {'{' if named else '['}")
        quoted = F.regexp_extract(F.to_json(F.array("member")), r"(?s)^\[(.*)\]$", 1) if named else None
        # the first row of the first range has the number 0
        line = F.concat(F.when(F.monotonically_increasing_id() == 0, "").otherwise(","), *([quoted, F.lit(":")] if named else []), "element")
        rows.repartitionByRange("ord").sortWithinPartitions("ord").select(line.alias("value")).write.text(f"{path}/_{k}")
        parts = sorted(s.getPath().getName() for s in fs.listStatus(at(f"{path}/_{k}")))
        for p in (p for p in parts if p.startswith("part-")):
            fs.rename(at(f"{path}/_{k}/{p}"), at(f"{path}/{k:03d}-1-{p}"))
        before = ("}" if named else "]") + ", "
    mark(f"{len(members):03d}", before[0] + "}")
