"""A text index that takes changes: immutable segments, document-frequency differences, tombstones and a merge.

A change writes one segment and a version; nothing that is there already is written again. A segment holds the counts, postings and documents of
what was added or changed, `gone`, the keys whose earlier form it takes out of the segments before it, and `df`, by how much each term's
document frequency moves (up by the new documents, down by those gone). So the frequencies of the whole corpus are sums of small tables, and a
posting counts if no later segment has taken its key out. Scores are those of an index built at once, as idf and norms are always those
of the version; both are made once a version. Counts are stored as a row a document, so taking documents out meets no postings.

A version is a small JSON file, created whole and never overwritten: of two writers that start from one version the second fails and may try again;
readers see a version or do not. `merge` makes one segment of the last ones, `vacuum` deletes what the newest version does not name.

Input: keys are unique within a change; a null text is an empty one; a key that is deleted without being there changes nothing; null keys are
dropped, as they can't be named.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.storage import _at, delete, exists, written
from sieveline.operators import textindex

#: Up to this many keys are written into the scan's filter, where Bloom filters skip row groups; more are joined.
FILTER_KEYS = 1000

SCHEMAS = {"counts": "key string, ord long, terms array<string>, tfs array<long>", "postings": textindex.BLOCKS, "docs": "key string, ord long", "gone": "key string", "df": "term string, d long"}


@dataclass
class Version:
    number: int = 0
    segments: list[str] = field(default_factory=list)
    documents: int = 0


class SegmentedIndex:
    """An index below a path in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- versions

    def versions(self) -> list[int]:
        fs, p = _at(self.spark, f"{self.path}/versions")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def version(self, number: int | None = None) -> Version:
        """The newest, or an older one as long as its segments are there."""
        known = self.versions()
        if not known:
            return Version()
        fs, p = _at(self.spark, f"{self.path}/versions/{number or known[-1]:08d}.json")
        stream = fs.open(p)
        try:
            return Version(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def _commit(self, v: Version) -> Version:
        fs, p = _at(self.spark, f"{self.path}/versions/{v.number:08d}.json")
        mine = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(mine, False)
        out.write(bytearray(json.dumps(vars(v)).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(mine, p):
            fs.delete(mine, False)
            raise RuntimeError(f"version {v.number} is there already: another writer was first")
        return v

    # -- reading

    def _table(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/segments/{segment}/{name}")

    def _all(self, segments: list[str], name: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{SCHEMAS[name]}, at int")
        for i, s in enumerate(segments):
            out = out.union(self._table(s, name).withColumn("at", F.lit(i)))
        return out

    def live(self, segments: list[str], name: str) -> DataFrame:
        """Rows of counts or docs, and single postings, that no later segment has taken out."""
        rows = self._all(segments, name)
        if name == "postings":
            rows = rows.select("term", "at", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("ords").alias("ord"), F.col("tfs").alias("tf"))))
            rows = rows.select("key", "ord", "term", F.col("tf").cast("long").alias("tf"), "at")
        if len(segments) > 1:
            gone = self._all(segments, "gone").groupBy("key").agg(F.max("at").alias("until"))
            rows = rows.join(gone.withColumnRenamed("key", "gone_key"), (F.col("key") == F.col("gone_key")) & (F.col("at") < F.col("until")), "left_anti")
        return rows.drop("at")

    def idf(self, v: Version) -> DataFrame:
        sums = self._all(v.segments, "df").groupBy("term").agg(F.sum("d").alias("df")).filter("df > 0")
        return sums.select("term", "df", F.log(F.lit(v.documents) / F.col("df")).alias("idf"))

    def _once(self, v: Version, name: str, df: DataFrame) -> DataFrame:
        """A table of the version, written when it is first asked for."""
        path = f"{self.path}/{name}/{v.number:08d}"
        if exists(self.spark, f"{path}/_SUCCESS"):
            return self.spark.read.schema(df.schema).parquet(path)
        delete(self.spark, path)
        return written(df, path)

    def open(self, number: int | None = None) -> textindex.TextIndex:
        """The version as an index that every search of `textindex` takes."""
        v = self.version(number)
        rows = self.live(v.segments, "counts")
        idf = self._once(v, "idf", self.idf(v))
        norms = self._once(v, "norms", textindex.document_lengths(rows, idf))
        return textindex.TextIndex(self.live(v.segments, "docs").select("ord", "key"), rows, textindex.by_term(rows), self.live(v.segments, "postings"), idf, norms)

    # -- writing

    def _write(self, segment: str, name: str, df: DataFrame, **options: str) -> DataFrame:
        return written(df.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))), f"{self.path}/segments/{segment}/{name}", **options)

    def _write_counts(self, segment: str, rows: DataFrame) -> DataFrame:
        rows = self._write(segment, "counts", rows, **textindex.BY_KEY)
        self._write(segment, "postings", textindex.sorted_blocks(rows))
        return rows

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Version:
        """upserts: ord, key, text: added, or put in the place of the key's earlier form. deletes: key."""
        v, name = self.version(), uuid.uuid4().hex
        new = (self.spark.createDataFrame([], "ord long, key string, text string") if upserts is None else upserts.select(F.col("ord").cast("long").alias("ord"), F.col("key").cast("string").alias("key"), "text")).filter("key is not null")
        rows = self._write_counts(name, textindex.document_counts(new))
        docs = self._write(name, "docs", new)
        keys = docs.select("key") if deletes is None else docs.select("key").union(deletes.select(F.col("key").cast("string"))).distinct()
        gone = self._write(name, "gone", self.live(v.segments, "docs").select("key").join(keys, "key", "left_semi"))
        n_gone = gone.count()
        old = self.live(v.segments, "counts")
        if n_gone <= FILTER_KEYS:
            old = old.filter(F.col("key").isin([r["key"] for r in gone.collect()]))
        else:
            old = old.join(gone, "key", "left_semi")
        moved = rows.select("terms", F.lit(1).alias("d")).union(old.select("terms", F.lit(-1)))
        self._write(name, "df", moved.select(F.explode("terms").alias("term"), "d").groupBy("term").agg(F.sum("d").alias("d")).filter("d <> 0"))
        return self._commit(Version(v.number + 1, [*v.segments, name], v.documents + docs.count() - n_gone))

    def merge(self, first: int = 0) -> Version:
        """One segment of all from the one at place `first` on; the segments before it stay as they are, and what was taken out of them stays out."""
        v, name = self.version(), uuid.uuid4().hex
        some = v.segments[first:]
        if len(some) < 2:
            return v
        self._write_counts(name, self.live(some, "counts"))
        self._write(name, "docs", self.live(some, "docs"))
        before = self._all(v.segments[:first], "docs").select("key").distinct()
        self._write(name, "gone", self._all(some, "gone").select("key").distinct().join(before, "key", "left_semi"))
        self._write(name, "df", self._all(some, "df").groupBy("term").agg(F.sum("d").alias("d")).filter("d <> 0"))
        return self._commit(Version(v.number + 1, [*v.segments[:first], name], v.documents))

    def vacuum(self) -> int:
        """Deletes segments, versions, idf and norms that the newest version does not need; returns how many. Readers of older versions fail from then on."""
        v, n = self.version(), 0
        for part, keep in (("segments", set(v.segments)), ("norms", {f"{v.number:08d}"}), ("idf", {f"{v.number:08d}"}), ("versions", {f"{v.number:08d}.json"})):
            fs, p = _at(self.spark, f"{self.path}/{part}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in keep:
                    fs.delete(s.getPath(), True)
                    n += 1
        return n
