"""TF-IDF cosine search over an inverted index held as DataFrames.

Weights are term count times ln(N / df), unsmoothed, so a term of every document weighs nothing. Scores are compared unrounded with the
threshold, then rounded to four places and ranked; ties keep document order.

`store` writes the index once: counts as a row a document, and postings sorted by term over range partitions, so that a query reads the row groups
of its own terms and nothing else. A stored row of postings holds those of one term in some neighbouring documents; a term of very many documents
has many such rows and lies in several partitions. A posting holds its count alone: the term's idf comes with the query, and the norms of what was
found by document. `build` is the same index as a plan that is computed when it is read, for small corpora. Batches of queries are joined by
`simjoin`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.columns import STOPWORDS, tokens
from sieveline.functions.storage import written

NO_TERMS = "Query produced no searchable terms"


def document_text(issues: DataFrame) -> DataFrame:
    """(ord, key, text): all searchable parts in a fixed order, lower-cased; missing parts leave nothing behind."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    parts = [F.col("key"), F.col("summary"), blank(F.col("description")), F.col("status"), F.col("priority"), F.col("type"), F.array_join("labels", " "), F.array_join("components", " "),
             F.col("assignee.displayName"), F.col("reporter.displayName"), F.array_join(F.transform("comments", lambda c: blank(c["body"])), " ")]
    return issues.select("ord", "key", F.lower(F.concat_ws(" ", *parts)).alias("text"))


@dataclass
class TextIndex:
    docs: DataFrame  # ord, key
    rows: DataFrame  # key, ord, terms, tfs: a row a document
    counts: DataFrame  # key, ord, term, tf: the same, a row a term
    postings: DataFrame  # key, ord, term, tf: by term
    idf: DataFrame  # term, df, idf
    norms: DataFrame  # key, norm


#: Terms in one Arrow batch that leaves the counting.
BATCH = 200_000


def document_counts(docs: DataFrame) -> DataFrame:
    """(key, ord, terms, tfs), a row a document: the counts of `tokens`. A document is counted where its row is, in Arrow batches, so nothing is exchanged
    and a text is cut into words once whatever is asked of the counts."""
    stops = frozenset(STOPWORDS)
    most = BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        words = re.compile("[a-z0-9]+").findall

        def out(b: pa.RecordBatch, first: int, sizes: list[int], terms: list[str], tfs: list[int]) -> pa.RecordBatch:
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((terms, pa.string()), (tfs, pa.int64()))]
            return pa.RecordBatch.from_arrays([b["key"].slice(first, len(sizes)), b["ord"].slice(first, len(sizes)), *lists], names=["key", "ord", "terms", "tfs"])

        for b in batches:
            first, sizes, terms, tfs = 0, [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                found = {w: n for w, n in Counter(words(text)).items() if len(w) > 1 and w not in stops}
                sizes.append(len(found))
                terms += found
                tfs += found.values()
                if len(terms) >= most:
                    yield out(b, first, sizes, terms, tfs)
                    first, sizes, terms, tfs = i + 1, [], [], []
            if sizes:
                yield out(b, first, sizes, terms, tfs)

    lowered = docs.select(F.col("key").cast("string").alias("key"), F.col("ord").cast("long").alias("ord"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return lowered.mapInArrow(run, "key string, ord long, terms array<string>, tfs array<long>")


def by_term(counted: DataFrame) -> DataFrame:
    """(key, ord, term, tf) of rows of documents."""
    return counted.select("key", "ord", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))


def term_counts(docs: DataFrame) -> DataFrame:
    """(key, ord, term, tf): `document_counts`, a row a term."""
    return by_term(document_counts(docs))


#: Postings that are put together before they leave a task.
BLOCK = 500_000


def posting_blocks(counted: DataFrame) -> DataFrame:
    """(term, first, keys, ords, tfs): the postings of a term in neighbouring documents, in their order; first is the least ord. counted: `document_counts`.
    What is sorted by term has then far fewer rows than there are postings."""
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ends = np.concatenate([[0], np.cumsum(b["terms"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
                part, sizes = b.slice(at, to - at), np.diff(ends[at : to + 1])
                at = to
                if not sizes.sum():
                    continue
                coded = part["terms"].flatten().dictionary_encode()
                codes = coded.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes)[order])
                offsets, ords = pa.array(starts, pa.int32()), part["ord"].take(row)
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (part["key"].take(row), ords, part["tfs"].flatten().take(pa.array(order)).cast(pa.int32()))]
                least = np.minimum.reduceat(ords.fill_null(-(1 << 63)).to_numpy(), starts[:-1])
                for i in range(0, len(coded.dictionary), 50_000):
                    yield pa.RecordBatch.from_arrays([x.slice(i, 50_000) for x in (coded.dictionary, pa.array(least), *lists)], names=["term", "first", "keys", "ords", "tfs"])

    return counted.select("key", "ord", "terms", "tfs").mapInArrow(run, BLOCKS)


BLOCKS = "term string, first long, keys array<string>, ords array<long>, tfs array<int>"


def sorted_blocks(counted: DataFrame) -> DataFrame:
    return posting_blocks(counted).repartitionByRange("term", "first").sortWithinPartitions("term", "first")


def postings_of(blocks: DataFrame) -> DataFrame:
    """(key, ord, term, tf) of `posting_blocks`."""
    each = blocks.select("term", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("ords").alias("ord"), F.col("tfs").alias("tf"))))
    return each.select("key", "ord", "term", F.col("tf").cast("long").alias("tf"))


def inverse_frequencies(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf). The number of documents is one row and joins by broadcast."""
    n = docs.agg(F.count("*").alias("n"))
    return counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    return counts.join(idf, "term").select("key", "ord", "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))


def lengths(weighted: DataFrame) -> DataFrame:
    """(key, norm)."""
    return weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def build(docs: DataFrame) -> TextIndex:
    """docs: ord, key (unique), text. The counts are used by every part, so callers with many queries should `persist` or `store` the index."""
    rows = document_counts(docs)
    counts = by_term(rows)
    idf = inverse_frequencies(counts, docs)
    return TextIndex(docs.select("ord", "key"), rows, counts, counts, idf, lengths(weights(counts, idf)))


#: So many of the most common terms at most are joined by broadcast, all others by a shuffle.
COMMON = 50_000


def document_lengths(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """`lengths` of rows of documents and a written idf. Common terms, which most postings have, meet their idf where the document is and leave one sum a
    document; the postings of the other terms alone are exchanged."""
    bits = F.length(F.bin("df"))
    sizes = {r["b"]: r["count"] for r in idf.groupBy(bits.alias("b")).count().collect()}  # a row for each doubling of df
    least, n = 64, 0
    for b in sorted(sizes, reverse=True):
        n += sizes[b]
        if n > COMMON:
            break
        least = b
    square = F.pow(F.col("tf") * F.col("idf"), F.lit(2))
    known = by_term(rows).join(F.broadcast(idf.filter(bits >= least).select("term", "idf")), "term", "left")  # at most COMMON rows
    often = known.groupBy("key").agg(F.sum(F.coalesce(square, F.lit(0.0))).alias("s"))
    seldom = known.filter("idf is null").select("key", "term", "tf").join(idf.filter(bits < least).select("term", "idf"), "term").groupBy("key").agg(F.sum(square).alias("s"))
    return often.union(seldom).groupBy("key").agg(F.sqrt(F.sum("s")).alias("norm"))


def persist(index: TextIndex) -> TextIndex:
    """Keeps postings and norms on the executors (memory, then disk) for repeated queries."""
    return TextIndex(index.docs, index.rows, index.counts, index.postings.persist(), index.idf.persist(), index.norms.persist())


def store(docs: DataFrame, path: str) -> TextIndex:
    """`build`, each part written below path once and read from there: counts in document order with a Bloom filter over keys, the rest by term. The
    texts are read once; idf, norms and postings are made of the written counts."""
    return with_postings(store_documents(docs, path), path)


def store_documents(docs: DataFrame, path: str) -> TextIndex:
    """`store` without postings by term, which batches of queries do not read; its postings are its counts."""
    rows = written(document_counts(docs), f"{path}/counts", **BY_KEY)
    counts = by_term(rows)
    idf = written(inverse_frequencies(counts, docs).repartitionByRange("term").sortWithinPartitions("term"), f"{path}/idf")
    norms = written(document_lengths(rows, idf), f"{path}/norms")
    return TextIndex(docs.select("ord", "key"), rows, counts, counts, idf, norms)


def with_postings(index: TextIndex, path: str) -> TextIndex:
    return replace(index, postings=postings_of(written(sorted_blocks(index.rows), f"{path}/postings")))


#: Options of tables of counts: a document is found by its key.
BY_KEY = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def _cosines(matched: DataFrame, q_norms: DataFrame, norms: DataFrame) -> DataFrame:
    """matched: query_id, key, ord, tf, idf, q_weight."""
    dots = matched.groupBy("query_id", "key", "ord").agg(F.sum(F.col("tf") * F.col("idf") * F.col("q_weight")).alias("dot"))
    scored = dots.join(q_norms, "query_id").join(norms, "key").filter((F.col("q_norm") > 0) & (F.col("norm") > 0))
    return scored.select("query_id", "key", "ord", (F.col("dot") / (F.col("q_norm") * F.col("norm"))).alias("score"))


def similarities(index: TextIndex, query_terms: DataFrame) -> DataFrame:
    """(query_id, key, ord, score) of all pairs that share a weighted term. query_terms: query_id, term, tf."""
    q = query_terms.join(index.idf, "term").select("query_id", "term", "idf", (F.col("tf") * F.col("idf")).alias("q_weight"))
    q_norms = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q_weight") * F.col("q_weight"))).alias("q_norm"))
    return _cosines(index.postings.join(q, "term"), q_norms, index.norms)


#: Up to this many terms of one query are written into the scan's filter; beyond it a join by broadcast finds them.
FILTER_TERMS = 1000


def similarities_to(index: TextIndex, text: str) -> DataFrame:
    """`similarities` for one query, whose terms (as many as its text has) come to the driver, so that the scan skips all other postings."""
    tf = Counter(index.docs.sparkSession.range(1).select(tokens(F.lit(text)).alias("t")).first()["t"])
    return _similarities_of(index, tf)


def _similarities_of(index: TextIndex, tf: dict[str, int]) -> DataFrame:
    """`similarities` for the terms of one text. Up to FILTER_TERMS are written into the scan; more are one text's terms still, and join by broadcast."""
    spark = index.docs.sparkSession
    asked = F.broadcast(spark.createDataFrame(list(tf.items()), "term string, q_tf long"))
    few = len(tf) <= FILTER_TERMS
    among = lambda df: df.filter(F.col("term").isin(list(tf))) if few else df.join(asked.select("term"), "term", "left_semi")
    known = among(index.idf).select("term", "idf").collect()
    q = [(0, r["term"], r["idf"], tf[r["term"]] * r["idf"]) for r in known]
    q_rows = spark.createDataFrame(q, "query_id int, term string, idf double, q_weight double")
    q_norm = spark.createDataFrame([(0, math.sqrt(sum(w * w for *_, w in q)))], "query_id int, q_norm double")
    postings = index.postings.filter(F.col("term").isin(list(tf))) if few else index.postings
    return _cosines(postings.join(F.broadcast(q_rows), "term"), F.broadcast(q_norm), index.norms)  # at most one text's terms


def ranked(scored: DataFrame, top_k: int | Column, min_score: float) -> DataFrame:
    """(query_id, key, ord, score, rank): the best top_k of each query with at least min_score."""
    kept = scored.filter(F.col("score") >= min_score).withColumn("score", F.round("score", 4))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ord"))
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, tf). queries: query_id, text."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))


def search_batch(index: TextIndex, queries: DataFrame, top_k: int = 5, min_score: float = 0.1) -> DataFrame:
    """All queries in one plan. At a threshold of zero or less, documents without a shared term count with score zero."""
    if min_score > 0:
        from sieveline.operators import simjoin

        return ranked(simjoin.best_pairs(index, simjoin.query_vectors(index, query_terms(queries)), top_k, min_score), top_k, min_score)
    found = similarities(index, query_terms(queries))
    every = query_terms(queries).select("query_id").distinct().crossJoin(index.docs)  # asked for: every document of every query
    found = every.join(found.select("query_id", "key", "score"), ["query_id", "key"], "left").select("query_id", "key", "ord", F.coalesce("score", F.lit(0.0)).alias("score"))
    return ranked(found, top_k, min_score)


def search(index: TextIndex, text: str, top_k: int = 5, min_score: float = 0.1) -> DataFrame:
    """(key, ord, score, rank) for one query; a limit on the sorted scores rather than a window."""
    spark = index.docs.sparkSession
    found = similarities_to(index, text)
    if min_score <= 0:
        some = query_terms(spark.createDataFrame([(0, text)], "query_id int, text string")).limit(1).select(F.lit(1).alias("any"))
        found = index.docs.join(found.select("key", "score"), "key", "left").crossJoin(F.broadcast(some)).select("key", "ord", F.coalesce("score", F.lit(0.0)).alias("score"))
    best = found.filter(F.col("score") >= min_score).select("key", "ord", F.round("score", 4).alias("score")).orderBy(F.col("score").desc(), F.col("ord")).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("ord"))))  # at most top_k rows


def similar(index: TextIndex, key: str, top_k: int = 3, min_score: float = 0.1) -> DataFrame:
    """(key, ord, score, rank): the document's own postings as the query, itself left out."""
    own = index.rows.filter(F.col("key") == key).select("terms", "tfs").collect()  # one document
    tf = {t: n for r in own for t, n in zip(r["terms"], r["tfs"], strict=True)}
    kept = _similarities_of(index, tf).filter((F.col("key") != key) & (F.col("score") >= min_score))
    best = kept.select("key", "ord", F.round("score", 4).alias("score")).orderBy(F.col("score").desc(), F.col("ord")).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("ord"))))  # at most top_k rows


def similar_batch(index: TextIndex, keys: DataFrame, top_k: int = 3, min_score: float = 0.1) -> DataFrame:
    """(query_id, key, ord, score, rank): `similar` for all documents in keys (key) in one plan; query_id is the document's key."""
    from sieveline.operators import simjoin

    own = by_term(index.rows.join(keys.select("key").distinct(), "key", "left_semi")).select(F.col("key").alias("query_id"), "term", "tf")
    if min_score <= 0:
        return ranked(similarities(index, own).filter("query_id <> key"), top_k, min_score)
    return ranked(simjoin.best_pairs(index, simjoin.query_vectors(index, own), top_k, min_score, itself=False), top_k, min_score)


@dataclass
class SearchOutcome:
    success: bool
    query: str
    hits: DataFrame | None = None
    error: str | None = None

    def to_dict(self) -> dict:
        rows = self.hits.orderBy("rank").collect() if self.hits is not None else []
        return {"success": self.success, "query": self.query, "keys": [r["key"] for r in rows], "relevance_scores": {r["key"]: r["score"] for r in rows}, "total_count": len(rows), "error": self.error}


def run_search(index: TextIndex, text: str, top_k: int = 5, min_score: float = 0.1) -> SearchOutcome:
    spark = index.docs.sparkSession
    if not spark.range(1).select(F.size(tokens(F.lit(text)))).first()[0]:
        return SearchOutcome(True, text, error=NO_TERMS)
    try:
        return SearchOutcome(True, text, search(index, text, top_k, min_score))
    except Exception as e:  # noqa: BLE001  an envelope, as callers expect
        return SearchOutcome(False, text, error=f"Semantic search error: {e}")


def run_similar(index: TextIndex, key: str, top_k: int = 3) -> SearchOutcome:
    if index.docs.filter(F.col("key") == key).isEmpty():
        return SearchOutcome(False, f"similar to {key}", error=f"Issue {key} not found")
    return SearchOutcome(True, f"similar to {key}", similar(index, key, top_k))
