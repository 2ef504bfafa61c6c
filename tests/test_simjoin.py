"""The pruned join against all pairs scored one by one."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveline.operators import simjoin, textindex


def plain(docs: dict[str, str], queries: dict[str, str], top_k: int, least: float, itself: bool) -> dict[str, list[tuple[str, float]]]:
    stops = set(textindex.STOPWORDS)
    tf = lambda t: Counter(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split() if len(w) > 1 and w not in stops)
    counts = {k: tf(t) for k, t in docs.items()}
    df = Counter(w for c in counts.values() for w in c)
    vector = lambda c: {w: n * math.log(len(docs) / df[w]) for w, n in c.items() if df[w]}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors, out = {k: vector(c) for k, c in counts.items()}, {}
    for q, t in queries.items():
        a, found = vector(tf(t)), []
        for at, (k, b) in enumerate(vectors.items()):
            if norm(a) and norm(b) and (itself or k != q):
                s = sum(x * b[w] for w, x in a.items() if w in b) / norm(a) / norm(b)
                if s >= least:
                    found.append((-round(s, 4), at, k))
        if found:
            out[q] = [(k, -s) for s, _, k in sorted(found)[:top_k]]
    return out


@pytest.fixture(scope="module")
def texts():
    """Common and rare words, near copies, equal texts, empty ones and null."""
    r = random.Random(5)
    word = lambda: f"w{min(int(r.paretovariate(0.6)), 400)}"
    out = {f"D-{i}": " ".join(word() for _ in range(r.choice([1, 3, 12, 60]))) for i in range(160)}
    out |= {f"E-{i}": out[f"D-{i}"] + f" extra{i}" for i in range(0, 40)} | {f"F-{i}": out["D-7"] for i in range(12)} | {"G-1": "", "G-2": "the of", "G-3": "w1 w1 w1"}
    return out


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    rows = [(i, k, t or None) for i, (k, t) in enumerate(texts.items())]
    return textindex.store(spark.createDataFrame(rows, "ord long, key string, text string"), str(tmp_path_factory.mktemp("index")))


def collected(df) -> dict[str, list[tuple[str, float]]]:
    out: dict[str, list] = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["key"], r["score"]))
    return out


@pytest.mark.parametrize(("top_k", "least"), [(3, 0.1), (10, 0.35), (1, 0.9)])
def test_similar_documents(spark, texts, index, top_k, least):
    keys = spark.createDataFrame([(k,) for k in list(texts)[::3]], "key string")
    want = plain(texts, {k: texts[k] for k in list(texts)[::3]}, top_k, least, itself=False)
    assert collected(textindex.similar_batch(index, keys, top_k, least)) == want


def test_questions(spark, texts, index):
    asked = {"a": "w1 w2 w3", "b": "w17 nowhere extra5", "c": texts["D-20"], "d": "", "e": "nowhere", "f": "w2 " * 50}
    rows = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    assert collected(textindex.search_batch(index, rows, 5, 0.1)) == plain(texts, asked, 5, 0.1, itself=True)


def test_bounds_leave_postings_out(index):
    """At a threshold near one, common words meet nothing and few pairs are scored."""
    q = simjoin.query_vectors(index, index.counts.select(F.col("key").alias("query_id"), "term", "tf"))
    d = simjoin.document_vectors(index)
    rows = simjoin.met(q, d, simjoin.thresholds(q, d, 3, 0.9, False), False)
    every = q.join(d, "term").filter("query_id <> key").count()
    n, pairs = rows.count(), simjoin.candidates(rows).count()
    assert pairs <= n < every / 4


def test_empty_index(spark, tmp_path):
    none = textindex.store(spark.createDataFrame([], "ord long, key string, text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([("a", "w1")], "query_id string, text string")
    assert textindex.search_batch(none, asked).count() == 0


@pytest.mark.parametrize("dense", [0, 5])
def test_blocks(spark, texts, index, monkeypatch, dense):
    """Many blocks of queries and small chunks of documents give all pairs' best; postings are not exchanged."""
    for name, value in (("BLOCK_TERMS", 600), ("CELLS", 300), ("DENSE", dense)):
        monkeypatch.setattr(simjoin, name, value)
    keys = list(texts)[::5]
    rows = spark.createDataFrame([(k,) for k in keys], "key string")
    assert collected(textindex.similar_batch(index, rows, 4, 0.2)) == plain(texts, {k: texts[k] for k in keys}, 4, 0.2, itself=False)


def test_low_thresholds_join_no_postings(index, monkeypatch):
    monkeypatch.setattr(simjoin, "document_vectors", lambda *_: pytest.fail("postings are joined"))
    q = simjoin.query_vectors(index, index.counts.filter("key = 'D-3'").select(F.col("key").alias("query_id"), "term", "tf"))
    assert simjoin.best_pairs(index, q, 3, 0.1).count() > 0


def test_batches_write_no_postings(spark, sf_dir, monkeypatch):
    from sieveline import queries

    monkeypatch.setattr(queries, "_STORED", {})
    monkeypatch.setattr(textindex, "sorted_blocks", lambda *_: pytest.fail("postings are written"))
    assert queries.txt_search_batch(spark, sf_dir).columns == ["query_id", "key", "score", "rank"]
