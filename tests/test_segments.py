"""The index that takes changes: after any of them it scores as one built at once, and old segments stay as they are."""

import pytest

from sieveline.functions.storage import version as files
from sieveline.operators import segments, textindex

WORDS = "disk full login error page slow database index trade report".split()


def text(seed: int) -> str:
    return " ".join(WORDS[(seed * k + k * k) % 10] for k in range(1, 4 + seed % 9))


def rows(spark, docs):
    return spark.createDataFrame([(o, k, t) for k, (o, t) in docs.items()], "ord long, key string, text string")


def same_as_a_build(spark, index, docs):
    whole, now = textindex.build(rows(spark, docs)), index.open()
    got = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=repr)
    assert got(now.counts, "key", "ord", "term", "tf") == got(whole.counts, "key", "ord", "term", "tf")
    assert got(now.postings, "key", "ord", "term", "tf") == got(whole.counts, "key", "ord", "term", "tf")
    assert got(now.docs, "ord", "key") == got(whole.docs, "ord", "key")
    assert [(t, n, pytest.approx(i)) for t, n, i in got(whole.idf, "term", "df", "idf")] == got(now.idf, "term", "df", "idf")
    for query in ("disk login slow", "trade"):
        assert got(textindex.search(now, query, 5, 0.05), "key", "score", "rank") == got(textindex.search(whole, query, 5, 0.05), "key", "score", "rank")


def test_changes(spark, tmp_path, monkeypatch):
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    docs = {f"K-{i}": (i, text(i)) for i in range(40)}
    index.apply(rows(spark, docs))
    same_as_a_build(spark, index, docs)
    first = index.version().segments[0]
    before = {t: files(spark, f"{index.path}/segments/{first}/{t}") for t in segments.SCHEMAS}

    changes = {f"K-{i}": (i, text(i + 3)) for i in (2, 5, 39)} | {f"N-{i}": (100 + i, text(i)) for i in range(5)} | {"N-9": (109, None)}
    index.apply(rows(spark, changes), spark.createDataFrame([("K-7",), ("K-8",), ("none",), (None,)], "key string"))
    docs = {k: x for k, x in (docs | changes).items() if k not in ("K-7", "K-8")}
    same_as_a_build(spark, index, docs)

    monkeypatch.setattr(segments, "FILTER_KEYS", 0)  # by a join
    again = {"K-7": (7, "disk again"), "K-2": (2, "login login"), "N-1": (101, "")}
    index.apply(rows(spark, again), spark.createDataFrame([("K-5",), ("N-2",)], "key string"))
    docs = {k: x for k, x in (docs | again).items() if k not in ("K-5", "N-2")}
    same_as_a_build(spark, index, docs)
    assert len(index.open(2).docs.collect()) == 44  # an older version is still there

    index.merge(1)  # the large first segment stays
    assert index.version().segments[0] == first and len(index.version().segments) == 2
    same_as_a_build(spark, index, docs)
    assert before == {t: files(spark, f"{index.path}/segments/{first}/{t}") for t in segments.SCHEMAS}
    index.apply(deletes=spark.createDataFrame([("K-2",)], "key string"))
    docs.pop("K-2")
    same_as_a_build(spark, index, docs)
    index.merge()
    same_as_a_build(spark, index, docs)
    assert index.vacuum() > 0 and index.versions() == [index.version().number]
    same_as_a_build(spark, index, docs)


def test_two_writers(spark, tmp_path, monkeypatch):
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    index.apply(rows(spark, {"A-1": (1, "disk")}))
    old = index.version()
    index.apply(rows(spark, {"A-2": (2, "full")}))
    monkeypatch.setattr(index, "version", lambda number=None: old)
    with pytest.raises(RuntimeError, match="another writer"):
        index.apply(rows(spark, {"A-3": (3, "slow")}))
    monkeypatch.undo()
    assert sorted(r["key"] for r in index.open().docs.collect()) == ["A-1", "A-2"]


def test_empty(spark, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    assert textindex.search(index.open(), "disk").count() == 0
    index.apply()
    assert index.version().documents == 0 and textindex.search(index.open(), "disk").count() == 0
