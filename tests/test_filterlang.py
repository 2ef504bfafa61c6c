import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sieveline.operators import filterlang as fl
from sieveline.sources.issues import assert_unique_keys, load_corpus
from tests import data

NOW = datetime(2025, 3, 3, 10, tzinfo=UTC)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    c = load_corpus(spark, data.write(tmp_path_factory.mktemp("c"))[0])
    c.issues.persist()
    return c


def keys(corpus, text):
    return [r["key"] for r in fl.apply(corpus.issues, text, NOW).select("key").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("project = WEB", "WEB-1 WEB-2 WEB-3 WEB-4"),
        ("project = OPS AND status = 'to do'", "OPS-1 OPS-10"),
        ("status = To Do AND project = WEB", "WEB-2 WEB-4"),
        ("status IN (done)", ""),
        ("status IN ('Done', \"Blocked\")", "OPS-2 OPS-5 WEB-1"),
        ("assignee = none", "OPS-3 WEB-2"),
        ("assignee != 'Ada Moss'", "OPS-2 OPS-3 OPS-4 WEB-1 WEB-2 WEB-4"),
        ("assignee NOT IN ('Ada Moss', None)", "OPS-2 OPS-4 WEB-1 WEB-4"),
        ("assignee IS NULL", "OPS-3 WEB-2"),
        ("assignee IS NOT NULL AND priority = Critical", "OPS-2 WEB-3"),
        ("labels IS NULL", ""),
        ("labels IS EMPTY", "OPS-4"),
        ("labels IS NOT EMPTY AND project = OPS", "OPS-1 OPS-2 OPS-3 OPS-5 OPS-10"),
        ("sprint IS EMPTY", " ".join(i["key"] for i in data.ISSUES)),
        ("labels = security", "OPS-2 WEB-3"),
        ("labels = SECURITY", ""),
        ("labels != security AND project = WEB", "WEB-1 WEB-2 WEB-4"),
        ("labels IN (audit, backup)", "OPS-1 WEB-3"),
        ("labels NOT IN (urgent, security) AND project = OPS", "OPS-3 OPS-4 OPS-5"),
        ("labels ~ SECUR", "OPS-2 WEB-2 WEB-3"),
        ("summary ~ 'login'", "OPS-3 WEB-1"),
        ("nosuchfield = 1", " ".join(i["key"] for i in data.ISSUES)),
        ("priority > High", " ".join(i["key"] for i in data.ISSUES)),
        ("created >= '2025-02-15T00:00:00Z'", "WEB-1 WEB-2 WEB-3 WEB-4"),
        ("created > 2025-02-15", "WEB-2 WEB-3 WEB-4"),
        ("created < 10/01/2025", "OPS-1"),
        ("created >= -2d", "WEB-3 WEB-4"),
        ("created >= -2m", " ".join(i["key"] for i in data.ISSUES)),
        ("", " ".join(i["key"] for i in data.ISSUES)),
        (" AND ", " ".join(i["key"] for i in data.ISSUES)),
        ("issuetype = epic", "WEB-2"),
        ("project = OPS ORDER BY priority", "OPS-2 OPS-1 OPS-5 OPS-3 OPS-4 OPS-10"),
        ("project = OPS order by priority desc, key", "OPS-10 OPS-4 OPS-3 OPS-1 OPS-5 OPS-2"),
        ("project = OPS ORDER BY key", "OPS-1 OPS-10 OPS-2 OPS-3 OPS-4 OPS-5"),
        ("project = WEB ORDER BY created DESC", "WEB-4 WEB-3 WEB-2 WEB-1"),
        ("project = WEB ORDER BY summary DESC", "WEB-1 WEB-2 WEB-3 WEB-4"),
        ("project = OPS OR priority = Critical", "OPS-1 OPS-2 OPS-3 OPS-4 OPS-5 OPS-10 WEB-3"),
        ("(status = Done OR status = Blocked) AND project = OPS", "OPS-2 OPS-5"),
        ("summary ~ 'a AND b'", ""),
    ],
)
def test_queries(corpus, text, expected):
    assert keys(corpus, text) == expected.split()


@pytest.mark.parametrize("text", ["banana", "status IN ()", "(status = Done", "= Done", "status"])
def test_errors_become_outcomes(corpus, text):
    out = fl.execute(corpus.issues, text)
    assert not out.success and out.error.startswith("Unable to parse JQL clause") and out.total_count == 0
    assert out.to_dict()["issues"] == []


def test_outcome_counts_lazily(corpus):
    out = fl.execute(corpus.issues, "priority = Critical")
    assert out.success and out.total_count == 2 and {r["key"] for r in out.to_dict()["issues"]} == {"OPS-2", "WEB-3"}


def test_domain_values(corpus):
    values = lambda f: [r["value"] for r in fl.valid_values(corpus.issues, corpus.domains, f).collect()]
    assert values("status") == data.CORPUS["statuses"] and values("project") == ["OPS", "WEB"]
    assert values("assignee") == ["Ada Moss", "Ben Hale", "Cy Ito"] and values("components") == ["Auth", "Logs", "Portal", "Storage"] and values("sprint") == []


def test_filters_reach_the_scan(spark, sf_dir):
    from sieveline.sources import tables

    plan = fl.apply(tables.order_issues(spark, sf_dir, False), "created >= 1999-01-01", ordered=False).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "o_totalprice" not in plan


def test_unique_keys(corpus, spark):
    assert_unique_keys(corpus.issues)
    with pytest.raises(ValueError, match="OPS-1"):
        assert_unique_keys(corpus.issues.union(corpus.issues.filter("key = 'OPS-1'")))


def _python_row(i, node):
    """An independent reading of the rules for one ticket."""
    if isinstance(node, fl.And):
        return all(_python_row(i, p) for p in node.parts)
    if isinstance(node, fl.Or):
        return any(_python_row(i, p) for p in node.parts)
    field = {"issuetype": "type"}.get(node.field, node.field)
    v = i["key"].split("-")[0] if field == "project" else i.get(field)
    if field == "assignee":
        v = v and v["displayName"]
    arr = isinstance(v, list)
    match node:
        case fl.IsNull():
            return (v is None) != node.negated
        case fl.IsEmpty():
            return (v in (None, "", [])) != node.negated
        case fl.In():
            return (any(x in node.values for x in v) if arr else str(v) in node.values) != node.negated
        case fl.Contains():
            return any(node.value.lower() in x.lower() for x in v) if arr else node.value.lower() in (v or "").lower()
        case fl.Compare(op="="):
            return node.value in v if arr else str(v).lower() == node.value.lower()
        case fl.Compare(op="!="):
            return node.value not in v if arr else str(v).lower() != node.value.lower()
    return True


def _random_text(rng, depth=2):
    if depth and rng.random() < 0.6:
        word = rng.choice([" AND ", " OR "])
        return "(" + word.join(_random_text(rng, depth - 1) for _ in range(rng.randint(2, 3))) + ")"
    field = rng.choice(["project", "status", "priority", "type", "assignee", "labels", "components", "summary"])
    value = rng.choice(["OPS", "done", "To Do", "Critical", "security", "Auth", "Ada Moss", "none", "login"])
    return rng.choice([f"{field} = '{value}'", f"{field} != {value}", f"{field} IN ({value}, Bug)", f"{field} NOT IN ('{value}')", f"{field} ~ {value}", f"{field} IS NULL", f"{field} IS NOT EMPTY"])


def test_random_trees_against_rows(corpus):
    rng = random.Random(4)
    texts = [_random_text(rng) for _ in range(60)]
    flags = corpus.issues.select("key", *[fl.compile_tree(fl.parse(t).where).alias(f"q{k}") for k, t in enumerate(texts)]).collect()
    for row, i in zip(flags, data.ISSUES, strict=True):
        for k, t in enumerate(texts):
            assert row[f"q{k}"] == _python_row(i, fl.parse(t).where), (t, i["key"])


def test_stream_has_the_same_rows(spark, corpus, tmp_path):
    from sieveline.streaming.filters import filter_stream

    corpus.issues.write.parquet(str(tmp_path / "in"))
    stream = filter_stream(spark.readStream.schema(corpus.issues.schema).parquet(str(tmp_path / "in")), "labels = security")
    q = stream.select("key").writeStream.format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert {r["key"] for r in spark.table("kept").collect()} == {"OPS-2", "WEB-3"}
    with pytest.raises(fl.FilterSyntaxError):
        filter_stream(corpus.issues, "labels = security ORDER BY key")


def test_numbered_is_a_total_order(spark):
    from sieveline.functions.ranking import numbered

    got = numbered(spark.range(1000).withColumn("k", F.col("id") % 7), [F.col("k").desc(), F.col("id")], "pos", 0).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1000))
    assert [(r["k"], r["id"]) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert numbered(spark.range(0), [F.col("id")]).count() == 0
