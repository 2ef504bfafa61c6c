"""Saved filters in one plan against each filter alone."""

from datetime import UTC, datetime
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from sieveline.operators import filterlang, filtertable
from sieveline.sources.issues import load_corpus
from tests import data

NOW = datetime(2024, 3, 1, tzinfo=UTC)
TEXTS = [
    "status = 'In Progress'", "STATUS = 'in progress' ORDER BY created DESC", "status != Done", "assignee = 'Ada Moss' OR priority = Critical", "priority IN (Critical, High, low)", "priority NOT IN (Critical)",
    "labels IN (security, login)", "labels NOT IN (security)", "labels = security AND project = OPS", "labels != audit", "components ~ 'data'", "summary ~ LOGIN AND (status = Done OR priority = High)", "assignee IS NULL",
    "assignee IS NOT NULL AND assignee != 'ada moss'", "resolution IS EMPTY", "resolution IS NOT EMPTY", "labels IS EMPTY", "labels IS NOT EMPTY", "labels IS NULL", "labels IS NOT NULL", "created >= 2024-01-10", "created < 2024-01-10 AND project = WEB",
    "created >= -30d", "created >= someday", "nosuchfield = 1", "nosuchfield IN (a, b)", "nosuchfield IS NOT NULL", "labels > 3", "resolution = none", "resolution IN (None)", "", None, "   ", "(project = OPS OR project = WEB) AND (labels = login OR key = 'WEB-1')",
    "key = 'OPS-1' OR key IN ('WEB-2', 'WEB-3') OR status = Nowhere", "issuetype = Bug", "status is what", "(status = Done", "priority > High", "assignee = None", "labels = 'a\"b\\c'", "status = Done AND status = Done", "reporter ~ o OR sprint IS NULL",
    " AND ".join(f"(project = OPS OR labels = l{i} OR priority != p{i})" for i in range(4)) + " AND (status = Done OR project = WEB)",  # too many clauses
]


@pytest.fixture(scope="module")
def issues(spark, tmp_path_factory):
    return load_corpus(spark, data.write(tmp_path_factory.mktemp("w"))[0]).issues.persist()


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("block", [500, 3])
def test_each_filter_as_alone(spark, issues, block):
    saved = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(1000, TEXTS[0])], "filter_id int, text string")
    found = filtertable.match(issues, saved, NOW, block=block)
    got = {i: [] for i in (*range(len(TEXTS)), 1000)}
    for r in found.rows().collect():
        got[r["filter_id"]].append(r["key"])
    totals = {r["filter_id"]: r for r in found.totals("ord").collect()}
    assert totals.keys() == got.keys()
    for i, t in (*enumerate(TEXTS), (1000, TEXTS[0])):
        alone = filterlang.execute(issues, t or "", NOW)
        want = [r["key"] for r in alone.issues.collect()] if alone.success else []
        assert sorted(got[i]) == sorted(want), t
        assert (totals[i]["error"], totals[i]["n"]) == (alone.error, len(want) if alone.success else None), t


def test_no_filters_and_no_tickets(spark, issues):
    none = spark.createDataFrame([], "filter_id int, text string")
    assert filtertable.match(issues, none).rows().count() == filtertable.match(issues, none).totals().count() == 0
    some = spark.createDataFrame([(1, "status = Done"), (2, "")], "filter_id int, text string")
    assert [(r["filter_id"], r["n"]) for r in filtertable.match(issues.limit(0), some).totals().orderBy("filter_id").collect()] == [(1, 0), (2, 0)]


def test_the_plan_does_not_grow_with_filters(spark, issues):
    """Equality atoms are found by a join: a thousand values leave the plan as it is."""
    few, many = (spark.createDataFrame([(i, f"assignee = 'Person {i}' AND status != Done") for i in range(n)], "filter_id int, text string") for n in (2, 1000))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(filtertable.match(issues, many).rows()) < 1.2 * size(filtertable.match(issues, few).rows())


def test_keys():
    key = lambda text: filtertable.keys_of(filtertable.form_of(filterlang.parse(text).where))
    assert key("status = Done AND priority = Low") == [["=\x1fstatus\x1fdone"], ["=\x1fpriority\x1flow"]]
    assert key("status = Done OR priority = Low") == [["=\x1fpriority\x1flow", "=\x1fstatus\x1fdone"]]
    assert key("status != Done OR priority = Low") == key("") == key("labels NOT IN (a)") == []


def test_clauses():
    of = lambda text: filtertable.clauses_of(filtertable.form_of(filterlang.parse(text).where))
    a, b, c = ("=\x1fstatus\x1fdone", "=\x1fpriority\x1flow", "in\x1flabels\x1fx")
    assert of("status = Done AND (priority = Low OR labels != x)") == [({a, b}, set()), ({a}, {c})]
    assert of("status != Done AND status = Done") == [] and of("") == [(set(), set())]
    assert of("labels NOT IN (x, y)") == [(set(), {c, "in\x1flabels\x1fy"})]
    assert of(" AND ".join(f"(status = s{i} OR priority = p{i})" for i in range(9))) is None


def test_texts_share_what_their_common_clauses_match(spark, issues):
    """Pairs grow with the texts and with the classes, not with their product: a clause in a hundred texts has its classes once."""
    saved = spark.createDataFrame([(i, f"status != Nowhere OR key = 'OPS-{i}' OR assignee = 'Person {i}'") for i in range(100)], "filter_id int, text string")
    found = filtertable.match(issues, saved, NOW)
    n = issues.count()
    assert found.base_pairs.count() + found.own_pairs.count() <= n < 100 * n == found.rows().count()
    assert {r["n"] for r in found.totals().collect()} == {n}


def test_rows_of_a_shared_set_come_in_runs(spark, issues):
    """A filter's rows stand together, part by part, so columns written to files repeat: rows that change their filter at each ticket take two bytes each and more."""
    many = issues.crossJoin(spark.range(300).withColumnRenamed("id", "n")).withColumn("key", F.concat("key", F.lit("-"), "n")).drop("n")
    saved = spark.createDataFrame([(i, f"status != Nowhere OR key = 'OPS-1-{i}'") for i in range(50)], "filter_id int, text string")
    found = filtertable.match(many, saved, NOW)
    at = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(at)
    spark.conf.set(at, "-1")  # neither side is small where it matters
    try:
        rows = found.rows().select("filter_id", "key", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set(at, before)
    changes = sum(a["p"] != b["p"] or a["filter_id"] != b["filter_id"] for a, b in pairwise(rows))
    assert len({(r["filter_id"], r["key"]) for r in rows}) == len(rows) == 50 * many.count()
    assert changes < len(rows) / 40
