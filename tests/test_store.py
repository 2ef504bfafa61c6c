"""The clustered store: the same rows as the filter alone, and what scans leave out."""

from datetime import UTC, datetime

import pytest

from sieveline.operators import filterlang
from sieveline.queries import FILTERS, NOW, RELATIVE
from sieveline.sources import store, tables
from sieveline.sources.issues import normalise

MORE = {
    "lower_case": "project = asia AND issuetype = bug", "half": "created >= 1998-01-01 OR summary ~ furn", "unknown": "project = MARS", "none": "resolution IS NULL AND assignee IS NULL", "not": "status != Done AND created < 1993-01-01",
    "in": "project IN (ASIA, EUROPE) AND created > 1998-06-01",
}


@pytest.fixture(scope="module")
def world(spark, sf_dir, tmp_path_factory):
    issues = tables.order_issues(spark, sf_dir)
    return issues, store.write(issues, str(tmp_path_factory.mktemp("store") / "t"), files=8)


def scan(df):
    """(rows that the scan gave, its description) of the final plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    (leaf,) = (leaves.apply(0) for leaves in [plan.collectLeaves()])
    return leaf.metrics().apply("numOutputRows").value(), leaf.verboseStringWithOperatorId()


@pytest.mark.parametrize("text", [*FILTERS.values(), *RELATIVE.values(), *MORE.values()])
@pytest.mark.filterwarnings("ignore::UserWarning")
def test_same_rows(world, text):
    issues, stored = world
    ids = lambda df: sorted(r["ord"] for r in df.select("ord").collect())
    assert ids(store.apply(stored, text, NOW)) == ids(filterlang.apply(issues, text, NOW))
    assert store.apply(stored, text, NOW).columns == issues.columns


@pytest.mark.parametrize(("text", "pushed"), [
    ("created >= '2000-12-15T00:00:00Z'", "GreaterThanOrEqual(_created,"), ("created < 1995-04-01", "LessThan(_created,"), ("created >= -30d", "GreaterThanOrEqual(_created,"),
    ("project = ASIA AND created >= 2001-03-15", "EqualTo(_project,asia)"), ("created >= 2001-05-15 OR created < 1995-02-01", "Or("),
])
def test_scans_leave_out_what_statistics_rule_out(world, text, pushed):
    """Of eight files only those that hold kept rows are read, and at most one more at each end of a span of time."""
    _, stored = world
    now = datetime(2001, 6, 1, tzinfo=UTC)
    kept = store.apply(stored, text, now, ordered=False).select("ord")
    n, told = scan(kept)
    spans = 2 if " OR " in text else 1
    of_time = kept.count() if "project" not in text else store.apply(stored, text.split(" AND ")[1], now).count()
    total = stored.count()
    assert pushed in told and n <= of_time + spans * 2 * total / 8 and n < 0.6 * total, (n, of_time, told)
    # the filter alone reads every row
    assert scan(filterlang.apply(stored, text, now, ordered=False).select("ord"))[0] == total


def test_odd_rows(spark, tmp_path):
    """Null and unreadable dates, null keys and values, repeated rows, an empty table."""
    rows = spark.createDataFrame(
        [(1, "AB-1", "Done", "2024-01-01T00:00:00Z"), (1, "AB-1", "Done", "2024-01-01T00:00:00Z"), (2, None, None, None), (3, "", "none", "someday"), (4, "XY-9", "", "1960-05-05")], "ord long, key string, status string, created string"
    )
    issues = normalise(rows)
    for k, df in enumerate((issues, issues.filter("false"))):
        stored = store.write(df, str(tmp_path / str(k)))
        for text in ("status IS NULL", "status = none", "created < 2025-01-01", "created >= 1960-05-05", "project = AB", "project IS NULL", "status IN (None, Done)", ""):
            ids = lambda x: sorted(r["ord"] for r in x.select("ord").collect())
            assert ids(store.apply(stored, text)) == ids(filterlang.apply(df, text)), text


def test_restriction_says_nothing_of_what_it_cannot_know():
    for text in ("", "summary ~ x", "labels = a", "status != Done", "status NOT IN (Done)", "created >= someday", "status = Done OR labels = a", "nosuchfield = 1"):
        assert store.restriction(filterlang.parse(text).where) is None, text


def test_tickets_travel_as_narrow_as_their_tables(spark, sf_dir, monkeypatch):
    """What a ticket's fields are made of is dealt out, not its texts, comments and folded values; labels and components stand in a table of their own."""
    from sieveline import queries_store
    from sieveline.functions import storage

    made, written = [], storage.written
    monkeypatch.setattr(storage, "written", lambda df, *a, **k: made.append(df) or written(df, *a, **k))
    monkeypatch.setattr(queries_store, "_WRITTEN", {})
    whole = queries_store.stored(spark, sf_dir)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in made]
    dealt = [p.split("RepartitionByExpression")[1].split("\n", 1)[1] for p in plans if "date_trunc" in p]
    assert len(dealt) == 1 and not any(x in dealt[0] for x in ("Please hurry", "Order for", "_status", "labels")), dealt
    issues = tables.order_issues(spark, sf_dir)
    rows = lambda df: sorted(map(repr, df.select(issues.columns).collect()))
    assert rows(whole) == rows(issues)
    assert whole.filter("size(labels) = 0").count() > 0 < whole.filter("size(components) > 0").count()
