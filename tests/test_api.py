import pytest

from sieveline import api
from tests import data


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    a, b = data.write(tmp_path_factory.mktemp("api"))
    spark.conf.set("sieveline.corpus", a)
    spark.conf.set("sieveline.profiles", b)
    yield a, b
    spark.conf.unset("sieveline.corpus")
    spark.conf.unset("sieveline.profiles")


def test_paths_are_needed(spark):
    with pytest.raises(ValueError, match="sieveline.corpus"):
        api.corpus_of(spark)


def test_one_call_each(spark, files):
    assert api.execute_jql(spark, "priority = Critical").total_count == 2
    assert api.semantic_search(spark, "database backup", 1).to_dict()["keys"] == ["OPS-1"]
    assert api.find_similar(spark, "OPS-3", 1).success
    assert api.classify_query("hi").to_dict()["mode"] == "clarification_needed"
    assert api.process_query(spark, "Unassigned issues", "boss").to_dict()["total_count"] == 2


def test_validation_and_grounding(spark, files):
    ops = api.corpus_of(spark).issues.filter("key like 'OPS%'")
    v = api.validate_response(spark, "OPS-2 is Blocked. See FAKE-1 and WEB-1. There are 9 issues.", ops)
    assert not v.valid and v.hallucinated_keys == ["FAKE-1"] and len(v.warnings) == 1
    assert v.hallucinated_values == {"statuses": [{"key": "OPS-2", "claimed": "Blocked", "actual": "Done"}], "counts": [{"claimed": "9", "actual": "6"}] * 2}
    assert v.to_dict()["validated_response"] is None
    assert not api.validate_response(spark, "WEB-1 waits.", ops, strict=True).valid and api.validate_response(spark, "WEB-1 waits.", ops).valid
    g = api.create_grounded_response(ops, "count")
    assert g.text == "Found 6 issue(s) matching your query." and g.citations["count"][:2] == ["OPS-1", "OPS-2"]
    assert api.create_grounded_response(ops.filter("false"), "list").text == "No issues found matching your query."


def test_access_outcome(spark, files):
    a = api.filter_for_user(spark, api.corpus_of(spark).issues, "ops")
    d = a.to_dict()
    assert (d["total_before_filter"], d["allowed_count"], d["filter_reasons"]["OPS-2"]) == (10, 5, "restricted_labels:security") and a.allowed.count() == 5
