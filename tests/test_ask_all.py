"""Questions in one plan against the same questions one by one."""

import pytest
from pyspark.sql import functions as F

from sieveline import queries_results
from sieveline.functions import storage
from sieveline.operators import textindex
from sieveline.plans import assistant, batch, router
from sieveline.sources import results
from sieveline.sources.issues import Corpus, load_corpus, load_profiles
from tests import data

QUESTIONS = [
    "Show all critical priority issues", "How many done bugs are there?", "issues related to performance problems", "critical issues about login in OPS", "what are tickets like disk full?", "hi", "", None, "Unassigned issues in WEB",
    "label security", "find issues assigned to Ada Moss about disk", "show done issues in OPS and WEB", "count of things", "the of a", "show done tickets about the login page", "in progress tasks about slow pages", "high bugs",
]
USERS = ("boss", "ops", "portal", "guest", "who", None)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    a, b = data.write(tmp_path_factory.mktemp("w"))
    corpus, profiles = load_corpus(spark, a), load_profiles(spark, b)
    # some summaries name another status than the ticket's, so that answers which show them fail their check
    told = F.when(F.col("key").isin("OPS-2", "WEB-2"), F.concat("summary", F.lit(" Blocked"))).otherwise(F.col("summary"))
    corpus = Corpus(corpus.issues.withColumn("summary", told).persist(), corpus.domains)
    domains = router.Domains(("OPS", "WEB"), corpus.domains.statuses, corpus.domains.priorities, corpus.domains.types)
    return assistant.Assistant(corpus, profiles, domains), corpus, profiles, domains


def test_each_question_as_alone(spark, world):
    a, corpus, profiles, domains = world
    asked = [(len(USERS) * i + j, q, u) for i, q in enumerate(QUESTIONS) for j, u in enumerate(USERS) if j == i % len(USERS) or (i == 0 and j < 3)]
    df = spark.createDataFrame(asked, "question_id long, query string, user_id string")
    got = {r["question_id"]: r for r in batch.ask_all(corpus, a.index, profiles, df, domains).collect()}
    assert sorted(got) == sorted(i for i, *_ in asked)
    modes, passed = set(), set()
    for i, q, u in asked:
        want, r = a.ask(q or "", u), got[i]
        modes.add(want.query_mode)
        passed.add(want.validation_passed)
        assert (r["success"], r["query_mode"], r["jql_used"], r["semantic_query"], r["total_count"]) == (want.success, want.query_mode, want.jql_used, want.semantic_query, want.total_count), (q, u)
        assert (r["answer"], r["validation_passed"], r["warnings"], r["errors"]) == (want.answer, want.validation_passed, want.warnings, want.errors), (q, u)
        assert sorted(r["validation_errors"]) == sorted(want.debug_info.get("validation", {}).get("errors", []))
    assert modes == {"jql", "semantic", "hybrid", "clarification"} and passed == {True, False}


def test_no_questions_and_no_tickets(spark, world):
    a, corpus, profiles, domains = world
    none = spark.createDataFrame([], "question_id long, query string, user_id string")
    assert batch.ask_all(corpus, a.index, profiles, none, domains).count() == 0
    empty = Corpus(corpus.issues.limit(0), corpus.domains)
    index = textindex.build(textindex.document_text(empty.issues))
    some = spark.createDataFrame([(1, "Show done issues", "boss"), (2, "tickets about disks", "boss")], "question_id long, query string, user_id string")
    assert [(r["question_id"], r["total_count"], r["answer"]) for r in batch.ask_all(empty, index, profiles, some, domains).orderBy("question_id").collect()] == [(1, 0, batch.grounding.NO_RESULT_TEXT), (2, 0, batch.grounding.NO_RESULT_TEXT)]


def test_a_text_stands_once_a_case(spark, world):
    """Forty askers of one question share the one text that is written, however long its list is."""
    a, corpus, profiles, domains = world
    df = spark.createDataFrame([(i, QUESTIONS[0], "boss") for i in range(40)], "question_id long, query string, user_id string")
    got = batch.ask_all(corpus, a.index, profiles, df, domains)
    texts = {f.rsplit("/", 1)[0] for f in got.inputFiles() if "questions-checked" in f}
    assert len(texts) == 1 and spark.read.parquet(*texts).count() == 1
    assert got.count() == 40 and got.select("answer").distinct().count() == 1


def test_askers_of_a_long_text_do_not_repeat_it_in_files(spark, tmp_path):
    """Three megabytes asked for by 400 are written once a file, and no task holds a hundred of them at once."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.sha2(i.cast("string"), 256))), "\n").substr(1, 3_000_000)
    storage.expect_long_values(spark)
    texts = storage.written(spark.range(1).select(F.lit("a").alias("answer_id"), text.alias("text"), F.array().cast("array<string>").alias("validation_errors")), str(tmp_path / "texts"))
    none = F.array().cast("array<string>")
    columns = {"answer_id": F.lit("a"), "success": F.lit(True), "query_mode": F.lit("jql"), "jql_used": F.lit(""), "semantic_query": F.lit(""), "total_count": F.lit(1), "fixed": F.lit(None).cast("string"), "warnings": none, "errors": none}
    rows = batch.Said(spark.range(400).withColumnRenamed("id", "question_id").withColumns(columns), texts).rows()
    rows.write.parquet(str(tmp_path / "rows"))
    assert rows.select("answer").distinct().count() == 1 and rows.filter(F.length("answer") == 3_000_000).count() == 400
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < 60_000_000  # 1.2 GB of texts, which compress little


def test_a_written_answer_names_its_text(spark, sf_dir, monkeypatch):
    """Documents in the sink: one a question without the text of its case, and one a case."""
    sunk = []
    monkeypatch.setattr(queries_results.results, "write_results", lambda rows, path, write=results.write_results: sunk.append(rows.columns) or write(rows, path))
    got = queries_results.snk_answers(spark, sf_dir)
    assert ["text" in c for c in sunk] == [False, True]
    assert got.count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
