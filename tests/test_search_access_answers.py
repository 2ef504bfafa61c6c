import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveline.functions.columns import STOPWORDS
from sieveline.operators import access, grounding, textindex
from sieveline.plans import assistant, router
from sieveline.sources.issues import load_corpus, load_profiles
from tests import data


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    a, b = data.write(tmp_path_factory.mktemp("w"))
    corpus, profiles = load_corpus(spark, a), load_profiles(spark, b)
    domains = router.Domains(("OPS", "WEB"), corpus.domains.statuses, corpus.domains.priorities, corpus.domains.types)
    return corpus, profiles, assistant.Assistant(corpus, profiles, domains)


# ---- search


def _tokens(text):
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOPWORDS and len(t) > 1]


def _scores(docs: dict[str, str], query: str) -> dict[str, float]:
    counts = {k: Counter(_tokens(t)) for k, t in docs.items()}
    idf = {t: math.log(len(docs) / sum(t in c for c in counts.values())) for c in counts.values() for t in c}
    weigh = lambda c: {t: n * idf.get(t, 0) for t, n in c.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    q = weigh(Counter(_tokens(query)))
    out = {}
    for k, c in counts.items():
        w = weigh(c)
        out[k] = sum(w[t] * q.get(t, 0) for t in w) / (norm(w) * norm(q)) if norm(w) and norm(q) else 0.0
    return out


def test_search_equals_brute_force(spark, world):
    corpus, _, a = world
    docs = {r["key"]: r["text"] for r in textindex.document_text(corpus.issues).collect()}
    order = [i["key"] for i in data.ISSUES]
    for query in ("database login performance", "disk full", "Ada Moss", "zzz"):
        want = [(k, round(s, 4)) for k, s in _scores(docs, query).items() if s >= 0.05]
        want.sort(key=lambda x: (-x[1], order.index(x[0])))
        got = textindex.search(a.index, query, 4, 0.05).orderBy("rank").collect()
        assert [(r["key"], pytest.approx(r["score"], abs=2e-4)) for r in got] == want[:4]
    batch = textindex.search_batch(a.index, spark.createDataFrame([(1, "disk full"), (2, "login")], "query_id int, text string"), 2, 0.0).collect()
    assert sorted(Counter(r["query_id"] for r in batch).items()) == [(1, 2), (2, 2)]
    assert [r["rank"] for r in textindex.search(a.index, "zzz", 3, 0.0).collect()] == [1, 2, 3]  # zero scores count at no threshold


def test_a_stored_index_gives_the_same(spark, world, tmp_path, monkeypatch):
    corpus, profiles, a = world
    index = textindex.store(textindex.document_text(corpus.issues), str(tmp_path / "index"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for query in ("database login performance", "disk disk full", "zzz", ""):
        want = rows(textindex.search(a.index, query, 4, 0.05))
        assert rows(textindex.search(index, query, 4, 0.05)) == want
        with monkeypatch.context() as m:
            m.setattr(textindex, "FILTER_TERMS", 1)
            assert rows(textindex.search(index, query, 4, 0.05)) == want
    assert rows(textindex.similar(index, "OPS-3", 2)) == rows(textindex.similar(a.index, "OPS-3", 2))
    plan = index.postings.filter("term = 'disk'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,disk)]" in plan
    b = assistant.Assistant(corpus, profiles, a.route_domains, index=index)
    assert b.ask("bugs related to login", "boss").to_dict() == a.ask("bugs related to login", "boss").to_dict()


def test_terms_are_counted_in_their_row(spark):
    rows = [(0, "A-1", "disk full disk the x"), (1, "A-2", None), (2, "A-3", ""), (3, "A-4", "the of"), (4, "A-5", "zz yy zz " * 500)]
    got = {(r["key"], r["term"]): r["tf"] for r in textindex.term_counts(spark.createDataFrame(rows, "ord long, key string, text string")).collect()}
    assert got == {("A-1", "disk"): 2, ("A-1", "full"): 1, ("A-5", "zz"): 1000, ("A-5", "yy"): 500}


def test_similar_leaves_itself_out(world):
    _, _, a = world
    out = textindex.run_similar(a.index, "OPS-3", 2)
    got = out.to_dict()["keys"]
    assert out.success and "OPS-3" not in got and got[0] in ("WEB-4", "WEB-1")
    assert not textindex.run_similar(a.index, "OPS-99").success
    assert textindex.run_search(a.index, "the of a").error == textindex.NO_TERMS


# ---- access


def test_reasons(world):
    corpus, profiles, _ = world
    reasons = lambda u: {r["key"]: r["deny_reason"] for r in access.for_user(corpus.issues, u, profiles).collect()}
    assert set(reasons("boss").values()) == {None}
    ops = reasons("ops")
    assert ops["OPS-2"] == "restricted_labels:security" and ops["WEB-1"] == "no_project_access:WEB" and ops["OPS-4"] is None
    portal = reasons("portal")
    assert portal["WEB-4"] == "no_component_access" and portal["WEB-3"] == "restricted_labels:audit" and portal["WEB-1"] is None
    guest = reasons("guest")
    assert guest["OPS-1"] == "all_labels_restricted" and guest["OPS-4"] is None
    assert set(reasons("who").values()) == {"unknown_user"}


def test_redaction_and_lookups(world):
    corpus, profiles, _ = world
    rows = access.redacted(access.for_user(corpus.issues, "guest", profiles)).collect()
    assert [(r["key"], r["comments"], r["_comments_redacted"]) for r in rows] == [("OPS-4", [], True)]
    assert access.check_access(corpus.issues.filter("key = 'OPS-2'"), "ops", profiles) == (False, "restricted_labels:security")
    assert access.user_permissions(profiles, "who") == {"exists": False, "user_id": "who", "access_level": "none"}
    assert access.user_permissions(profiles, "boss")["can_view_comments"] is True
    total = {r["user_id"]: r for r in access.classify(corpus.issues, profiles, profiles).summary().collect()}
    assert total["boss"]["allowed"] == 10 and total["portal"]["filtered_count"] == 8


@pytest.mark.parametrize("named", [access.NAMED, 1, 0])
def test_classes_decide_as_rows_do(spark, world, named):
    """Every pair as for one user alone: users with equal rights, without a profile, asked for twice; labels that no profile names."""
    corpus, profiles, _ = world
    twin = profiles.filter("user_id = 'portal'").withColumn("user_id", F.lit("twin"))
    profiles = profiles.union(twin)
    users = profiles.select("user_id").union(spark.createDataFrame([("who",), ("who",), ("boss",)], "user_id string"))
    asked = sorted({r["user_id"] for r in users.collect()})
    found = access.classify(corpus.issues, users, profiles, named)
    rows = lambda df, u=None: sorted((u or r["user_id"], r["key"], r["deny_reason"] or "") for r in df.collect())
    want = [x for u in asked for x in rows(access.for_user(corpus.issues, u, profiles), u)]
    assert rows(found.decided()) == rows(found.decided("key")) == sorted(want) and len(want) == 10 * len(asked)
    denied = Counter((u, why) for u, _, why in want if why)
    assert {(r["user_id"], r["deny_reason"]): r["n"] for r in found.reasons().collect()} == denied
    for r in found.summary().collect():
        mine = [why for u, _, why in want if u == r["user_id"]]
        assert (r["total_before_filter"], r["allowed"], r["filtered_count"]) == (10, mine.count(""), 10 - mine.count(""))
    assert access.classify(corpus.issues.limit(0), users, profiles, named).decided().count() == 0


# ---- router

QUESTIONS = [
    "status = 'In Progress' AND project = FIN", "issues related to performance problems", "project = NONEXISTENT", "Show all critical priority issues", "Critical bugs related to trading",
    "Security issues assigned to Sarah", "performance slow database", "Unassigned issues in SEC", "hi", "How many done bugs are there?", "How many things", "What are tickets like outages?",
    "label: urgent tickets about login page", "labels is urgent problems with login", "", "debug the history", "list abandoned epics", "show TO DO in FIN and SEC", "find issues assigned to Bob Ray about x",
]


@pytest.mark.parametrize(
    ("question", "mode", "jql"),
    [
        (QUESTIONS[0], "jql", "project = FIN AND status = 'In Progress'"), (QUESTIONS[1], "semantic", None), (QUESTIONS[2], "semantic", None), (QUESTIONS[3], "jql", "priority = Critical"),
        (QUESTIONS[4], "hybrid", "priority = Critical AND type = Bug"), (QUESTIONS[5], "jql", "assignee = 'Sarah'"), (QUESTIONS[6], "jql", "priority = Low"),
        (QUESTIONS[7], "jql", "project = SEC AND assignee IS NULL"), (QUESTIONS[8], "clarification_needed", None),
    ],
)
def test_routes(question, mode, jql):
    r = router.classify(question)
    assert (r.mode.value, r.jql_query) == (mode, jql)


def test_routes_of_a_column_are_the_same(spark):
    got = router.route(spark.createDataFrame([(q,) for q in QUESTIONS], "query string")).collect()
    for row in got:
        r = router.classify(row["query"])
        assert (row["mode"], row["confidence"], row["jql_query"], row["semantic_query"]) == (r.mode.value, r.confidence, r.jql_query, r.semantic_query), row["query"]


# ---- answers


def _check(spark, world, text, where):
    corpus, _, _ = world
    from pyspark.sql import functions as F

    rows = corpus.issues.filter(where).select(F.lit(0).alias("answer_id"), F.col("ord").alias("pos"), "key", "summary", "status", "priority", F.col("assignee.displayName").alias("assignee"), "labels")
    answers = spark.createDataFrame([(0, text)], "answer_id int, text string")
    found = grounding.errors(answers, rows, corpus.issues.select("key"), corpus.domains.statuses, corpus.domains.priorities)
    warned = grounding.unretrieved_keys(answers, corpus.issues.select("key"), rows).count()
    return grounding.verdicts(answers, found).first(), warned


@pytest.mark.parametrize(
    ("text", "where", "valid", "warnings", "part"),
    [
        ("The issue FAKE-999 is critical.", "key like 'OPS%'", False, 0, "FAKE-999"),
        ("There are 6 issues in OPS.", "key like 'OPS%'", True, 0, None),
        ("There are 16 issues in OPS.", "key like 'OPS%'", False, 0, "claims 16"),
        ("OPS-2 is In Progress.", "key like 'OPS%'", False, 0, "Status mismatch for OPS-2"),
        ("OPS-2 is\nIn Progress.", "key like 'OPS%'", True, 0, None),
        ("ops-2 is In Progress.", "key like 'OPS%'", True, 0, None),
        ("OPS-1 has Low priority", "key like 'OPS%'", False, 0, "Priority mismatch"),
        ("OPS-3 is assigned to John Fake.", "key like 'OPS%'", False, 0, "unassigned"),
        ("OPS-1 is assigned to ada.", "key like 'OPS%'", True, 0, None),
        ("WEB-3 needs work.", "key like 'OPS%'", True, 1, None),
        ("OPS-10 is Done. OPS-1 waits.", "key in ('OPS-1')", False, 1, "Status mismatch for OPS-1"),
        ("Found 99999999999999999999999 issues.", "key like 'OPS%'", False, 0, "99999999999999999999999"),
    ],
)
def test_claims(spark, world, text, where, valid, warnings, part):
    v, warned = _check(spark, world, text, where)
    assert (v["valid"], warned) == (valid, warnings)
    assert (v["validated_text"] == text) == valid
    assert part is None or any(part in m for m in v["messages"])


def test_claims_are_read_behind_the_join_with_counts(spark):
    """Whole texts are exchanged; repeated answers, leading zeros, claims that hit twice, null texts and answers without rows."""
    text = "Found 02 tickets. There are 0 issues."
    answers = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "nothing"), (4, "total of 007")], "answer_id long, text string")
    retrieved = spark.createDataFrame([(1, "A-1"), (1, "A-2"), (3, "A-1")], "answer_id long, key string")
    found = grounding.wrong_counts(answers, retrieved)
    got = sorted((r["answer_id"], r["claimed"], r["actual"]) for r in found.collect())
    assert got == [(1, "0", "2")] * 4 + [(4, "7", "0")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan.split("Join LeftOuter")[1], plan


def test_grounded_texts_hold(spark, world):
    from pyspark.sql import functions as F

    corpus = world[0]
    rows = corpus.issues.filter("key like 'WEB%'").select(F.lit(0).alias("answer_id"), F.col("ord").alias("pos"), "key", "summary", "status", "priority", F.col("assignee.displayName").alias("assignee"), "labels")
    for kind, begins in (("list", "Found 4 issue(s):\n- WEB-1: Login button misplaced [Done]"), ("count", "Found 4 issue(s) matching"), ("detail", "**WEB-1**: Login button"), ("other", "Issues: WEB-1, WEB-2")):
        r = grounding.grounded(rows, kind).first()
        assert r["text"].startswith(begins) and r["citations"] == "WEB-1,WEB-2,WEB-3,WEB-4"
        if kind in ("list", "count"):
            assert _check(spark, world, r["text"], "key like 'WEB%'")[0]["valid"]


# ---- the whole way


def test_ask(world):
    a = world[2]
    r = a.ask("Show all critical issues", "boss")
    assert r.success and r.query_mode == "jql" and r.jql_used == "priority = Critical" and r.validation_passed
    assert r.answer == "Found 2 issue(s):\n• **OPS-2**: Rotate keys [Done] - Ben Hale\n• **WEB-3**: Audit trail [In Progress] - Ada Moss"
    assert [x["key"] for x in r.to_dict()["issues"]] == ["OPS-2", "WEB-3"]
    r = a.ask("show everything in OPS", "boss")
    assert r.answer.startswith("Found 6 issue(s) (2 To Do, 1 Done, 1 In Progress, 1 In Review, 1 Blocked):") and r.answer.endswith("... and 1 more")
    r = a.ask("how many bugs", "portal")
    assert r.answer == "There are 1 issue(s) matching your query." and r.warnings == ["3 issue(s) hidden due to permissions"]
    assert a.ask("hi", "boss").query_mode == "clarification"
    r = a.ask("Show all critical issues", "who")
    assert r.total_count == 0 and r.answer.startswith("No issues found")
    r = a.ask("bugs related to login", "boss")
    assert r.query_mode == "hybrid" and {x["key"] for x in r.to_dict()["issues"]} == {"OPS-1", "OPS-3", "WEB-1", "WEB-4"} and r.to_dict()["issues"][-1]["key"] == "OPS-1"
    r = a.ask("tickets about database backup", "boss")
    assert r.query_mode == "semantic" and r.to_dict()["issues"][0]["key"] == "OPS-1"


def test_answer_that_fails_its_check_falls_back(world):
    a = world[2]
    a.domains = router.Domains(a.domains.projects, (*a.domains.statuses, "Rotate"), a.domains.priorities, a.domains.types)  # a status word in a summary
    try:
        r = a.ask("Show all critical issues", "boss")
    finally:
        a.domains = world[0].domains
    assert not r.validation_passed and r.answer.startswith("Found 2 issue(s):\n- OPS-2: Rotate keys [Done]")


def test_claims_are_stripped_of_all_white_space(spark):
    rows = [(0, "OPS-1 is assigned to Ada Moss\n\n"), (1, "OPS-1 is assigned to Ada Moss\n."), (2, "OPS-1 is assigned to Bo Lee\t\n.")]
    answers = spark.createDataFrame(rows, "answer_id int, text string")
    retrieved = spark.createDataFrame([(k, "OPS-1", "Ada Moss") for k in range(3)], "answer_id int, key string, assignee string")
    assert [(r["answer_id"], r["claimed"]) for r in grounding.wrong_assignees(answers, retrieved).collect()] == [(2, "Bo Lee")]


def test_column_and_driver_routes_agree_on_white_space(spark):
    asked = ["\t a \n", "\tissues related to slow trading\n", "\n hi there\t", "Critical bugs related to login\t", " \u00a0x\u00a0"]
    got = {r["query"]: r for r in router.route(spark.createDataFrame([(q,) for q in asked], "query string")).collect()}
    for q in asked:
        r = router.classify(q)
        assert (got[q]["mode"], got[q]["jql_query"], got[q]["semantic_query"]) == (r.mode.value, r.jql_query, r.semantic_query), q


def test_filters_open_no_index(world):
    """A question that only filters asks for no index; a search opens it once."""
    corpus, profiles, a = world
    opened = []

    def index():
        opened.append(1)
        return a.index

    b = assistant.Assistant(corpus, profiles, a.route_domains, index=index)
    assert b.retrieve(assistant.Mode.JQL, "status = done", None).columns and not opened
    assert b.retrieve(assistant.Mode.SEMANTIC, None, "disk full").columns and b.index is a.index and opened == [1]


def test_rare_terms_alone_are_exchanged_for_lengths(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"A-{i}", f"common word{i % 3} rare{i} " * (i % 4)) for i in range(40)] + [(50, "B-1", None)], "ord long, key string, text string")
    want = {r["key"]: r["norm"] for r in textindex.build(docs).norms.collect()}
    for common in (0, 4, 1000):
        monkeypatch.setattr(textindex, "COMMON", common)
        monkeypatch.setattr(textindex, "BLOCK", 7)
        index = textindex.store(docs, str(tmp_path / str(common)))
        assert {r["key"]: pytest.approx(r["norm"]) for r in index.norms.collect()} == want
        assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, index.counts.collect()))


def test_similar_reads_its_own_terms(spark, tmp_path):
    """The document's terms are in the scan's filter; no other posting is read or exchanged."""
    docs = spark.createDataFrame([(i, f"A-{i}", f"disk w{i % 5} v{i}") for i in range(20)], "ord long, key string, text string")
    plan = textindex.similar(textindex.store(docs, str(tmp_path / "i")), "A-3")._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan


def test_first_ticket_is_found_once(spark, sf_dir, monkeypatch):
    from sieveline import queries

    seen, check = [], queries.access.check_access
    monkeypatch.setattr(queries.access, "check_access", lambda issue, *a: seen.append(issue._jdf.queryExecution().optimizedPlan().toString()) or check(issue, *a))
    queries.acl_permissions(spark, sf_dir)
    assert seen and not any("lineitem" in p or "Join" in p for p in seen)
