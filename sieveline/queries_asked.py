"""A question of every customer, answered all the way in one plan, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import queries
from sieveline.operators import grounding
from sieveline.plans import batch, router
from sieveline.queries import Query
from sieveline.sources import tables
from sieveline.sources.issues import Corpus

LANGS = ("EN", "FR", "DE", "ES")
WORDS = ("license", "software", "warranty", "copyright", "permission")
#: By the customer's number modulo their count.
FORMS = ("Show done tickets in {lang}", "How many to do tasks are there in {lang}", "tickets about {word} and copyright", "low tickets about {word} version", "hi", "critical issues with {word}")
#: user, projects, sees all, components, sees comments, restricted labels; customers ask as one of them or as someone unknown.
PROFILES = (("reader", ("EN", "FR"), True, (), True, ("toxic",)), ("all", LANGS, True, (), True, ()), ("guest", ("EN", "DE"), True, (), False, ("*",)), ("part", LANGS, False, ("src1", "src2", "src3"), True, ()))
USERS = ("reader", "all", "guest", "part", "nobody")
DOMAINS = router.Domains(LANGS, router.DEFAULT_DOMAINS.statuses, router.DEFAULT_DOMAINS.priorities, router.DEFAULT_DOMAINS.types)


def _one_of(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), number.cast("int"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    text = F.replace(F.replace(_one_of(FORMS, n % len(FORMS)), F.lit("{lang}"), _one_of(LANGS, F.floor(n / 7) % len(LANGS))), F.lit("{word}"), _one_of(WORDS, F.floor(n / 11) % len(WORDS)))
    return tables.read(spark, d, "customer").select(n.alias("question_id"), text.alias("query"), _one_of(USERS, F.floor(n / 13) % len(USERS)).alias("user_id"))


def said(spark: SparkSession, d: str) -> batch.Said:
    """Documents as tickets; some summaries name a wrong status, so that answers which show them fall back to a list."""
    issues = tables.document_issues(spark, d).withColumn("summary", F.when(F.col("ord") % 13 == 0, F.concat("summary", F.lit(" Blocked"))).otherwise(F.col("summary")))
    corpus = Corpus(issues, tables.DOMAINS)
    return batch.say_all(corpus, queries.stored_index(spark, d), tables.profile_rows(spark, PROFILES), questions(spark, d), DOMAINS)


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("question_id", "success", "query_mode", "jql_used", "semantic_query", "total_count", "answer", "validation_passed", F.array_join("warnings", "; ").alias("warnings"))


def ask_customers(spark: SparkSession, d: str) -> DataFrame:
    return shown(said(spark, d).rows())


def _cases(values: tuple[str, ...], number: str) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_WORD_ROWS = ", ".join(f"('{w}')" for w in WORDS)
_TEXTS = f"(SELECT w, f, CASE f WHEN 2 THEN 'tickets about ' || w || ' and copyright' WHEN 3 THEN 'tickets about ' || w || ' version' ELSE 'issues with ' || w END AS text FROM (VALUES {_WORD_ROWS}) AS a(w) CROSS JOIN (VALUES (2), (3), (5)) AS b(f))"
_TERMS = f"SELECT text AS query_id, term, count(*) AS tf FROM (SELECT text, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS term FROM {_TEXTS}) WHERE len(term) > 1 AND term NOT IN ({queries.STOPS_SQL}) GROUP BY ALL"
_LINE = "'• **' || key || '**: ' || summary || ' [' || status || ']'"
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"

SQL: dict[str, str] = {
    "ask_customers": queries.search_ctes(_TERMS, 0.1)
    + f""",{tables.DOCUMENT_ISSUES_SQL},
tick AS (SELECT ord, key, split_part(key, '-', 1) AS lang, summary || CASE WHEN ord % 13 = 0 THEN ' Blocked' ELSE '' END AS summary, status, priority, labels, source FROM diss),
texts AS {_TEXTS},
asked AS (
  SELECT c_custkey AS id, c_custkey % {len(FORMS)} AS f, {_cases(LANGS, "(c_custkey // 7)")} AS lang, {_cases(WORDS, "(c_custkey // 11)")} AS word, {_cases(USERS, "(c_custkey // 13)")} AS who FROM customer),
plans AS (SELECT DISTINCT f, CASE WHEN f < 2 THEN lang END AS lang, CASE WHEN f > 1 THEN word END AS word FROM asked WHERE f <> 4),
kept AS (SELECT p.*, key, ord FROM plans p JOIN tick ON CASE f WHEN 0 THEN tick.lang = p.lang AND status = 'Done' WHEN 1 THEN tick.lang = p.lang AND status = 'To Do' WHEN 3 THEN priority = 'Low' WHEN 5 THEN priority = 'Critical' ELSE false END),
sized AS (SELECT *, count(*) OVER (PARTITION BY f, lang, word) AS size FROM kept),
rows AS (
  SELECT f, lang, word, key, ord AS o FROM kept WHERE f < 2
  UNION ALL SELECT p.f, p.lang, p.word, rk.key, rk.rank FROM plans p JOIN texts t ON t.f = p.f AND t.w = p.word JOIN rk ON rk.query_id = t.text WHERE p.f = 2 AND rk.rank <= 10
  UNION ALL SELECT s.f, s.lang, s.word, s.key, CASE WHEN rk.rank <= size THEN rk.rank - 1000000000 ELSE s.ord END FROM sized s JOIN texts t ON t.f = s.f AND t.w = s.word LEFT JOIN rk ON rk.query_id = t.text AND rk.key = s.key WHERE s.f IN (3, 5)),
who AS (SELECT unnest([{", ".join(_QUOTED(u) for u in USERS)}]) AS who),
dec AS (
  SELECT r.*, who, tick.ord, summary, status, CASE who WHEN 'all' THEN true WHEN 'reader' THEN tick.lang IN ('EN', 'FR') AND NOT list_contains(labels, 'toxic')
    WHEN 'guest' THEN tick.lang IN ('EN', 'DE') AND len(labels) = 0 WHEN 'part' THEN source IN ('src1', 'src2', 'src3') ELSE false END AS ok
  FROM rows r JOIN tick ON tick.key = r.key CROSS JOIN who),
cnt AS (SELECT f, lang, word, who, count(*) AS before, count(*) FILTER (ok) AS n FROM dec GROUP BY ALL),
seen AS (SELECT *, row_number() OVER (PARTITION BY f, lang, word, who ORDER BY o) AS pos FROM dec WHERE ok),
st AS (SELECT f, lang, word, who, string_agg(c || ' ' || status, ', ' ORDER BY p) AS statuses FROM (SELECT f, lang, word, who, status, count(*) AS c, min(pos) AS p FROM seen GROUP BY ALL) GROUP BY ALL),
body AS (
  SELECT f, lang, word, who, string_agg({_LINE}, chr(10) ORDER BY pos) FILTER (pos <= 5) AS short, string_agg({_LINE} || ' - Unassigned', chr(10) ORDER BY pos) FILTER (pos <= 5) AS whole,
    string_agg('- ' || key || ': ' || summary || ' [' || status || ']', chr(10) ORDER BY pos) AS list
  FROM seen GROUP BY ALL),
bad AS (
  SELECT DISTINCT a.f, a.lang, a.word, a.who FROM seen a JOIN seen b ON a.f = b.f AND a.lang IS NOT DISTINCT FROM b.lang AND a.word IS NOT DISTINCT FROM b.word AND a.who = b.who
  WHERE a.f <> 1 AND a.pos <= 5 AND b.pos <= 5 AND starts_with(b.key, a.key) AND (a.status <> b.status OR b.ord % 13 = 0))
SELECT id AS question_id, true AS success, CASE q.f WHEN 4 THEN 'clarification' WHEN 2 THEN 'semantic' WHEN 3 THEN 'hybrid' WHEN 5 THEN 'hybrid' ELSE 'jql' END AS query_mode,
  CASE q.f WHEN 0 THEN 'project = ' || q.lang || ' AND status = ''Done''' WHEN 1 THEN 'project = ' || q.lang || ' AND status = ''To Do'' AND type = Task' WHEN 3 THEN 'priority = Low' WHEN 5 THEN 'priority = Critical' END AS jql_used,
  t.text AS semantic_query, coalesce(n, 0) AS total_count,
  CASE WHEN q.f = 4 THEN {_QUOTED(router.CLARIFY_TEXT)} WHEN coalesce(n, 0) = 0 THEN {_QUOTED(grounding.NO_RESULT_TEXT)} WHEN bad.f IS NOT NULL THEN 'Found ' || n || ' issue(s):' || chr(10) || list
    WHEN q.f = 1 THEN 'There are ' || n || ' issue(s) matching your query.' WHEN n <= 5 THEN 'Found ' || n || ' issue(s):' || chr(10) || whole
    ELSE 'Found ' || n || ' issue(s) (' || statuses || '):' || chr(10) || short || chr(10) || '... and ' || (n - 5) || ' more' END AS answer,
  bad.f IS NULL AS validation_passed, CASE WHEN before > n THEN (before - n) || ' issue(s) hidden due to permissions' ELSE '' END AS warnings
FROM asked q LEFT JOIN texts t ON t.f = q.f AND t.w = q.word
LEFT JOIN cnt ON cnt.f = q.f AND cnt.who = q.who AND coalesce(cnt.lang, q.lang) = q.lang AND coalesce(cnt.word, q.word) = q.word
LEFT JOIN st ON st.f = q.f AND st.who = q.who AND coalesce(st.lang, q.lang) = q.lang AND coalesce(st.word, q.word) = q.word
LEFT JOIN body ON body.f = q.f AND body.who = q.who AND coalesce(body.lang, q.lang) = q.lang AND coalesce(body.word, q.word) = q.word
LEFT JOIN bad ON bad.f = q.f AND bad.who = q.who AND coalesce(bad.lang, q.lang) = q.lang AND coalesce(bad.word, q.word) = q.word"""
}
QUERIES: dict[str, Query] = {"ask_customers": ask_customers}
