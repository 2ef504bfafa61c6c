"""Adapters: the normalised ticket view over relational tables, and the SQL of the same views for differential tests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.columns import chain
from sieveline.sources.issues import Domains, normalise, with_defaults

STATUS = {"O": "To Do", "P": "In Progress", "F": "Done"}
PRIORITY = {"1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low", "4-NOT SPECIFIED": "Unspecified"}
KIND = {"AUTOMOBILE": "Bug", "BUILDING": "Story", "FURNITURE": "Task", "HOUSEHOLD": "Spike", "MACHINERY": "Epic"}
DOMAINS = Domains(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLEEAST"), ("To Do", "In Progress", "In Review", "Done", "Blocked"), ("Critical", "High", "Medium", "Low"), ("Bug", "Story", "Task", "Spike", "Epic"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, values: dict[str, str]):
    return chain([(F.col(column) == k, F.lit(v)) for k, v in values.items()], F.lit(None).cast("string"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers and regions, as narrow as the tables are; `order_fields` makes a ticket's fields of them. Nations and regions are a few rows and broadcast."""
    nations = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "c_custkey", "c_name", "c_mktsegment", "r_name")


def order_fields() -> dict[str, Column]:
    """A ticket's fields but for labels and components, from `order_rows`."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    person = F.when(F.col("o_orderkey") % 7 != 0, F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("displayName"), F.lit(None).cast("string").alias("email")))
    return {
        "ord": F.col("o_orderkey"), "key": F.concat(F.replace("r_name", F.lit(" "), F.lit("")), F.lit("-"), F.col("o_orderkey").cast("string")),
        "summary": F.concat(F.lit("Order for "), F.lower("c_mktsegment")), "description": F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Placed by "), F.col("c_name"))),
        "status": _mapped("o_orderstatus", STATUS), "priority": _mapped("o_orderpriority", PRIORITY), "type": _mapped("c_mktsegment", KIND), "assignee": person, "created": iso, "updated": iso,
        "resolution": F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("Fixed")),
        "comments": F.array(F.struct(F.col("c_name").alias("author"), F.lit("Please hurry").alias("body"), iso.alias("created"))),
    }


def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, labels, components) of the orders that have line items. The lines of an order lie far apart, so sets of them made before the exchange
    would hold one line each and be larger than the lines: these are exchanged, and an order's lines pass one task."""
    parts = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = parts.select(F.col("l_orderkey").alias("o_orderkey"), F.lower("p_type").alias("label"), "p_brand").repartition("o_orderkey")
    return lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.sort_array(F.collect_set("p_brand")).alias("components"))


def order_issues(spark: SparkSession, sf_dir: str, arrays: bool = True) -> DataFrame:
    """Orders as tickets. arrays=False leaves labels and components empty and so needs no line items."""
    o = order_rows(spark, sf_dir)
    if arrays:
        o = o.join(order_lists(spark, sf_dir), "o_orderkey", "left")
    lists = ["labels", "components"] if arrays else []
    return normalise(o.select(*[c.alias(n) for n, c in order_fields().items()], *lists))


def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tickets: the language is the project, the text the description, marks from labels."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    m = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    flags = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    joined = d.join(m, "doc_id", "left")
    return normalise(
        joined.select(
            F.col("doc_id").alias("ord"), F.concat(F.upper("lang"), F.lit("-"), F.col("doc_id").cast("string")).alias("key"), F.concat(F.lit("Text from "), F.col("source")).alias("summary"),
            F.col("text").alias("description"), F.when(F.col("quality") == 1, "Done").when(F.col("quality") == 0, "To Do").otherwise("In Progress").alias("status"),
            F.when(F.col("toxic") == 1, "Critical").when(F.col("toxic") == 0, "Low").otherwise("Medium").alias("priority"), F.lit("Task").alias("type"), flags.alias("labels"), F.array("source").alias("components"),
        )
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, key, text) for the text index: the texts alone."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.upper("lang"), F.lit("-"), F.col("doc_id").cast("string")).alias("key"), "text")


#: One user for each access rule: user, projects, sees all, components, sees comments, restricted labels.
PROFILES = (
    ("all", ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLEEAST"), True, (), True, ()),
    ("one-project", ("ASIA",), True, (), True, ()),
    ("components", ("ASIA", "EUROPE"), False, ("Brand#1", "Brand#12"), True, ()),
    ("no-comments", ("EUROPE",), True, (), False, ("promo",)),
    ("labels", ("AFRICA", "AMERICA"), True, (), True, ("economy", "small")),
    ("guest", ("AFRICA", "ASIA"), True, (), False, ("*",)),
)
USERS = (*(p[0] for p in PROFILES), "nobody")


def profile_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    schema = "user_id string, projects array<string>, can_view_all_issues boolean, viewable_components array<string>, can_view_comments boolean, restricted_labels array<string>"
    return with_defaults(spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in p) for p in rows], schema))


def profiles(spark: SparkSession) -> DataFrame:
    return profile_rows(spark, PROFILES)


def users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in USERS], "user_id string")


def answers(issues: DataFrame) -> DataFrame:
    """(answer_id, text): an answer about each ticket, wrong in a known way by its number: status, count, key, assignee, or another ticket's key."""
    n, key = F.col("ord"), F.col("key")
    wrong = F.when(F.col("status") == "Done", "Blocked").otherwise("Done")
    lines = [
        F.concat(key, F.lit(" is "), F.when(n % 5 == 1, wrong).otherwise(F.col("status")), F.lit(".")),
        F.concat(key, F.lit(" has "), F.when(n % 7 == 3, "Critical").otherwise(F.when(F.col("priority") == "Unspecified", "no").otherwise(F.col("priority"))), F.lit(" priority.")),
        F.when(n % 5 == 2, F.lit("There are 7 issues.")).otherwise(F.lit("Found 1 ticket.")),
        F.when(n % 5 == 3, F.concat(F.lit("See FAKE-"), n.cast("string"), F.lit("."))),
        F.when(n % 5 == 4, F.concat(key, F.lit(" is assigned to Nobody Here."))).when(n % 5 == 0, F.concat(key, F.lit(" is assigned to Customer."))),
        F.when(n % 11 == 0, F.concat(F.lit("Like "), F.split_part(key, F.lit("-"), F.lit(1)), F.lit("-"), (n + 1).cast("string"), F.lit("."))),
    ]
    return issues.select(n.alias("answer_id"), F.concat_ws("\n", *lines).alias("text"))


def retrieved(issues: DataFrame) -> DataFrame:
    """(answer_id, pos, key, ...): the one row behind each of `answers`."""
    return issues.select(F.col("ord").alias("answer_id"), F.lit(0).alias("pos"), "key", "summary", "status", "priority", F.col("assignee.displayName").alias("assignee"), "labels")


# ---- the same in SQL


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


ISSUES_SQL = f"""
lists AS (SELECT l_orderkey, list_sort(list_distinct(list(lower(p_type)))) AS labels, list_sort(list_distinct(list(p_brand))) AS components FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
iss AS (
  SELECT o_orderkey AS ord, replace(r_name, ' ', '') || '-' || o_orderkey AS key, 'Order for ' || lower(c_mktsegment) AS summary,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Placed by ' || c_name END AS description, {_case("o_orderstatus", STATUS)} AS status, {_case("o_orderpriority", PRIORITY)} AS priority,
    {_case("c_mktsegment", KIND)} AS type, CASE WHEN o_orderkey % 7 <> 0 THEN c_name END AS assignee, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created, o_orderdate AS created_at,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Fixed' END END AS resolution,
    coalesce(labels, []) AS labels, coalesce(components, []) AS components
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN lists ON l_orderkey = o_orderkey)"""

DOCUMENTS_SQL = """
doc AS (SELECT doc_id AS ord, upper(lang) || '-' || doc_id AS key, text FROM documents)"""

DOCUMENT_ISSUES_SQL = """
diss AS (
  SELECT d.doc_id AS ord, upper(lang) || '-' || d.doc_id AS key, 'Text from ' || source AS summary, text AS description, CASE quality WHEN 1 THEN 'Done' WHEN 0 THEN 'To Do' ELSE 'In Progress' END AS status,
    CASE toxic WHEN 1 THEN 'Critical' WHEN 0 THEN 'Low' ELSE 'Medium' END AS priority, list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS labels, source
  FROM documents d LEFT JOIN labels m ON m.doc_id = d.doc_id)"""


def _values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join(rows) + ")"


def _list(values: tuple[str, ...]) -> str:
    return "CAST([" + ", ".join(f"'{v}'" for v in values) + "] AS VARCHAR[])"


PROFILES_SQL = (
    "prof AS (SELECT * FROM "
    + _values([f"('{u}', {_list(p)}, {str(a).lower()}, {_list(c)}, {str(k).lower()}, {_list(r)})" for u, p, a, c, k, r in PROFILES])
    + " AS t(user_id, projects, view_all, comps, view_comments, restricted)),\nusr AS (SELECT * FROM "
    + _values([f"('{u}')" for u in USERS])
    + " AS t(user_id))"
)

ANSWERS_SQL = """
ans AS (
  SELECT ord AS answer_id, concat_ws(chr(10),
    key || ' is ' || CASE WHEN ord % 5 = 1 THEN CASE WHEN status = 'Done' THEN 'Blocked' ELSE 'Done' END ELSE status END || '.',
    key || ' has ' || CASE WHEN ord % 7 = 3 THEN 'Critical' WHEN priority = 'Unspecified' THEN 'no' ELSE priority END || ' priority.',
    CASE WHEN ord % 5 = 2 THEN 'There are 7 issues.' ELSE 'Found 1 ticket.' END,
    CASE WHEN ord % 5 = 3 THEN 'See FAKE-' || ord || '.' END,
    CASE WHEN ord % 5 = 4 THEN key || ' is assigned to Nobody Here.' WHEN ord % 5 = 0 THEN key || ' is assigned to Customer.' END,
    CASE WHEN ord % 11 = 0 THEN 'Like ' || split_part(key, '-', 1) || '-' || (ord + 1) || '.' END) AS text
  FROM iss),
men AS (SELECT answer_id, text, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Z]{2,10}-[0-9]{1,6})\\b', 1))) AS key FROM ans)"""
