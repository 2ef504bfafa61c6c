"""URL filters: domain rules first, then link-graph propagation per host.

Rules name a host and a path prefix; the longest rule that fits decides. Where none fits, trust and distrust of the host decide:
personalised PageRank runs from the hosts of allowed pages along host edges, and from the hosts of blocked pages against them;
a host whose distrust is higher than its trust is blocked. Host edges are links between hosts (with a scheme or beginning with ``//``), and a two-way edge
between a host and its parent domain, so that evidence on one subdomain reaches its siblings. Everything is DataFrame
aggregation and joins on hosts; the ranks, one row a host, are written to the shared folder every `BLOCK` rounds. Rounds go on until the
mass that still moves, which bounds the error of all ranks together, is at most `RESIDUAL` and no further host is reached.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule, and is allowed; an empty html
gives no edges; repeated rows are judged alike and count as repeated evidence; equal trust and distrust (both may be zero; sums are compared with a
margin of `MARGIN` of their size) allow; very long urls and pages are searched whole, and only the hosts of their links go on; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.shared import Scratch, cut, lower_ascii, table


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/", True),
    UrlRule("example.com", "/en/", False),
    UrlRule("www.example.com", "/en/", True),
    UrlRule("net", "/es/", False),
    UrlRule("net", "/fr/", False),
)

DAMPING = 0.85
RESIDUAL, MARGIN = 1e-3, 1e-9
BLOCK = 8

#: The host of a link: behind href or src, a scheme or none, and two slashes.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:\w+:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(text of the longest rule that fits or null, whether it allows)."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, allow = F.when(fits, r.text).otherwise(text), F.when(fits, F.lit(r.allow)).otherwise(allow)
    return text, allow


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) between different hosts; pages: host, html."""
    linked = (
        pages.filter(F.col("html").contains("//"))
        .select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
        .groupBy(F.col("host").alias("src"), lower_ascii(F.col("to")).alias("dst"))
        .agg(F.count("*").cast("double").alias("w"))
    )
    labels = F.split("host", "[.]")
    up = (
        pages.select("host").distinct()
        .select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 2, F.lit(1))), lambda i: F.struct(
            F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("src"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("dst")))).alias("e"))
        .select("e.src", "e.dst").filter(F.col("dst").contains(".")).distinct()
    )
    both = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1.0))
    return linked.union(both).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, damping: float = DAMPING, residual: float = RESIDUAL) -> DataFrame:
    """(host, trust, distrust). seeds: host, good, bad (evidence); trust follows edges, distrust runs against them.

    The ranks are the series (1 - damping) * sum of damping^k * step^k of the seeds; t and d are the terms that move in a round.
    """
    seeds = scratch.cut(seeds, "url-evidence")
    good, bad = seeds.agg(F.sum("good"), F.sum("bad")).first()
    out = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    back = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    moves = edges.join(out, "src").join(back, "dst").select("src", "dst", (F.col("w") / F.col("out_w")).alias("a"), (F.col("w") / F.col("in_w")).alias("b"))
    none = F.lit(0.0)
    ways = [
        moves.select(F.col("src").alias("at"), F.col("dst").alias("to"), "a", none.alias("b"), none.alias("keep")),
        moves.select(F.col("dst").alias("at"), F.col("src").alias("to"), none.alias("a"), "b", none.alias("keep")),
        # what a host has gathered stays with it: a way to itself, so that a round reads the ranks once
        edges.select(F.col("src").alias("at")).union(edges.select("dst")).union(seeds.select("host")).distinct().select("at", F.col("at").alias("to"), none.alias("a"), none.alias("b"), F.lit(1.0).alias("keep")),
    ]
    moves = scratch.cut(ways[0].union(ways[1]).union(ways[2]), "url-moves")
    rank = seeds.select("host", (F.col("good") / (good or 1.0)).alias("t"), (F.col("bad") / (bad or 1.0)).alias("d"))
    rank = rank.select("host", ((1 - damping) * F.col("t")).alias("trust"), ((1 - damping) * F.col("d")).alias("distrust"), "t", "d")
    own, reached = Scratch(scratch.spark), -1
    while True:
        for _ in range(BLOCK):
            t, d = damping * F.col("a") * F.col("t"), damping * F.col("b") * F.col("d")
            sent = moves.join(rank, moves["at"] == rank["host"]).select(
                F.col("to").alias("host"), (F.col("keep") * F.col("trust") + (1 - damping) * t).alias("trust"), (F.col("keep") * F.col("distrust") + (1 - damping) * d).alias("distrust"), t.alias("t"), d.alias("d")
            )
            rank = sent.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("trust", "distrust", "t", "d")))
        rank = own.renew(rank, "url-rank")
        moving, hosts = rank.agg(F.sum(F.col("t") + F.col("d")), F.count_if((F.col("trust") > 0) | (F.col("distrust") > 0))).first()
        if (moving or 0.0) <= residual and hosts == reached:
            scratch.paths += own.paths
            return rank.select("host", "trust", "distrust")
        reached = hosts


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    text, allow = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.withColumn("rule", text).withColumn("allow", allow)
    seeds = ruled.groupBy("host").agg(F.count_if(F.col("allow")).cast("double").alias("good"), F.count_if(~F.col("allow")).cast("double").alias("bad"))
    with Scratch(pages.sparkSession) as scratch:
        edges = scratch.cut(host_edges(ruled.select("host", "html")), "url-edges")
        rank = propagate(seeds.filter("host <> ''"), edges, scratch)
        bad = cut(rank.filter(f"distrust > trust + {MARGIN} * (trust + distrust)").select("host", F.lit(True).alias("bad_host")), "url-bad")
    by_method = F.when(F.col("bad_host"), "block").otherwise("allow")
    by_rule = F.when(F.col("allow"), "allow").when(~F.col("allow"), "block")
    return ruled.drop("html").join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_method).alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: Rounds after which at most RESIDUAL of a mass of two moves.
ENOUGH = BLOCK * math.ceil(math.log(RESIDUAL / 2) / math.log(DAMPING) / BLOCK)


def sql(rounds: int = ENOUGH) -> str:
    """As many rounds as bring the residual down in any graph whose hosts are all within them."""
    rules = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in rules) + " END"
    allow = "CASE " + " ".join(f"WHEN {fits(r)} THEN {str(r.allow).lower()}" for r in rules) + " END"
    steps = "".join(
        f""",
t{k} AS MATERIALIZED (SELECT m.t AS host, sum({DAMPING} * m.a * r.trust) AS trust, sum({DAMPING} * m.b * r.distrust) AS distrust FROM moves m JOIN t{k - 1} r ON r.host = m.f GROUP BY 1)"""
        for k in range(1, rounds + 1)
    )
    every = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(rounds + 1))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    return f"""
WITH n AS (
  SELECT page_id, html, {low.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, {rule} AS rule, {allow} AS allow FROM n),
ev AS (SELECT host, CAST(count(*) FILTER (allow) AS DOUBLE) AS good, CAST(count(*) FILTER (NOT allow) AS DOUBLE) AS bad FROM ruled WHERE host <> '' GROUP BY host),
linked AS (SELECT host AS src, {low.format("d")} AS dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS d FROM ruled) GROUP BY 1, 2),
lab AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM ruled),
up AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM (SELECT l, unnest(range(1, greatest(len(l) - 1, 2))) AS i FROM lab) WHERE contains(array_to_string(l[i + 1:], '.'), '.')),
e AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM linked UNION ALL SELECT src, dst, 1.0 FROM up UNION ALL SELECT dst, src, 1.0 FROM up) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
mv AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS a, w / sum(w) OVER (PARTITION BY dst) AS b FROM e),
moves AS MATERIALIZED (SELECT src AS f, dst AS t, a, 0.0 AS b FROM mv UNION ALL SELECT dst, src, 0.0, b FROM mv),
t0 AS MATERIALIZED (SELECT host, CASE WHEN (SELECT sum(good) FROM ev) > 0 THEN good / (SELECT sum(good) FROM ev) ELSE 0 END AS trust, CASE WHEN (SELECT sum(bad) FROM ev) > 0 THEN bad / (SELECT sum(bad) FROM ev) ELSE 0 END AS distrust FROM ev){steps},
k AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM ({every}) GROUP BY 1)
SELECT page_id, ruled.host, path, rule, CASE WHEN allow THEN 'allow' WHEN NOT allow THEN 'block' WHEN k.distrust > k.trust + {MARGIN} * (k.trust + k.distrust) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN k ON k.host = ruled.host"""
