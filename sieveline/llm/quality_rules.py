"""Quality rules: a threshold table compiled into one Spark projection.

Every rule bounds a ratio of two counts of the text (length, symbols, stop words, lines). The counts are built-in array
and string expressions over the whole text; no user functions, no shuffle, one pass over the scan.

Defined results: null and empty texts count as zero everywhere and fail the base rule (fewer than 50 words); ties cannot
arise, as a text is judged alone; repeated rows get equal results; an empty table gives an empty result; other columns
of the input pass through untouched unless they carry the name of a result column, which then holds the result. Texts of any length are counted whole,
in arrays of their words and windows, so one row's memory grows with its text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.shared import BLANKS, table, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "das den der des die ein eine für ist mit nicht sich und von zu im auf "
    "al con del el es la las los no para por que se su un una y"
).split()

#: As words stand in texts: small, with a capital, in capitals.
STOP_FORMS = sorted({f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())})


@dataclass(frozen=True)
class Rule:
    """low <= 100 * numerator / denominator <= high, compared in whole numbers; None: unbounded."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: The threshold table. Columns are counts that `counts` computes.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 15),
    Rule("exclamations_per_word", "n_exclamations", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)

#: Up to so many different repeated windows are looked up one by one; above, window positions are sorted by hash.
FEW_REPEATS = 24


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules use. Windows are compared by 64-bit hashes of their three words, within one text only."""
    body = F.coalesce(F.col(text), F.lit(""))
    lead = "_"
    while any(c.startswith(lead) for c in docs.columns):
        lead += "_"
    own = lambda name: lead + name  # noqa: E731  a name that no column of docs has
    df = docs.withColumn(own("w"), words(F.col(text)))
    df = df.withColumn(own("n"), F.size(own("w")))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    df = df.withColumn(own("lines"), lines)
    df = df.withColumn(
        own("h"),
        F.when(F.col(own("n")) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.slice(own("w"), F.lit(1), F.greatest(F.col(own("n")) - 2, F.lit(0))),
                lambda w, i: F.xxhash64(w, F.get(F.col(own("w")), i + 1), F.get(F.col(own("w")), i + 2)),
            )
        ),
    )
    df = df.withColumn(own("s"), F.sort_array(own("h")))
    df = df.withColumn(own("again"), F.array_distinct(F.filter(F.col(own("s")), lambda x, i: (i > 0) & (x == F.get(F.col(own("s")), i - 1)))))
    few = F.filter(F.sequence(F.lit(0), F.size(own("h")) - 1), lambda i: F.array_contains(F.col(own("again")), F.get(F.col(own("h")), i)))
    many = _by_sorting(own("h"))
    df = df.withColumn(own("at"), F.when(F.size(own("again")) == 0, F.array().cast("array<int>")).when(F.size(own("again")) <= FEW_REPEATS, few).otherwise(many))
    covered = F.aggregate(
        own("at"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return df.withColumns(
        {
            "n_words": F.col(own("n")).cast("long"),
            "word_chars": F.length(F.array_join(own("w"), "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_exclamations": F.regexp_count(body, F.lit("!")).cast("long"),
            "n_lines": F.size(own("lines")).cast("long"),
            "n_dup_lines": (F.size(own("lines")) - F.size(F.array_distinct(own("lines")))).cast("long"),
            "n_stop_words": F.size(F.filter(own("w"), lambda w: w.isin(STOP_FORMS))).cast("long"),
            "n_repeat_words": covered.cast("long"),
        }
    ).drop(own("w"), own("n"), own("lines"), own("h"), own("s"), own("again"), own("at"))


def _by_sorting(h: str) -> Column:
    """Positions of repeated hashes: (hash, position) sorted, neighbours compared, positions sorted again."""
    ordered = F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pairs = F.zip_with(
        ordered,
        F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: true if every rule holds."""

    def one(r: Rule) -> Column:
        x, y = F.col(r.numerator) * 100, F.col(r.denominator)
        return reduce(lambda a, b: a & b, [c for c in ((x >= y * r.low) if r.low is not None else None, (x <= y * r.high) if r.high is not None else None) if c is not None], F.lit(True))

    return reduce(lambda a, b: a & b, [one(r) for r in rules], F.lit(True))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the counts, base_failed and kept."""
    df = counts(docs, text)
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_lines", "n_stop_words", "base_failed", "kept")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def sql() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    rules = " AND ".join(
        c
        for r in RULES
        for c in ([f"100 * {r.numerator} >= {r.low} * {r.denominator}"] if r.low is not None else []) + ([f"100 * {r.numerator} <= {r.high} * {r.denominator}"] if r.high is not None else [])
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 3)) AS k)) GROUP BY 1),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(list_filter(ws, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {rules}) AS kept
FROM m"""
