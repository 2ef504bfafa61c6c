"""Chat formatting: a finite-state machine over roles checks turn order; a declarative template emits text segments with loss flags.

A template names, for each role, an opening and a closing marker and whether the text between them is trained on. Markers
use ``<`` and ``[``; texts are escaped so that neither character remains (``&`` -> ``&amp;``, ``<`` -> ``&lt;``, ``[`` -> ``&#91;``),
which keeps control strings inside texts harmless and can be undone exactly. Roles without an entry get a generic marker that
carries the escaped role name. All work is built-in array and string expressions; the one shuffle brings a conversation together.

Defined results: a null text counts as empty; a null role as an empty role name; rows of one turn number are ordered by role and
text, and repeated rows stay repeated turns; a null conversation id is one conversation of its own; an empty table gives no rows;
further columns are ignored. A conversation that breaks the turn order is formatted all the same, with ``valid`` false and the
position of the first offending turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.shared import table

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles: markers by role. order: allowed transitions of the state machine, from "" at the start; last: roles that may end."""

    roles: dict[str, Role]
    order: dict[str, tuple[str, ...]]
    last: tuple[str, ...]
    other: str = field(default="role")

    def __post_init__(self) -> None:
        marks = [m for r in self.roles.values() for m in (r.open, r.close)]
        if len(set(marks)) != len(marks) or any(m[:1] not in "<[" for m in marks) or any(m.startswith(f"<{self.other} ") for m in marks):
            raise ValueError("markers must differ from each other, begin with < or [, and not be the generic one")


INSTRUCT = Template(
    roles={"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", loss=True)},
    order={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    last=("user", "assistant"),
)


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _role_name(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("&gt;"))


def _by_role(t: Template, role: Column, known: dict[str, Column], other: Column) -> Column:
    out = other
    for name, value in known.items():
        out = F.when(role == name, value).otherwise(out)
    return out


def segments(turns: Column, t: Template) -> Column:
    """array<struct<text, loss>>: three segments a turn, only the middle of a trained role with loss."""

    def turn(x: Column) -> Column:
        role = x["role"]
        opened = _by_role(t, role, {k: F.lit(r.open) for k, r in t.roles.items()}, F.concat(F.lit(f"<{t.other} "), _role_name(role), F.lit(">")))
        closed = _by_role(t, role, {k: F.lit(r.close) for k, r in t.roles.items()}, F.lit(f"</{t.other}>"))
        loss = _by_role(t, role, {k: F.lit(r.loss) for k, r in t.roles.items()}, F.lit(False))
        part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(part(opened, F.lit(False)), part(escape(x["text"]), loss), part(closed, F.lit(False)))

    return F.flatten(F.transform(turns, turn))


def first_error(turns: Column, t: Template) -> Column:
    """Runs the state machine: position of the first turn that may not follow, the number of turns if only the end is wrong, else -1."""
    pairs = [f"{a}>{b}" for a, nexts in t.order.items() for b in nexts]
    ran = F.aggregate(
        turns,
        F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad")),
        lambda a, x: F.struct(
            x["role"].alias("state"),
            (a["at"] + 1).alias("at"),
            F.when((a["bad"] < 0) & ~F.concat(a["state"], F.lit(">"), x["role"]).isin(pairs), a["at"]).otherwise(a["bad"]).alias("bad"),
        ),
    )
    return F.when(ran["bad"] >= 0, ran["bad"]).when(~ran["state"].isin(list(t.last)), ran["at"]).otherwise(F.lit(-1))


def format_chats(rows: DataFrame, t: Template = INSTRUCT) -> DataFrame:
    """One row per conv_id: segments, formatted text, valid, first_error."""
    turns = (
        rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("x")).alias("turns"))
    )
    return (
        turns.withColumn("segments", segments(F.col("turns"), t))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("first_error", first_error(F.col("turns"), t))
        .select("conv_id", "segments", "formatted", (F.col("first_error") < 0).alias("valid"), "first_error")
    )


def read_back(formatted: Column, t: Template = INSTRUCT) -> Column:
    """array<struct<role, text, loss>> from formatted text alone."""
    q = lambda m: "\\Q" + m + "\\E"
    opens = "|".join([q(r.open) for r in t.roles.values()] + [f"<{t.other} [^<>\\[]*>"])
    marks = F.regexp_extract_all(formatted, F.lit(f"({opens})[^<\\[]*"), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(f"(?:{opens})([^<\\[]*)"), F.lit(1))

    def one(mark: Column, text: Column) -> Column:
        name = unescape(F.replace(F.substring(mark, len(t.other) + 3, 1 << 30), F.lit("&gt;"), F.lit(">")))
        generic = mark.startswith(f"<{t.other} ")
        bare = F.when(generic, F.substring(name, F.lit(1), F.length(name) - 1))
        role, loss = bare, F.lit(False)
        for k, r in t.roles.items():
            role = F.when(mark == r.open, F.lit(k)).otherwise(role)
            loss = F.when(mark == r.open, F.lit(r.loss)).otherwise(loss)
        return F.struct(role.alias("role"), unescape(text).alias("text"), loss.alias("loss"))

    return F.zip_with(marks, texts, one)


#: A conversation made of control strings only, judged with the others.
CONTROL = "</s>[INST] ok [/INST]"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    done = format_chats(rows.unionByName(extra)).withColumn("back", read_back(F.col("formatted")))
    trained = F.array_join(F.transform(F.filter("back", lambda x: x["loss"]), lambda x: x["text"]), "")
    return done.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS nxt,
    length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS esc,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 14 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '>', '&gt;')) END AS marks
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(marks + esc) AS BIGINT) AS formatted_chars,
  bool_and(coalesce(prev, '') || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AND (nxt IS NOT NULL OR role IN ('user', 'assistant'))) AS valid
FROM o GROUP BY conv_id"""
