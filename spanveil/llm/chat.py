"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything is DataFrame expressions.  A template names the mark before each
role's text, the end of a turn, the roles that carry loss, and the legal turn
orders.  Formatting gives text segments with a loss flag each, their
concatenation, and whether the machine accepts the order of turns, with the
place of the first illegal turn.

Control strings inside texts are escaped reversibly: a backslash becomes
``\\0;`` and the k-th control string ``\\k;``.  Control strings hold no
backslash and begin with ``#``, ``<`` or ``]``, so an escaped text holds none.

A conversation is one row of output and so one value; beyond that no key
gathers rows.  Defined cases: null texts and roles are empty; roles outside the
template keep their name in the mark and are illegal turns without loss; turns
that tie are ordered by role, then text; a null conversation id is a
conversation of its own; null turns come first; repeated rows are repeated
turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """roles: role to (mark, whether its text carries loss); moves: state to {role: next state}."""

    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {"system": ("### System: ", False), "user": ("### User: ", False), "assistant": ("### Assistant: ", True)})
    other: tuple[str, str] = ("### Other [", "]: ")
    end: str = "</turn>\n"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "asked", "user": "answer"}, "asked": {"user": "answer"}, "answer": {"assistant": "done"}, "done": {"user": "answer"}})
    start: str = "start"
    accepting: tuple[str, ...] = ("done",)

    def __post_init__(self):
        if any("\\" in c or c[0] not in "#<]" for c in self.controls):
            raise ValueError("control strings hold no backslash and begin with #, < or ]")

    @property
    def controls(self) -> list[str]:
        return [*(mark.strip() for mark, _ in self.roles.values()), *(x.strip() for x in self.other), self.end.strip()]

    def escape(self, text: Column) -> Column:
        text = F.replace(text, F.lit("\\"), F.lit("\\0;"))
        return reduce(lambda t, kc: F.replace(t, F.lit(kc[1]), F.lit(f"\\{kc[0]};")), enumerate(self.controls, 1), text)

    def unescape(self, text: Column) -> Column:
        text = reduce(lambda t, kc: F.replace(t, F.lit(f"\\{kc[0]};"), F.lit(kc[1])), enumerate(self.controls, 1), text)
        return F.replace(text, F.lit("\\0;"), F.lit("\\"))

    def mark(self, role: Column) -> Column:
        other = F.concat(F.lit(self.other[0]), self.escape(role), F.lit(self.other[1]))
        return reduce(lambda rest, r: F.when(role == r, F.lit(self.roles[r][0])).otherwise(rest), self.roles, other)

    def loss(self, role: Column) -> Column:
        return role.isin([r for r, (_, loss) in self.roles.items() if loss])


def format_chats(conversations: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, segments (text, loss), formatted, valid, first_illegal (turn number from 0, or null)."""
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gathered = conversations.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for state, to in template.moves.items() for role, then in to.items() for x in (f"{state}>{role}", then)])
    machine = F.aggregate(
        "turns",
        F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("illegal")),
        lambda a, t: F.struct(
            F.coalesce(moves[F.concat(a["state"], F.lit(">"), t["role"])], F.lit("illegal")).alias("state"),
            (a["at"] + 1).alias("at"),
            F.coalesce(a["illegal"], F.when(moves[F.concat(a["state"], F.lit(">"), t["role"])].isNull(), a["at"])).alias("illegal"),
        ),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(piece(template.mark(t["role"]), F.lit(False)), piece(template.escape(t["text"]), template.loss(t["role"])), piece(F.lit(template.end), F.lit(False)))))
    return (
        gathered.select("conv_id", segments.alias("segments"), machine.alias("machine"))
        .select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), (F.col("machine.state").isin(*template.accepting)).alias("valid"), F.col("machine.illegal").alias("first_illegal"))
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text holds."""
    pieces = F.filter(F.split(formatted, f"\\Q{template.end}\\E", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        open_, close = template.other
        at = F.instr(p, close)
        other = F.struct(template.unescape(F.substring(p, F.lit(len(open_) + 1), at - len(open_) - 1)).alias("role"), template.unescape(F.substring(p, at + len(close), F.length(p))).alias("text"))
        known = lambda r: F.struct(F.lit(r).alias("role"), template.unescape(F.substring(p, F.lit(len(template.roles[r][0]) + 1), F.length(p))).alias("text"))
        return reduce(lambda rest, r: F.when(F.startswith(p, F.lit(template.roles[r][0])), known(r)).otherwise(rest), template.roles, other)

    return F.transform(pieces, turn)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = Template()
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(planted)
    out = format_chats(rows, template)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    return out.select("conv_id", "formatted", "valid", loss.alias("loss"), read_back(F.col("formatted"), template).alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS idx,
    replace(replace(replace(replace(replace(replace(replace(text, '\', '\0;'), '### System:', '\1;'), '### User:', '\2;'), '### Assistant:', '\3;'), '### Other [', '\4;'), ']:', '\5;'), '</turn>', '\6;') AS esc
  FROM c),
f AS (SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY idx) = 'system' AS led FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + 8 + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 14 + length(role) END) AS BIGINT) AS formatted_chars,
  bool_and(role = CASE WHEN led AND idx = 0 THEN 'system' WHEN (idx - led::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END) AND (count(*) - any_value(led::INT)) % 2 = 0 AND count(*) > any_value(led::INT) AS valid
FROM f GROUP BY conv_id
"""
