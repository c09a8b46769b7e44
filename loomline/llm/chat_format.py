"""Format conversations for training, and read them back, with DataFrame operations only.

A conversation's turns are collected and sorted as structs; neighbouring turns of one role become a
block by array functions; and the blocks are concatenated between a template's control strings:

    <s>[SYS]be brief[/SYS][INST]hello[+INST]anyone?[/INST][ANS]yes</s>

A control string that stands in a text gets a backslash after its first character, and one that has
backslashes there gets one more. So no text holds a control string, none can arise where a text meets
one, and taking the backslash away restores the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings: what opens a block, what goes on with it, what closes it, by role.

    Each begins with [ or <, ends with ] or > and has none of these in between. Roles without strings
    of their own take those of ``other`` and are named after them, up to ``named``. Texts of the roles in
    ``learned`` are under the loss mask.
    """

    begin: str = "<s>"
    roles: dict[str, tuple[str, str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[+SYS]", "[/SYS]"), "user": ("[INST]", "[+INST]", "[/INST]"), "assistant": ("[ANS]", "[+ANS]", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[+ROLE]", "[/ROLE]")
    named: str = "[IS]"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        each = self.controls()
        if len(set(each)) < len(each) or not all(re.fullmatch(r"[\[<][^\[\]<>\\]+[\]>]", c) for c in each):
            raise ValueError("control strings must differ, begin with [ or <, end with ] or > and have none of these or a backslash inside")

    def controls(self) -> list[str]:
        return [self.begin, self.named, *self.other, *(c for three in self.roles.values() for c in three)]

    def pattern(self, backslashes: str) -> str:
        """A regular expression of control strings with backslashes after the first character."""
        return "|".join(f"{re.escape(first)}{backslashes}(?:{'|'.join(re.escape(c[1:]) for c in self.controls() if c[0] == first)})" for first in sorted({c[0] for c in self.controls()}))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([\[<])(?=\\*+(?:{self._rests()}))", r"$1\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([\[<])\\(?=\\*+(?:{self._rests()}))", "$1")

    def _rests(self) -> str:
        # a text with [ where a control string has < is escaped too, which does no harm
        return "|".join(sorted({re.escape(c[1:]) for c in self.controls()}))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once even where inner functions use it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of neighbouring turns (role, text) that have the same role."""

    def cut(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: ~F.get(t, i - 2)["role"].eqNullSafe(F.get(t, i - 1)["role"]))
        size = lambda s, b, k: F.coalesce(F.get(s, k + 1), F.size(t) + 1) - b
        block = lambda s, b, k: F.struct(F.get(t, b - 1)["role"].alias("role"), F.transform(F.slice(t, b, size(s, b, k)), lambda x: x["text"]).alias("texts"))
        return let(starts, lambda s: F.transform(s, lambda b, k: block(s, b, k)))

    return let(turns, cut)


def _pieces(blocks: Column, template: Template) -> Column:
    """The output in pieces: a control string, the text up to the next one, and whether it is learned."""
    at = lambda k, role: F.coalesce(*[F.when(role == r, three[k]) for r, three in template.roles.items()], F.lit(template.other[k]))
    piece = lambda mark, text, loss: F.struct(mark.alias("mark"), text.alias("text"), loss.alias("loss"))
    none, no = F.lit(""), F.lit(False)

    def part(role: Column, x: Column, j: Column) -> Column:
        mark, text, loss = F.when(j == 0, at(0, role)).otherwise(at(1, role)), template.escape(x), role.isin(*template.learned)
        named = F.array(piece(mark, template.escape(role), no), piece(F.lit(template.named), text, loss))
        return F.when(role.isin(*template.roles), F.array(piece(mark, text, loss))).otherwise(named)

    block = lambda b: F.concat(F.flatten(F.transform(b["texts"], lambda x, j: part(b["role"], x, j))), F.array(piece(at(2, b["role"]), none, no)))
    return F.concat(F.array(piece(F.lit(template.begin), none, no)), F.flatten(F.transform(blocks, block)))


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template()) -> DataFrame:  # noqa: B008
    """One row per conversation: the id, formatted (text), n_blocks, and mask.

    ``mask`` runs along the formatted text: each entry passes ``skip`` characters and then has ``chars``
    of them, which are learned where ``loss`` is true. Rows go by turn, null first; rows of equal turn by
    role and text, and rows that repeat count each time. Null roles and texts are empty ones. A null id
    is a conversation of its own. An empty table gives an empty result; other columns aren't carried. A
    conversation is one row of output and so must fit in one; its turns are collected for that, and no
    other group is.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col), F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("one"))
    blocks = rows.groupBy(id_col).agg(F.sort_array(F.collect_list("one")).alias("all")).select(id_col, merged(F.col("all")).alias("blocks"))
    pieces = blocks.select(id_col, F.size("blocks").cast("long").alias("n_blocks"), _pieces(F.col("blocks"), template).alias("pieces"))
    run = lambda p: F.struct(F.length(p["mark"]).alias("skip"), F.length(p["text"]).alias("chars"), p["loss"].alias("loss"))
    return pieces.select(id_col, F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), "").alias("formatted"), "n_blocks", F.transform("pieces", run).alias("mask"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:  # noqa: B008
    """Turns (role, text) of a formatted conversation, as they were before they were merged (null: null)."""
    mark = template.pattern("")
    cut = F.transform(F.filter(F.split(formatted, f"(?={mark})"), lambda c: c != ""), lambda c: let(F.regexp_extract(c, f"^(?:{mark})", 0), lambda m: F.struct(m.alias("mark"), F.substr(c, F.length(m) + 1).alias("text"))))
    role = lambda m: F.coalesce(*[F.when(m.isin(*three[:2]), r) for r, three in template.roles.items()])
    turn = lambda r, p: F.struct(r.alias("role"), template.unescape(p["text"]).alias("text"))
    one = lambda all_, p, i: F.when(role(p["mark"]).isNotNull(), turn(role(p["mark"]), p)).when(p["mark"] == template.named, turn(template.unescape(F.get(all_, i - 1)["text"]), p))
    return let(cut, lambda a: F.filter(F.transform(a, lambda p, i: one(a, p, i)), lambda t: t.isNotNull()))


def learned_text(formatted: Column, mask: Column, template: Template = Template()) -> Column:  # noqa: B008
    """All text under the mask, unescaped, with nothing between its parts (null: null).

    The mask's entries begin where control strings do; one that doesn't fit the text is an error.
    """
    chunks = F.filter(F.split(formatted, f"(?={template.pattern('')})"), lambda c: c != "")
    fits = lambda c, m: F.coalesce(F.length(c) == m["skip"] + m["chars"], F.lit(False))
    text = lambda c, m: F.when(fits(c, m), F.when(m["loss"], template.unescape(F.substr(c, m["skip"] + 1)))).otherwise(F.raise_error(F.lit("the mask doesn't fit the formatted text")))
    return F.array_join(F.zip_with(chunks, mask, text), "")


def digests(formatted: DataFrame, id_col: str = "conv_id", template: Template = Template()) -> DataFrame:  # noqa: B008
    """Per formatted conversation, read back from it: counts and digests of its turns and learned text."""
    d = formatted.select(id_col, "n_blocks", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted"), template).alias("turns"), learned_text(F.col("formatted"), F.col("mask"), template).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "n_blocks")


#: Both turns of conversation -7, which the query adds.
PLANTED = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return digests(format_turns(rows.union(planted)))


def _sql() -> str:
    t = Template()
    marks = "|".join(rf"[\[<]\\*{re.escape(c[1:]).replace('/', '/')}" for c in t.controls())
    escaped = lambda c: f"len({c}) + len(regexp_extract_all({c}, '{marks}'))"
    by_role = lambda k: "CASE role " + " ".join(f"WHEN '{r}' THEN {len(three[k])}" for r, three in t.roles.items()) + f" ELSE {len(t.other[k])} END"
    known = ", ".join(f"'{r}'" for r in t.roles)
    return rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), 0, 'user', '{PLANTED}' UNION ALL SELECT CAST(-7 AS BIGINT), 1, 'assistant', '{PLANTED}'),
seen AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM rows_),
sized AS (
  SELECT *, {escaped('text')} + CASE WHEN role IN ({known}) THEN 0 ELSE {escaped('role')} + {len(t.named)} END
         + CASE WHEN opens THEN {by_role(0)} + {by_role(2)} ELSE {by_role(1)} END AS chars
  FROM seen)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST({len(t.begin)} + sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE opens) AS n_blocks
FROM sized GROUP BY conv_id
"""


QUERIES = {"op11_chat_format": op11_chat_format}
ORACLE = {"op11_chat_format": _sql()}
