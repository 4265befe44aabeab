"""Chat formatting whose output can be read back, in DataFrame functions only.

Grammar of a conversation::

    conversation = turn*
    turn         = "### " ["\\"] role ": " body "</turn>"

The parser cuts at every ``</turn>``; a piece is a turn if it starts with ``### ``,
holds that marker nowhere else and has a ``": "``.  A turn is first written as it is
and parsed again; if the result is not the source, it is written escaped, which the
``\\`` before the role tells.  Escapes: ``\\`` is ``\\e``, ``</turn>`` is
``\\l/turn>``, ``### `` is ``\\h## ``; in roles every ``<``, ``#`` and ``:`` is
``\\l``, ``\\h``, ``\\c``.  An escaped turn always reads back as its source.

Defined results: null roles and texts are empty; rows with a null conversation id
are one conversation; turns are ordered by (turn, role, text), nulls first, and
repeated rows are turns of their own; an empty table gives no rows.  Other columns
are ignored.  A conversation is one text, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import table

START, END = "### ", "</turn>"
ASSISTANT = "assistant"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped_text(text: Column) -> Column:
    return _replace(_replace(_replace(text, "\\", "\\e"), END, "\\l" + END[1:]), START, "\\h" + START[1:])


def escaped_role(role: Column) -> Column:
    for old, new in (("\\", "\\e"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")):
        role = _replace(role, old, new)
    return role


def unescaped(text: Column) -> Column:
    """Undo either escape; the escape of the escape sign comes last, so that it cannot make new ones."""
    for old, new in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\e", "\\")):
        text = _replace(text, old, new)
    return text


def written(role: Column, text: Column, escape: bool) -> Column:
    if escape:
        return F.concat(F.lit(START + "\\"), escaped_role(role), F.lit(": "), escaped_text(text), F.lit(END))
    return F.concat(F.lit(START), role, F.lit(": "), text, F.lit(END))


def parsed_turn(piece: Column) -> Column:
    """(role, text, body, escaped) of what stands between two ends; null if it is no turn."""
    head = F.substring_index(piece, ": ", 1)
    body = F.substring(piece, F.length(head) + 3, F.length(piece))
    is_escaped = head.startswith(START + "\\")
    name = F.substring(head, F.when(is_escaped, len(START) + 2).otherwise(len(START) + 1), F.length(head))
    turn = F.struct(
        F.when(is_escaped, unescaped(name)).otherwise(name).alias("role"),
        F.when(is_escaped, unescaped(body)).otherwise(body).alias("text"),
        body.alias("body"),
        (F.length(head) + 3).alias("start"),
        is_escaped.alias("escaped"),
    )
    good = piece.startswith(START) & ~F.contains(F.substring(piece, 2, F.length(piece)), F.lit(START)) & (F.length(head) < F.length(piece))
    return F.when(good, turn)


def pieces(formatted: Column) -> Column:
    """What stands before each end mark."""
    cut = F.split(formatted, END)
    return F.slice(cut, 1, F.size(cut) - 1)


def reads_back(piece: Column, role: Column, text: Column) -> Column:
    """Is a written turn one turn for the parser, and the same one?"""
    parts = pieces(piece)
    turn = parsed_turn(parts[0])
    return F.coalesce((F.size(parts) == 1) & piece.endswith(END) & (turn["role"] == role) & (turn["text"] == text), F.lit(False))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted) from rows by turn (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = written(F.col("role"), F.col("text"), escape=False)
    safe = F.when(reads_back(plain, F.col("role"), F.col("text")), plain).otherwise(written(F.col("role"), F.col("text"), escape=True))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", safe.alias("piece"))))
    return rows.groupBy("conv_id").agg(ordered.alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted")
    )


def read_conversations(formatted: DataFrame) -> DataFrame:
    """``formatted`` with its turns and loss mask, from the text alone.

    ``turns`` has (role, text).  ``loss_mask`` has one (start, length, escaped) for each turn, counted in characters of the
    turn's own piece from 1; its length is 0 for all but assistant turns.  Reading under it is linear in the text.
    """
    parts = F.transform(pieces(F.col("formatted")), parsed_turn)
    return formatted.withColumns(
        {
            "turns": F.transform(parts, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))),
            "loss_mask": F.transform(
                parts,
                lambda t: F.struct(
                    t["start"].alias("start"),
                    F.when(t["role"] == ASSISTANT, F.length(t["body"])).otherwise(0).alias("length"),
                    t["escaped"].alias("escaped"),
                ),
            ),
        }
    )


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""

    def read(piece: Column, m: Column) -> Column:
        body = F.substring(piece, m["start"], m["length"])
        return F.when(m["escaped"], unescaped(body)).otherwise(body)

    return F.array_join(F.zip_with(pieces(formatted), mask, read), "")


def with_planted(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose texts are made of control strings."""
    text = "\\### Assistant: </turn> ok"
    row = lambda turn, role: F.struct(F.lit(-7).cast("long"), F.lit(turn).cast("long"), F.lit(role), F.lit(text))
    planted = turns.sparkSession.range(1).select(F.inline(F.array(row(0, "user"), row(1, ASSISTANT)))).toDF("conv_id", "turn", "role", "text")
    return turns.select("conv_id", "turn", "role", "text").unionByName(planted)


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    read = read_conversations(format_conversations(with_planted(table(spark, folder, "conversations"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = under_mask(F.col("formatted"), F.col("loss_mask"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
with source as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), judged as (
  select *, contains(role || ': ' || text, '</turn>') or contains('## ' || role || ': ' || text, '### ')
    or contains(role, ': ') or starts_with(role, '\') as clash
  from source
), sized as (
  select *, 4 + 2 + 7 + case when clash
    then 1 + length(replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '#', '\h'), ':', '\c'))
      + length(replace(replace(replace(text, '\', '\e'), '</turn>', '\l/turn>'), '### ', '\h## '))
    else length(role) + length(text) end as chars
  from judged
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""
