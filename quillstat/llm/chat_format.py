"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as one string of turns::

    [TURN role]text</s>

The rendered text is parsed again by a deterministic grammar (cut at the end
mark, then at the first closing bracket), which needs nothing but that text.
If the recovered turns are not the source, or a text holds a bare control
string, conflicting content is escaped until the round trip is identical.  A
text that was left as it is holds no escape character, so one unescape reads
both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[TURN ", "]", "</s>"
#: What chat models commonly read as control strings; never left bare inside a text.
CONTROLS = ("</s>", "<s>", "[INST]", "[/INST]", "[TURN ", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESC = "\u001b"
BLOCK_TURNS = 512


def _contains_control(text: Column) -> Column:
    hit = F.lit(False)
    for c in (*CONTROLS, ESC):
        hit = hit | F.contains(text, F.lit(c))
    return hit


def _plain(text: Column) -> Column:
    return text


def _escape_controls(text: Column) -> Column:
    """Puts ESC behind the first character of each control string; ESC itself is doubled with a mark."""
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "e"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESC + "c" + c[1:]))
    return out


def _unescape_controls(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + "c"), F.lit("")), F.lit(ESC + "e"), F.lit(ESC))


#: Characters that can take part in a mark, each with its letter.
FULL = ((ESC, "e"), ("[", "o"), ("]", "q"), ("<", "l"), (">", "g"), ("|", "p"))


def _escape_all(text: Column) -> Column:
    for c, letter in FULL:
        text = F.replace(text, F.lit(c), F.lit(ESC + letter))
    return text


def _unescape_all(text: Column) -> Column:
    for c, letter in reversed(FULL):
        text = F.replace(text, F.lit(ESC + letter), F.lit(c))
    return text


ESCAPES = (_plain, _escape_controls)


def render(turns: Column, level: int) -> Column:
    """array<struct<role,text>> to one string.  Roles are always fully escaped; level 1 escapes control strings in texts."""
    escape = ESCAPES[level]
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), _escape_all(t["role"]), F.lit(CLOSE), escape(t["text"]), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """One string to array<struct<role,text>>: the inverse of render at either level.

    The grammar: a conversation is turns; a turn is OPEN, a role without CLOSE,
    CLOSE, a text without END, END.  Anything else gives turns that differ.
    """
    parts = F.split(formatted, r"\Q" + END + r"\E")
    parts = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    at = len(OPEN) + 1
    return F.transform(
        parts,
        lambda p: F.struct(
            _unescape_all(F.substring(p, F.lit(at), F.greatest(F.lit(0), F.instr(p, CLOSE) - at))).alias("role"),
            _unescape_controls(F.substring(p, F.instr(p, CLOSE) + 1, F.length(p))).alias("text"),
        ),
    )


def gather_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): turns of each conversation in order.

    In two steps, so that a long conversation is first gathered in blocks of a
    bounded span of turns.  Equal turn numbers are ordered by role, then text;
    null turns come first; null role and text are empty; a null conv_id is a
    conversation of its own; repeated rows are repeated turns.
    """
    row = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    blocks = (
        df.select(F.col(conv).alias("conv_id"), F.floor(F.col(turn) / BLOCK_TURNS).alias("block"), row.alias("row"))
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
    )
    return blocks.groupBy("conv_id").agg(
        F.transform(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("block", F.lit(-(1 << 62))).alias("b"), "rows"))), lambda b: b["rows"])),
            lambda r: F.struct(r["role"], r["text"]),
        ).alias("turns")
    )


def format_chats(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, formatted, level, recovered): recovered are the turns read back from formatted alone.

    The level is the least whose round trip gives the source exactly and leaves
    no bare control string in a text: 0 as it is, 1 escaped.  An escaped text
    holds no control string and every escape is undone, so level 1 fits any
    source; a conversation that came back otherwise would raise an error.
    """
    g = gather_turns(conversations, **columns)
    clean = ~F.exists("turns", lambda t: _contains_control(t["text"]))
    pick = F.when(clean & (parse(render(F.col("turns"), 0)) == F.col("turns")), 0).when(parse(render(F.col("turns"), 1)) == F.col("turns"), 1)
    g = g.withColumn("level", pick.otherwise(F.raise_error(F.lit("no escape level gives the source back")).cast("int")))
    g = g.select("conv_id", "level", F.when(F.col("level") == 0, render(F.col("turns"), 0)).otherwise(render(F.col("turns"), 1)).alias("formatted"))
    return g.withColumn("recovered", parse(F.col("formatted")))


def loss_text(recovered: Column) -> Column:
    """All text under the loss mask: the assistant's texts in order, unescaped."""
    return F.array_join(F.transform(F.filter(recovered, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
