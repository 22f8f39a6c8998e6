"""Chat formatting in Spark expressions only, and the reading back of what was written.

Template: ``<s>`` opens a conversation; adjacent turns of one role form a block, their
texts parted by ``[TURN]``::

    user       [INST] text [/INST]
    assistant  text</s>                 (under the loss mask)
    system     <<SYS>>text<</SYS>>
    any other  [ROLE]role[NAME]text[/ROLE]

A control string inside a text or role gets a backslash behind its first character;
one that already has backslashes there gets one more. Taking one away undoes it, so any
text survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REST = r"/?s>|/?INST\]|</?SYS>>|/?ROLE\]|NAME\]|TURN\]"
ESCAPE = rf"([<\[])(\\*)({_REST})"
UNESCAPE = rf"([<\[])\\(\\*)({_REST})"
_ENDS = r"(?<=\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _block(role: Column, texts: Column) -> Column:
    body = F.array_join(texts, "[TURN]")
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(body, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), body, F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("[ROLE]"), role, F.lit("[NAME]"), body, F.lit("[/ROLE]")))
    )


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted``.

    Turns are sorted by turn number, ties by role, then text; a null turn number comes
    first. Null texts and roles are empty. Repeated rows are turns of their own. Rows
    with a null conversation id form one conversation. Other columns are ignored. A
    conversation becomes one string, so its rows meet in one task by nature; the rows
    are escaped before that.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            escape(F.coalesce(F.col(role_col).cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    places = sorted_turns.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"])),
    )
    blocks = F.transform(
        "starts",
        lambda s, k: _block(
            F.element_at("turns", s)["role"],
            F.transform(F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s), lambda t: t["text"]),
        ),
    )
    return places.select("conv_id", F.concat(F.lit("<s>"), F.array_join(blocks, "")).alias("formatted"))


def _inner(block: Column, head: str, tail: str) -> Column:
    return block.substr(F.lit(len(head) + 1), F.char_length(block) - len(head) - len(tail))


def _read_block(block: Column) -> Column:
    """A block's turns, as an array of (role, text)."""

    def turns(role: Column, body: Column) -> Column:
        return F.transform(F.split(body, r"\[TURN\]"), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    user = turns(F.lit("user"), _inner(block, "[INST] ", " [/INST]"))
    assistant = turns(F.lit("assistant"), _inner(block, "", "</s>"))
    system = turns(F.lit("system"), _inner(block, "<<SYS>>", "<</SYS>>"))
    other = _inner(block, "[ROLE]", "[/ROLE]")
    named = turns(F.substring_index(other, "[NAME]", 1), F.substring_index(other, "[NAME]", -1))
    return F.when(F.endswith(block, F.lit("</s>")), assistant).when(F.endswith(block, F.lit("[/INST]")), user).when(F.endswith(block, F.lit("<</SYS>>")), system).otherwise(named)


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns that a formatted string holds."""
    blocks = F.filter(F.split(F.substring(formatted, 4, 2147483647), _ENDS), lambda b: b != "")
    return F.flatten(F.transform(blocks, _read_block))


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of ``format_conversations``'s output, from its strings alone."""
    read = formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
