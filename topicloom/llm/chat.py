"""Prefix-target expansion of conversations, in DataFrame functions only.

Every assistant turn becomes its own example: all preceding turns as context, then
that reply, which alone is trainable.  Turns behind the last reply are kept in one
further example without a target, so no turn is lost.

Template, for every turn:  ``<s>[INST]role[/INST]text</s>``.  A backslash inside a
role or text is doubled, and one is put into each control string found there, so
none of the template's control strings can appear inside a turn; a backslash always
escapes the one character after it, which makes the template reversible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    doubled = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<(?=/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MID), escape(text), F.lit(CLOSE))


def expand(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Rows by turn -> examples ``conv_id, n_turns, trainable, text, loss_start, loss_chars``.

    ``loss_start`` (0-based) and ``loss_chars`` are code points of ``text``: the span
    of the escaped reply.  Examples without a target have ``trainable`` false and an
    empty span.  Null text or role counts as empty, a null turn sorts first, rows of
    one turn number sort by role and text and stay separate, a null conversation id
    is a conversation of its own; an empty table gives no examples; other columns are
    not read.  Only the turns of one conversation ever meet in a task; the examples
    of a conversation grow with the square of its turns, which is what is asked for.
    """
    one = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    convs = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: render(t["role"], t["text"])).alias("shown"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("chars"),
        F.transform("turns", lambda t: t["role"] == ASSISTANT).alias("reply"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("shown")), lambda i: F.element_at("reply", i) | (i == F.size("shown")))
    x = convs.select("*", F.explode(ends).alias("n_turns"))
    text = F.array_join(F.slice("shown", 1, F.col("n_turns")), "")
    target = F.element_at("reply", F.col("n_turns"))
    loss = F.when(target, F.element_at("chars", F.col("n_turns"))).otherwise(0)
    x = x.select("conv_id", "n_turns", target.alias("trainable"), text.alias("text"), loss.alias("loss_chars"))
    start = F.when(F.col("trainable"), F.length("text") - F.col("loss_chars") - len(CLOSE)).otherwise(0)
    return x.select("conv_id", "n_turns", "trainable", "text", start.alias("loss_start"), "loss_chars")


def parse(text: Column) -> Column:
    """An example's text -> array of (role, text), unescaped."""
    parts = F.split(text, "</s>")
    bodies = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    return F.transform(
        bodies,
        lambda p: F.struct(
            unescape(F.substring_index(p, MID, 1)).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, MID, 1)) + len(MID) + 1)).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, all of it read back from its examples."""
    masked = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_chars")))
    per = examples.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("trainable"), F.struct("n_turns", masked.alias("loss"))))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    per = per.select(
        "conv_id",
        parse(F.col("whole")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
        "formatted_chars",
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
