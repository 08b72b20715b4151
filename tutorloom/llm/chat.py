"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it, formatted, are its ``context``, and its own text is the
``target``, the only part under the loss mask. A conversation that doesn't end with an assistant turn gets one more example
without a target, so that no turn is lost.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. A control string inside a role or text gets one
backslash more after its ``<`` (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), so no text can open or close a turn, and
taking one backslash away restores it. A line break inside a role is written ``<|nl|>``.

Defined results: null text and null role are empty; a null conversation id is a conversation of its own; rows with the same
turn are ordered by role, then text; repeated rows are turns of their own; other columns are ignored. A conversation is put
together in one row, as its text and the digest of its turns are; the examples share that row until they are cut from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def head_of(role: Column) -> Column:
    """A turn up to its text."""
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, target_turn, context, target, closing) of every assistant turn of ``turns`` (conv_id, turn, role, text).

    ``target`` is the escaped reply, ``closing`` the end mark after it; the formatted example is the three in a row.
    ``target_turn`` counts the turns of the conversation from 0 and is null in an example without a target.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "role", head_of(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), (F.row_number().over(order) - 1).alias("at"))
    rows = rows.select("conv_id", "role", "at", F.concat("head", "body", F.lit(END + "\n")).alias("segment"), F.char_length("head").alias("lead"), F.char_length("body").alias("size"))
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stop", F.sum(F.char_length("segment")).over(so_far))
    tail = len(END) + 1
    spot = F.struct("at", (F.col("stop") - tail - F.col("size")).alias("start"), F.col("size").alias("size"))
    whole = rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "segment"))), lambda x: x["segment"]), "").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("role") == TRAINED_ROLE, spot))).alias("spots"),
        F.max_by("role", "at").alias("last_role"),
    )
    bare = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.char_length("whole").cast("bigint").alias("start"), F.lit(0).alias("size")))
    spots = F.when(F.col("last_role") == TRAINED_ROLE, F.col("spots")).otherwise(F.concat("spots", bare))
    cut = whole.select("conv_id", "whole", F.explode(spots).alias("spot"))
    start, size = F.col("spot.start").cast("int"), F.col("spot.size")
    return cut.select(
        "conv_id",
        F.col("spot.at").alias("target_turn"),
        F.substring("whole", F.lit(1), start).alias("context"),
        F.substring("whole", start + 1, size).alias("target"),
        F.when(F.col("spot.at").isNotNull(), F.lit(END + "\n")).otherwise("").alias("closing"),
    )


def formatted(rows: DataFrame) -> Column:
    return F.concat("context", "target", "closing")


def parsed_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""

    def turn(segment: Column) -> Column:
        at = F.instr(segment, "\n")
        role = F.replace(F.substring(segment, F.lit(1), at - 1), F.lit(BREAK), F.lit("\n"))
        body = F.substring(segment, at + 1, F.char_length(segment) - at - len(END) - 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    segments = F.split(text, "<\\|im_start\\|>")
    return F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), turn)


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples alone: its turns and what is under the loss mask.

    The longest example holds every turn; ``formatted_chars`` adds up the code points of all examples.
    """
    text = formatted(rows)
    each = rows.select(
        "conv_id", "target_turn", unescape(F.col("target")).alias("loss"), F.char_length(text).cast("bigint").alias("size"), text.alias("text")
    )
    joined = each.groupBy("conv_id").agg(
        F.max_by("text", "size").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("target_turn").isNotNull(), F.struct("target_turn", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("size").alias("formatted_chars"),
    )
    turns = joined.select("conv_id", "loss", "formatted_chars", parsed_turns(F.col("whole")).alias("turns"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
