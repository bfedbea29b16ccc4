"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, only
that reply is trainable.  The output is two tables.  ``turns`` holds each rendered turn once
(``segment``, with the characters of the conversation before it).  The second one has a row per assistant turn with
the example's whole ``text``, context before target (:func:`spell_out`), and ``loss_start`` to ``loss_end``, the
trainable span in it; losses are read from these texts.  Spelled-out contexts take space with the square of a conversation's
turns, as the method does; they are made row by row, so a task holds one conversation and one example.
:func:`examples` gives the spans alone.

Template of a turn: ``<s>[INST role]``, line feed, text, ``[/INST]</s>``, line feed.  Inside
texts and roles a backslash is doubled, and the first character of anything that reads as a
mark (``<s>``, ``</s>``, ``[INST``, ``[/INST``, ``<<SYS>>``, ``<</SYS>>``) is followed by a
backslash; in roles line feeds and closing brackets are treated alike.  Reading a backslash
and the character after it as that character undoes this exactly, save that a mark's own
backslash yields nothing but the next character.

Null texts and roles are empty; null turns come first; equal turn numbers are ordered by role,
then text, as they are before escaping, and equal rows stand side by side; conversations
without an assistant turn have no example; an empty table gives none; texts of any length are whole.  Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidewheel.llm import shared

MARK = r"([<\[])(?=/?s>|/?INST|<SYS>>|</SYS>>)"
TAIL = "[/INST]</s>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), MARK, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.regexp_replace(escape(c), r"([\n\]])", r"\\$1")


def format_chat(turns: DataFrame) -> DataFrame:
    """``turns``: one row per turn, its segment, where its text lies in it, and the characters before it."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head, body = F.concat(F.lit("<s>[INST "), escape_role(F.col("role")), F.lit("]\n")), escape(F.col("text"))
    rows = rows.withColumns({"head": head, "body": body})
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    chars = F.length("head") + F.length("body") + F.lit(len(TAIL))
    before = F.sum(chars.cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))
    return rows.select(
        "conv_id", F.row_number().over(order).cast("long").alias("position"), F.concat("head", "body", F.lit(TAIL)).alias("segment"),
        (F.col("role") == "assistant").alias("is_target"), F.length("head").cast("long").alias("text_start"), F.length("body").cast("long").alias("text_chars"),
        F.coalesce(before, F.lit(0)).cast("long").alias("context_chars"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """``examples``: one row per assistant turn, with its context and its trainable span as ranges of characters."""
    start = F.col("context_chars") + F.col("text_start")
    return formatted.filter("is_target").select("conv_id", "position", "context_chars", start.alias("loss_start"), (start + F.col("text_chars")).alias("loss_end"))


def spell_out(formatted: DataFrame, expanded: DataFrame) -> DataFrame:
    """(conv_id, position, text, loss_start, loss_end): each example's whole text, its context before its target."""
    whole = formatted.groupBy(F.col("conv_id").alias("conv")).agg(F.array_sort(F.collect_list(F.struct(F.col("position").alias("at"), "segment"))).alias("turns"))
    joined = expanded.join(whole, F.col("conv_id").eqNullSafe(F.col("conv")))
    text = F.array_join(F.slice(F.col("turns")["segment"], F.lit(1), F.col("position").cast("int")), "")
    return joined.select("conv_id", "position", text.alias("text"), "loss_start", "loss_end")


def read_back(formatted: DataFrame, expanded: DataFrame) -> DataFrame:
    """Digests per conversation: turns from the segments, the loss text from the spelled-out examples."""
    said = F.expr("substring(segment, cast(text_start + 1 as int), cast(text_chars as int))")
    role = unescape(F.expr("substring(segment, 10, cast(text_start - 11 as int))"))
    learnt = unescape(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"))
    learnt = expanded.select(F.col("conv_id").alias("conv"), F.col("position").alias("at"), learnt.alias("loss"))
    rows = formatted.join(learnt, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("position") == F.col("at")), "left")
    turns = rows.select("conv_id", F.struct("position", role.alias("role"), unescape(said).alias("text"), F.coalesce("loss", F.lit("")).alias("loss")).alias("t"),
                        F.length("segment").cast("long").alias("chars"), F.col("at").isNotNull().alias("example"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_turns"), F.count_if("example").alias("n_examples"))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("t", lambda t: t["loss"]), "")
    return grouped.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )


def added_turns(spark: SparkSession) -> DataFrame:
    """The contract's conversation -7, both turns of which look like marks."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def format_and_read(turns: DataFrame) -> DataFrame:
    """Write turns and spelled-out examples to the shared folder and derive the digests from what was written."""
    formatted = shared.materialise(format_chat(turns), "chat-turns")
    return read_back(formatted, shared.materialise(spell_out(formatted, examples(formatted)), "chat-examples"))
