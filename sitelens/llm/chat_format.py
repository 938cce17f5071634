"""Chat formatting by prefix-target expansion, DataFrame code only.

Every assistant turn becomes an example of its own: all turns before it are the
context, its reply is the only trainable text. A turn is written as
``<|turn|>role<|text|>text<|end|>``; in roles and texts a backslash becomes two
and ``<|`` becomes ``<\\|``, so no marker can occur inside them and dropping each
backslash before the next character restores the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_examples(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant"
) -> DataFrame:
    """Examples: conv_id, example, formatted, loss_start, loss_length.

    ``formatted`` holds all turns up to the target; the mask covers the
    characters ``[loss_start, loss_start + loss_length)``, the escaped reply.
    Turns that no reply follows form a last example with an empty mask, so a
    conversation without replies still gives one example. Turns are ordered by
    (turn, role, text), nulls first, so ties and repeated rows have a fixed
    order; null roles and texts count as empty, a null conv_id is one more
    conversation. An empty table gives no examples. A conversation is one value
    by its nature (its examples contain it whole); many conversations of any
    size are spread by conv_id.
    """
    conversations = df.select(
        df[conv_col].alias("_conv"), F.struct(
            df[turn_col].alias("turn"), F.coalesce(df[role_col], F.lit("")).alias("role"), F.coalesce(df[text_col], F.lit("")).alias("text")
        ).alias("_t"),
    ).groupBy("_conv").agg(F.sort_array(F.collect_list("_t")).alias("_turns"))
    written = F.transform("_turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == target_role).alias("target")
    ))
    parts = conversations.select("_conv", written.alias("_parts")).withColumn("_n", F.size("_parts"))
    # ends[i]: characters up to and including turn i
    ends = F.aggregate("_parts", F.array().cast("array<int>"), lambda acc, p: F.concat(
        acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(END))).cast("int"))
    ))
    whole = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    laid = parts.select("_conv", "_parts", "_n", ends.alias("_ends"), whole.alias("_whole"))
    targets = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_parts", i)["target"] | (i == F.col("_n") - 1))
    exploded = laid.select("_conv", "_ends", "_whole", F.posexplode(F.transform(targets, lambda i: F.struct(
        i.alias("i"), F.get("_parts", i)["target"].alias("target"), F.length(F.get("_parts", i)["body"]).alias("chars")
    ))).alias("example", "_e"))
    end = F.get("_ends", F.col("_e.i"))
    length = F.when(F.col("_e.target"), F.col("_e.chars")).otherwise(0)
    return exploded.select(
        F.col("_conv").alias("conv_id"), "example", F.substring("_whole", F.lit(1), end).alias("formatted"),
        (end - len(END) - length).alias("loss_start"), length.alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say: conv_id, turns array<struct<role,text>>, replies (the unescaped masked texts in order), formatted_chars."""
    masked = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))
    out = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("_last"),
        F.array_sort(F.collect_list(F.struct("example", masked.alias("m")))).alias("_masked"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    pieces = F.filter(F.split("_last", r"<\|end\|>"), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(TURN) + 1)), TEXT, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, TEXT) + len(TEXT))).alias("text"),
    ))
    replies = F.array_join(F.transform("_masked", lambda m: unescape(m["m"])), "")
    return out.select("conv_id", turns.alias("turns"), replies.alias("replies"), "formatted_chars")
