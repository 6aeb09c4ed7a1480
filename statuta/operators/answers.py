"""Conversation turns and prompts as columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions import fixed_values as V
from statuta.functions.text import any_of, collapsed, naming, strip


def chat_title(messages: DataFrame, default: str = V.DEFAULT_CHAT_TITLE) -> DataFrame:
    """(conv_id, title): first user message, cut at 80 characters, where the title is still the default."""
    first = (
        messages.filter(F.col("role") == "user")
        .groupBy("conv_id", "title")
        .agg(F.min_by("text", "turn").alias("text"))
    )
    cut = F.concat(F.left("text", F.lit(80)), F.when(F.length("text") > 80, F.lit("...")).otherwise(F.lit("")))
    return first.select("conv_id", F.when(F.col("title") == default, cut).otherwise(F.col("title")).alias("title"))


def follow_up_rewrite(messages: DataFrame, markers: list[str] = V.FOLLOW_UP_MARKERS) -> DataFrame:
    """User turns with ``rewritten``: a turn that leans on an earlier one carries that one along.

    The earlier question is the latest user turn whose normalised text differs. Turns with
    the same text that follow each other form a block; the turn before the block is it.
    """
    users = messages.filter(F.col("role") == "user").withColumn("norm", collapsed(F.col("text")))
    order = W.partitionBy("conv_id").orderBy("turn")
    filled = users.withColumn("held", F.when(strip(F.col("text")) != "", F.struct("norm", "text")))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    with_last = filled.withColumn("last", F.last("held", ignorenulls=True).over(before))
    # where a turn repeats the one before, the turn before that block still counts
    starts = with_last.withColumn(
        "entry", F.when(F.col("last").isNotNull() & (F.col("last.norm") != F.col("norm")) & F.col("held").isNotNull(), F.col("last"))
    )
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    known = starts.withColumn("previous", F.last("entry", ignorenulls=True).over(upto))
    previous = F.when(F.col("last.norm") != F.col("norm"), F.col("last")).otherwise(F.col("previous"))
    use = any_of(F.col("norm"), markers) & (F.col("norm") != "") & previous.isNotNull()
    text = F.concat(
        F.lit(V.FOLLOW_UP_BEFORE), strip(previous["text"]), F.lit("\n"), F.lit(V.FOLLOW_UP_AFTER), F.col("text")
    )
    return known.select("conv_id", "turn", F.when(F.coalesce(use, F.lit(False)), text).otherwise(F.col("text")).alias("rewritten"))


def history_window(messages: DataFrame, size: int = 20) -> DataFrame:
    """Last ``size`` messages per conversation, in ascending order of ``position``."""
    newest = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = messages.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= size)
    return kept.withColumn("position", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).drop("age")


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit(V.PROMPT_CONTEXT), context, F.lit("\n\n" + V.PROMPT_QUESTION), question,
        F.lit("\n\n" + V.PROMPT_REQUIREMENTS + V.PROMPT_JSON),
    )


def fitted(prompt: Column, system: Column, context_length: int, max_tokens: int) -> Column:
    """struct(prompt, system) within the limit; the context part is cut, the question kept."""
    limit = int((context_length - max_tokens - 100) * 1.5)
    half = limit // 2
    room = F.lit(limit) - F.length(system)
    tight = room < 200
    over = F.length(system) + F.length(prompt) > limit
    allowed = F.when(tight, F.lit(half)).otherwise(room)

    def cut(row: Column) -> Column:
        p, n = row["prompt"], row["allowed"]
        # characters from the last marker on: the piece after it, and the marker
        pieces = F.split(p, V.PROMPT_MARKER)
        tail = F.concat(F.lit(V.PROMPT_MARKER), F.element_at(pieces, -1))
        at = F.length(p) - F.length(tail)
        left = n - F.length(tail)
        has_marker = (F.size(pieces) > 1) & (at > 0)
        short = F.when(
            has_marker & (left > 100),
            F.concat(F.left(F.left(p, at), left), F.lit(V.PROMPT_CUT), tail),
        ).otherwise(F.left(p, n))
        return F.when(F.length(p) > n, short).otherwise(p)

    row = F.struct(prompt.alias("prompt"), allowed.alias("allowed"))
    return F.struct(
        F.when(over, naming(row, cut)).otherwise(prompt).alias("prompt"),
        F.when(over & tight, F.left(system, F.lit(half))).otherwise(system).alias("system"),
    )
