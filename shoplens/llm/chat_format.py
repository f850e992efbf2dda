"""Multi-party chat formatting by perspective rotation, with built-in functions
only.

Every participant of a conversation gets a rendering in which that participant
is the assistant and all others are named users:

    <|im_start|>user name=ROLE\nTEXT<|im_end|>\n      (others)
    <|im_start|>assistant\nTEXT<|im_end|>\n           (the participant)

and the mask: the character spans of the participant's own texts (with the end
mark), on which a model is trained.

A rendering is given in blocks of ``BLOCK`` turns, so that a very long
conversation is neither gathered in one row nor in one task, whatever the
numbers of its turns; a conversation of up to ``BLOCK`` turns is one row per
participant. Offsets continue over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import materialize

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a block.
BLOCK = 256


def _plain(text: Column) -> Column:
    """Marks inside a text are broken up, so that no text can forge a turn."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    """A role as a name: one line, without marks."""
    return _plain(F.regexp_replace(role, r"\s+", "_"))


def _in_blocks(turns: DataFrame, block: int) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with ``block``: the place of the
    turn in its conversation, by number, role and text, over ``block``.

    Only conversations of more than a block need places. They are cut into
    ranges of their order, equal turns too; a place is the running number in
    a range and the sizes of the conversation's ranges before it.
    """
    order = ["turn", "role", "text", "uid"]
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    size = materialize(size.select(F.col("conv_id").alias("_conv")), "long-conversations")
    same = turns.conv_id.eqNullSafe(size["_conv"])
    short = turns.join(size, same, "left_anti").withColumn("block", F.lit(0).cast("long"))
    long = turns.join(size, same, "left_semi").withColumn("uid", F.monotonically_increasing_id())
    long = long.repartitionByRange("conv_id", *order).withColumn("_part", F.spark_partition_id())
    long = materialize(long, "long-turns")  # written once: the ranges hold for both readers
    parts = long.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("_part")) - F.col("n")
    parts = parts.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_at"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order))
    long = long.withColumn("_own", inside)
    long = long.join(parts, long.conv_id.eqNullSafe(parts["_conv"]) & (long["_part"] == parts["_at"]))
    place = F.col("_before") + F.col("_own") - 1
    return short.unionByName(long.withColumn("block", F.floor(place / block).cast("long")).select(*short.columns))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per (conversation, participant, block): conv_id, speaker,
    block, n_turns, n_own, start (characters of the rendering before the
    block), rendered, mask (spans [first, past) of the block's characters).

    Participants are the distinct roles of a conversation, whatever their
    spelling; a null role is a participant named ``unknown`` (and is the same
    as that role). A null text is empty. Turns are in order of their number,
    then role, then text; turns without a number come first. Blocks are of
    ``block`` turns in this order, the last of what is left, numbered from 0.
    Repeated rows are turns of their own. A null conversation id is one
    conversation. An empty table gives no rows. Other columns are not read.
    """
    t = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    who = t.select("conv_id", F.col("role").alias("speaker")).distinct()
    # at most ``block`` turns in a row
    blocks = _in_blocks(t, block).groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    both = blocks.join(who, blocks.conv_id.eqNullSafe(who.conv_id)).select(blocks.conv_id, "speaker", "block", "turns")

    body = F.transform("turns", lambda x: F.struct(
        (x["role"] == F.col("speaker")).alias("own"),
        F.when(x["role"] == F.col("speaker"), F.lit(f"{START}assistant\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), _name(x["role"]), F.lit("\n"))).alias("head"),
        F.concat(_plain(x["text"]), F.lit(END)).alias("text")))
    both = both.withColumn("body", body)
    rendered = F.array_join(F.transform("body", lambda x: F.concat(x["head"], x["text"], F.lit("\n"))), "")
    walked = F.aggregate(
        "body", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,past:int>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["head"]) + F.length(x["text"]) + 1).alias("at"),
            F.when(x["own"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(x["head"])).alias("first"),
                (s["at"] + F.length(x["head"]) + F.length(x["text"])).alias("past")))))
            .otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    both = both.select(
        "conv_id", "speaker", "block", F.size("body").alias("n_turns"),
        F.size(F.filter("body", lambda x: x["own"])).alias("n_own"), rendered.alias("rendered"), walked.alias("mask"))
    # offsets of the blocks: sums of lengths alone, a row per block
    before = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("start", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)).cast("long"))
