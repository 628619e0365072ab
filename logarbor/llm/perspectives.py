"""Multi-party perspective rotation: one training dialogue for each participant of a conversation.

For participant p every message of p is rendered as the assistant's, every other
speaker's as a user with a name, system messages as system. The mask has ones on p's
texts and their end marks. DataFrame functions only.

A conversation is cut into segments of ``SEGMENT_TURNS`` turn numbers, so that a huge
one is many bounded groups; a segment with more than ``MAX_MESSAGES`` messages (turn
numbers that repeat) is cut further in the order of its messages, so that its parts,
one after the other, are the whole dialogue. A row of the result is one part of a
segment seen by one participant. Texts are shuffled to their segments (those of such
large segments are sorted before), and a part once more to the participants of its
conversation, who come from a narrow scan, unless these are few enough to be sent to it.

Nulls: a null text is empty, a null role is the speaker 'unknown', a null turn stands
before turn 0, a null conv_id is one conversation of its own. A row that repeats one of
the same turn is the same message; rows without a turn are messages of their own, equal
ones as well. Messages of one turn follow by role, then text. A conversation with only
system messages has no participant and gives no row. An empty table gives an empty
result. Markers inside texts are broken up, so no text can forge a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logarbor.llm.tools import small, written

SEGMENT_TURNS = 64
MAX_MESSAGES = 4096
SORT_ROWS = 65536      # messages of large segments in a sorted partition, about
SYSTEM_ROLES = ("system",)
START, END = "<|im_start|>", "<|im_end|>\n"


def _messages(conversations: DataFrame) -> DataFrame:
    turn = F.coalesce(F.col("turn").cast("bigint"), F.lit(-1))
    return conversations.select(
        F.col("conv_id").cast("bigint"), F.floor(turn / SEGMENT_TURNS).alias("segment"), turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        # tells equal messages without a turn apart; it only breaks ties between equal texts
        F.when(F.col("turn").cast("bigint").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)).alias("copy"))


def _in_order(messages: DataFrame, rows: int) -> DataFrame:
    """The distinct messages with ``part``: their position in the order of their segment, div ``MAX_MESSAGES``.

    A position is the one in its sorted partition and the count of the segment's messages in earlier partitions.
    """
    keys = ["conv_id", "segment", "turn", "role", "text", "copy"]
    ordered = written(messages.distinct().repartitionByRange(max(1, -(-rows // SORT_ROWS)), *keys)
                      .sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("pid", F.shiftright("at", 33))
    earlier = Window.partitionBy("conv_id", "segment").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = (ordered.groupBy("conv_id", "segment", "pid").agg(F.min("at").alias("first"), F.count("*").alias("n"))
            .select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.col("pid").alias("p"),
                    (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")))
    runs = written(runs)
    return (ordered.join(small(runs, runs.count()), F.col("conv_id").eqNullSafe(F.col("c"))
                         & (F.col("segment") == F.col("s")) & (F.col("pid") == F.col("p")))
            .withColumn("part", F.floor((F.col("at") + F.col("shift")) / MAX_MESSAGES))
            .select(*keys, "part"))


def _segments(messages: DataFrame) -> DataFrame:
    """One row for each part of a segment: its messages in order."""
    large = written(messages.groupBy("conv_id", "segment").agg(F.count("*").alias("n"))
                    .where(F.col("n") > MAX_MESSAGES)
                    .select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "n"))
    count, rows = large.agg(F.count("*"), F.sum("n")).first()
    cut = messages.withColumn("part", F.lit(0).cast("bigint"))
    if count:
        among = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))
        cut = (cut.join(small(large, count), among, "left_anti")
               .unionByName(_in_order(messages.join(small(large, count), among, "left_semi"), rows)))
    return cut.groupBy("conv_id", "segment", "part").agg(
        F.array_sort(F.collect_set(F.struct("turn", "role", "text", "copy"))).alias("messages"))


def _head(role: Column, participant: Column) -> Column:
    name = F.regexp_replace(role, r"\s+", "_")
    return F.concat(F.lit(START), F.when(role.isin(*SYSTEM_ROLES), F.lit("system"))
                    .when(role == participant, F.lit("assistant"))
                    .otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, participant, segment, part, n_messages, n_own, text, mask.

    ``mask`` is run lengths over the characters of ``text``, 'length:bit' joined by commas.
    """
    messages = _messages(conversations)
    people = (messages.where(~F.col("role").isin(*SYSTEM_ROLES))
              .select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct())
    seen = _segments(messages).join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    heads = F.transform("messages", lambda m: F.struct(
        _head(m["role"], F.col("participant")).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"),
        (m["role"] == F.col("participant")).cast("int").alias("own")))
    parts = seen.withColumn("parts", heads)
    runs = F.transform("parts", lambda p: F.concat(
        F.length(p["head"]).cast("string"), F.lit(":0,"), F.length(p["body"]).cast("string"), F.lit(":"),
        p["own"].cast("string")))
    return parts.select(
        "conv_id", "participant", "segment", "part", F.size("parts").cast("bigint").alias("n_messages"),
        F.size(F.filter("parts", lambda p: p["own"] == 1)).cast("bigint").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.array_join(runs, ",").alias("mask"))
