"""Reports and upkeep of the chat log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from balancier.operators.listing import PAGE_SIZE, Page, page_of

WINDOW = 20
SUMMARISE_EVERY = 10


def sessions_to_summarise(messages: DataFrame, summaries: DataFrame, at_least: int = SUMMARISE_EVERY) -> DataFrame:
    """Sessions with enough messages since their last summary."""
    last = summaries.groupBy("session_id").agg(F.max("created_at").alias("_last"))
    new = messages.join(last, "session_id", "left").filter(F.col("_last").isNull() | (F.col("created_at") > F.col("_last")))
    return new.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages")).filter(F.col("messages") >= at_least)


def last_messages(messages: DataFrame, keep: int = WINDOW) -> DataFrame:
    """The latest messages of each session; every task trims to ``keep`` before the shuffle."""
    order = Window.partitionBy("session_id").orderBy(F.desc("sequence_no"))
    return messages.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).drop("_n")


def trimmed_counts(messages: DataFrame, keep: int = WINDOW) -> DataFrame:
    """How many messages trimming deletes in each session."""
    n = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("session_id", F.greatest(F.col("n") - keep, F.lit(0)).alias("deleted"))


def conversation_text(messages: DataFrame, part: int) -> DataFrame:
    """"role: content" lines in order: (session_id, part_no, messages, text).

    Sequence numbers 0 to part-1 make part 0, and so on; the parts in order are the
    whole conversation. One group never holds more than ``part`` messages.
    """
    number = F.floor(F.col("sequence_no") / part).cast("bigint").alias("part_no")
    line = F.struct("sequence_no", F.concat("role", F.lit(": "), "content").alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda m: m["line"]), "\n")
    return messages.groupBy("session_id", number).agg(F.count(F.lit(1)).alias("messages"), text.alias("text"))


def last_sequence(messages: DataFrame) -> DataFrame:
    """Message count and highest sequence number of each session."""
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.coalesce(F.max("sequence_no"), F.lit(0)).alias("max_sequence_no")
    )


def session_page(sessions: DataFrame, user_id: str, status: str = "ACTIVE", page: int = 0, size: int = PAGE_SIZE) -> Page:
    """A page of a user's sessions, the latest active first."""
    mine = sessions.filter((F.col("user_id") == user_id) & (F.col("status") == status))
    return page_of(mine, [F.col("last_message_at").desc_nulls_last(), "id"], page, size)
