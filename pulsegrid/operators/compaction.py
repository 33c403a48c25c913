"""Dropping what every group has read.

Compaction moves a partition's base up to its watermark. No message is
rewritten: reads start at the base, and files that lie wholly below it are
deleted by :meth:`pulsegrid.sources.message_log.MessageLog.reclaim`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.log import KEYS, live_messages
from pulsegrid.session import checked_broadcast

# Fixed value: default message threshold of the reference system.
DEFAULT_THRESHOLD = 100_000


def compaction_plan(watermarks: DataFrame) -> DataFrame:
    """New base and number of removed messages of every partition."""
    base = F.least("watermark", "end_offset")
    return watermarks.select(
        F.concat_ws("-", "topic", "partition").alias("id"),
        *KEYS,
        base.alias("base_offset"),
        (base - F.col("base_offset")).alias("removed"),
    )


def compact(log: DataFrame, watermarks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining messages, and the plan with the removed count per partition."""
    plan = compaction_plan(watermarks)
    return live_messages(log, plan.select(*KEYS, "base_offset")), plan


def compaction_triggers(stats: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Per topic, whether any partition is due.

    A partition is due with more than ``threshold`` messages (if positive) or
    more than half of it compactable. A threshold of 0 leaves only the second
    test, which then fires on the first compactable message.
    """
    half = int(threshold / 2)
    due = F.col("compactable_count") > half
    if threshold > 0:
        due = due | (F.col("message_count") > threshold)
    return stats.groupBy("topic").agg(F.bool_or(due).alias("due"))


def compaction_summary(plan: DataFrame) -> DataFrame:
    """Messages removed and partitions processed per topic, unchanged ones included."""
    return plan.groupBy("topic").agg(
        F.sum("removed").alias("messages_removed"), F.count(F.lit(1)).alias("partitions_compacted")
    )


def due_plan(watermarks: DataFrame, stats: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """The compaction plan of all partitions of the due topics."""
    due = compaction_triggers(stats, threshold).filter("due").select("topic")
    return compaction_plan(watermarks).join(checked_broadcast(due), "topic", "left_semi")
