"""Periodic compaction: one pass, to be started by whatever schedules jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsegrid.operators.compaction import DEFAULT_THRESHOLD, compaction_summary
from pulsegrid.sources.message_log import MessageLog


def compact_due_topics(log_store: MessageLog, threshold: int = DEFAULT_THRESHOLD, reclaim: bool = True) -> DataFrame:
    """Check every topic, compact the due ones, delete what became unreachable.

    Returns messages removed and partitions processed per compacted topic.
    """
    plan = log_store.compact(threshold=threshold)
    if reclaim:
        log_store.reclaim()
    return compaction_summary(plan)
