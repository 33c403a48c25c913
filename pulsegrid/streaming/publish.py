"""Records as a stream into the log."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.routing import Router
from pulsegrid.plans.ingest import publish_records
from pulsegrid.session import BATCH_STORAGE
from pulsegrid.sources.csv_records import ARRIVAL, order_rows
from pulsegrid.sources.message_log import MessageLog


def source_name(checkpoint: str) -> str:
    """The identity of a stream: its checkpoint, as a name that folders can have."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def spread_rows(batch: DataFrame) -> DataFrame:
    """The batch with its arrival order, on all cores: files that are read whole are few tasks.

    Rows are dealt by their place, so a task that runs again gets the same ones.
    """
    ordered = order_rows(batch)
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return ordered if batch.rdd.getNumPartitions() >= cores else ordered.repartition(cores, F.col(ARRIVAL)["row"])


def stream_publish(
    records: DataFrame,
    log_store: MessageLog,
    topic: str,
    checkpoint: str,
    order_by: tuple[str | Column, ...] = (ARRIVAL,),
    stamp: datetime | Column | None = None,
    restamped: bool = True,
    router: Router | None = None,
    sink: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    source: str | None = None,
) -> StreamingQuery:
    """Continuously restamp, key, route and append records.

    One device always goes to one partition and batches are numbered one after
    the other, so the order per device is kept. ``source``, by default the
    checkpoint, and the micro-batch id are the identity of a batch: a retried
    micro-batch is published once, and other streams may write to the same log,
    one after the other. A column called
    ``arrival`` orders the batch, and rows it ties keep the order of their file.
    ``sink`` takes the place of the log.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        if sink is not None:
            sink(batch, batch_id)
            return
        kept = spread_rows(batch).persist(BATCH_STORAGE)
        try:
            publish_records(log_store, kept, topic, order_by, stamp, restamped, router, batch_id, source or source_name(checkpoint))
        finally:
            kept.unpersist()

    return (
        records.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
