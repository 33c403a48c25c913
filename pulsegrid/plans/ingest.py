"""Batch pipelines: CSV files into the log, the log into the telemetry table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.records import KEY_COLUMN, record_json, restamp
from pulsegrid.operators.routing import Router
from pulsegrid.operators.validate import rejects, to_telemetry, validate_messages
from pulsegrid.session import BATCH_STORAGE
from pulsegrid.sources.csv_records import ARRIVAL, read_csv_records
from pulsegrid.sources.message_log import MessageLog, Published
from pulsegrid.sources.telemetry_table import TelemetryTable

# Batch size of a poll and pause between polls in the reference system.
POLL_BATCH = 10
POLL_TRIGGER = {"processingTime": "500 milliseconds"}

# A replacement for the telemetry table: takes rows and a batch id.
Sink = Callable[[DataFrame, int], None]

LOG_ORDER = ("partition", "offset")


@dataclass(frozen=True)
class Collected:
    """What became of a batch of messages."""

    batch_id: int
    polled: int
    rejected: int
    inserted: int | None
    duplicates: int | None


def publish_records(
    log_store: MessageLog,
    records: DataFrame,
    topic: str,
    order_by: tuple[str | Column, ...] = (ARRIVAL,),
    stamp: datetime | Column | None = None,
    restamped: bool = True,
    router: Router | None = None,
    batch_id: int | None = None,
    source: str = "",
) -> Published:
    """Restamp records, turn them into messages and append them to the log.

    ``order_by`` columns give the arrival order and are not part of the message
    if they are called ``arrival``.
    """
    stamped = restamp(records, stamp) if restamped else records
    body = [c for c in stamped.columns if c != ARRIVAL]
    key = F.col(KEY_COLUMN) if KEY_COLUMN in body else F.lit(None)
    order = {f"order_{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order_by)}
    # The record travels as one struct: its column names are the producer's.
    rows = stamped.select(
        key.cast("string").alias("key"),
        F.struct(*[F.col(f"`{c}`") for c in body]).alias("record"),
        *[column.alias(name) for name, column in order.items()],
    )
    return log_store.publish(rows, topic, list(order), router, batch_id, record_json(body, "record"), source)


def publish_csv(
    log_store: MessageLog, path: str, topic: str, stamp: datetime | None = None, multi_line: bool = False
) -> Published:
    """A CSV file or folder into the log, in file order."""
    records = read_csv_records(log_store.spark, path, multi_line=multi_line, arrival=True)
    return publish_records(log_store, records, topic, stamp=stamp)


def ingest_messages(
    messages: DataFrame,
    sink: TelemetryTable | Sink,
    batch_id: int,
    rejects_folder: str | None = None,
    encoding: str = "text",
    clustered: bool = True,
    source: str = "",
) -> Collected:
    """Decode, validate and insert one batch of log messages.

    The decoded batch is read three times (rejects, known keys, insert), so it
    is kept on executor disk for the duration of the call.
    """
    kept = validate_messages(messages, encoding=encoding).persist(BATCH_STORAGE)
    try:
        polled, rejected = kept.agg(F.count(F.lit(1)), F.count("reason")).first()
        if rejects_folder is not None and rejected:
            batch = {"source": F.lit(source), "batch_id": F.lit(batch_id).cast("bigint")}
            rejects(kept).withColumns(batch).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy(*batch).parquet(rejects_folder)
        rows = to_telemetry(kept, keep=LOG_ORDER)
        if not isinstance(sink, TelemetryTable):
            sink(rows, batch_id)
            return Collected(batch_id, polled, rejected, None, None)
        inserted = sink.insert(rows, LOG_ORDER, batch_id, clustered=clustered, source=source).count()
        return Collected(batch_id, polled, rejected, inserted, polled - rejected - inserted)
    finally:
        kept.unpersist()


def collect_batch(
    log_store: MessageLog,
    sink: TelemetryTable | Sink,
    topic: str,
    group: str,
    batch: int | None = POLL_BATCH,
    batch_id: int | None = None,
    rejects_folder: str | None = None,
) -> Collected:
    """One poll of every partition: read, validate, insert, then acknowledge.

    ``batch`` messages of each partition are polled, or with None all to the tail.
    Bad messages are acknowledged with the rest. If the call fails before the
    acknowledgement the same messages come again, and the insert ignores them.
    """
    if batch_id is None:
        batch_id = sink.next_batch_id() if isinstance(sink, TelemetryTable) else 0
    # Read and acknowledged positions are the same whatever happens meanwhile.
    reached = log_store.positions(topic, group, batch)
    done = ingest_messages(log_store.messages_at(reached, topic), sink, batch_id, rejects_folder)
    log_store.acknowledge(
        reached.filter(F.col("next_offset") > F.col("start_offset")).select(
            "topic", "partition", "group", F.col("next_offset").alias("offset")
        )
    )
    return done
