"""The log as a stream into the telemetry table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.errors import InvalidArgument
from pulsegrid.operators import log
from pulsegrid.plans.ingest import Collected, Sink, ingest_messages
from pulsegrid.schema import INGEST_METRICS, PUBLISHED
from pulsegrid.session import local_rows
from pulsegrid.sources.message_log import MessageLog
from pulsegrid.sources.telemetry_table import TelemetryTable
from pulsegrid.streaming.publish import source_name


# Publish batches that one micro-batch takes at most; their numbers go to the driver.
MAX_BATCHES = 256
POSITION = T.StructType(
    [T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("group", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("start_offset", "next_offset", "end_offset")]
)


def published_stream(log_store: MessageLog, max_batches: int = MAX_BATCHES) -> DataFrame:
    """Publish batches as they become visible; ``max_batches`` bounds a micro-batch."""
    # A publish writes exactly one index file.
    reader = log_store.spark.readStream.schema(PUBLISHED).option("maxFilesPerTrigger", max_batches)
    return reader.parquet(log_store.folder("published"))


def offset_turns(ends: dict[int, tuple[int, int]], committed: dict[int, int], most: int) -> Iterator[tuple[int, dict[int, tuple[int, int]]]]:
    """Ranges of offsets per partition that together cover ``ends``, ``most`` messages of a partition at a time.

    ``ends`` has where each partition begins and ends; what is ``committed``
    already is left out. Each turn comes with the messages that lie before it,
    which tells the turns of one micro-batch apart.
    """
    at = {p: max(first, min(committed.get(p, first), end)) for p, (first, end) in ends.items()}
    while open_ := {p: (at[p], min(at[p] + most, end)) for p, (_, end) in ends.items() if at[p] < end}:
        yield sum(at[p] - first for p, (first, _) in ends.items()), open_
        at |= {p: stop for p, (_, stop) in open_.items()}


def stream_collect(
    log_store: MessageLog,
    sink: TelemetryTable | Sink,
    topic: str,
    group: str,
    checkpoint: str,
    max_batches: int = MAX_BATCHES,
    rejects_folder: str | None = None,
    metrics_folder: str | None = None,
    trigger: dict | None = None,
    source: str | None = None,
    max_messages: int | None = None,
) -> StreamingQuery:
    """Continuously validate and insert what is published, then commit for ``group``.

    The stream follows the publish index, one small row per partition and batch,
    and reads the messages of those batches as an ordinary pruned scan. A batch
    is therefore seen whole and in order. Each group runs its own query with its
    own checkpoint; the commits it leaves drive lag and compaction. ``source``, by
    default the checkpoint, and the micro-batch id are the identity of an insert,
    so several collectors may fill one table, one after the other. The default
    trigger drains what is there and stops; ``POLL_TRIGGER`` keeps polling.

    ``max_messages`` bounds what is inserted and acknowledged at once, per
    partition, however much one publish stored: a micro-batch is then taken in
    turns, each an insert, a commit and a row of metrics of its own, and a restart
    goes on after the last commit.
    """
    if not group:
        raise InvalidArgument("group is required")
    if max_messages is not None and max_messages <= 0:
        raise InvalidArgument("max_messages must be > 0")
    name = source or source_name(checkpoint)

    def in_turns(mine: DataFrame, batches: list[int], batch_id: int) -> None:
        per_partition = mine.groupBy("partition").agg(F.min("first_offset"), F.max("next_offset"))
        ends = {r[0]: (r[1], r[2]) for r in per_partition.collect()}
        reached = log.current_commits(log_store.commits()).filter((F.col("topic") == topic) & (F.col("group") == group))
        committed = {r["partition"]: r["offset"] for r in reached.select("partition", "offset").collect()}
        messages = log_store.batch_messages(batches, topic)
        for before, turn in offset_turns(ends, committed, max_messages):
            rows = [(topic, p, group, begin, stop, ends[p][1]) for p, (begin, stop) in turn.items()]
            positions = local_rows(log_store.spark, rows, POSITION)
            # The bound is part of the identity: other turns may not pass for these.
            number = (batch_id << 32) + before
            done = ingest_messages(log.messages_at(messages, positions), sink, number, rejects_folder, source=f"{name}-{max_messages}")
            log_store.acknowledge(positions.select("topic", "partition", "group", F.col("next_offset").alias("offset")))
            if metrics_folder is not None:
                record_metrics(log_store, group, topic, done, metrics_folder)

    def process(index: DataFrame, batch_id: int) -> None:
        mine = index.filter(F.col("topic") == topic)
        batches = [r[0] for r in mine.select("batch_id").distinct().collect()]
        if not batches:
            return
        if max_messages is not None:
            in_turns(mine, batches, batch_id)
            return
        done = ingest_messages(log_store.batch_messages(batches, topic), sink, batch_id, rejects_folder, source=name)
        reached = mine.groupBy("topic", "partition").agg(F.max("next_offset").alias("offset"))
        log_store.acknowledge(reached.withColumn("group", F.lit(group)))
        if metrics_folder is not None:
            record_metrics(log_store, group, topic, done, metrics_folder)

    return (
        published_stream(log_store, max_batches)
        .writeStream.foreachBatch(process)
        .queryName(f"collect-{topic}-{group}")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def record_metrics(log_store: MessageLog, query: str, topic: str, done: Collected, folder: str) -> None:
    """One row per micro-batch; a retry replaces its row."""
    row = local_rows(
        log_store.spark,
        [(query, topic, done.batch_id, done.polled, done.rejected, done.inserted, done.duplicates)],
        T.StructType(INGEST_METRICS.fields[:-1]),
    )
    row.withColumn("recorded_at", F.current_timestamp()).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("query", "topic", "batch_id").parquet(folder)


def ingest_metrics(log_store: MessageLog, folder: str) -> DataFrame:
    """Recorded micro-batches."""
    return log_store.spark.read.schema(INGEST_METRICS).parquet(folder)


def ingest_rates(metrics: DataFrame) -> DataFrame:
    """Totals and shares per query."""
    total = {c: F.sum(c).alias(c) for c in ("polled", "rejected", "inserted", "duplicates")}
    return metrics.groupBy("query").agg(
        *total.values(),
        F.try_divide(F.sum("rejected"), F.sum("polled")).alias("reject_share"),
        F.try_divide(F.sum("duplicates"), F.sum("polled")).alias("duplicate_share"),
    )
