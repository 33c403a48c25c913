"""The message log as plain parquet folders.

``messages``     one folder per topic and publish batch, rows sorted by
                 (partition, offset) so that row-group statistics prune reads
``published``    offsets each batch took, per partition; written after the
                 messages, so a batch is visible as a whole or not at all
``commits``      consumer commits, appended
``compactions``  how far each partition was compacted, and what that removed
``reclaims``     up to which batch a topic's folders have been deleted
``rejects``      messages a publish refused, with the reason
``snapshots``    tails and watermarks over time, for monitoring

A batch is known by its topic, its source and its number there: several
producers, streams and topics share a log, and a batch that is published again
is found in the index and left as it is.

One writer per log at a time. Extents, lag, watermarks and compaction work on
the three small tables and never open a message file.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.errors import InvalidArgument
from pulsegrid.operators import compaction, log
from pulsegrid.operators.numbering import append_offsets, apply_capacity
from pulsegrid.operators.records import as_rejects
from pulsegrid.operators.routing import Router, route_messages, route_modulo
from pulsegrid.schema import (
    COMMIT,
    COMPACTION,
    MESSAGE,
    PUBLISHED,
    RECLAIM,
    SNAPSHOT,
    STORED_REJECT,
    TopicSpec,
    check_topics,
    find_topic,
    topic_partitions,
)
from pulsegrid.session import checked_broadcast, folder_exists, local_rows, partition_folder, pin_small, remove_folder

BATCH_KEYS = ["topic", "batch_id"]
# A poll that spans more publish batches than this scans the log by offset alone.
LISTED_BATCHES = 1000
MISSING_KEY = "missing_key"
PARTITION_RANGE = "partition_range"


def _any_refused(seen: Observation) -> bool:
    """Whether rows were set aside; likely, when the optimizer proved that nothing else is left."""
    try:
        return seen.get["refused"] > 0
    except Py4JJavaError:
        return True


@dataclass(frozen=True)
class Published:
    """What one publish stored and what it refused."""

    batch_id: int
    messages: DataFrame
    rejects: DataFrame


class MessageLog:
    def __init__(
        self, spark: SparkSession, root: str, topics: Iterable[TopicSpec], default_capacity: int = 0
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.topics = check_topics(topics)
        self.default_capacity = default_capacity

    # -- tables ------------------------------------------------------------

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        if not folder_exists(self.spark, self.folder(name)):
            return local_rows(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(self.folder(name))

    def published(self) -> DataFrame:
        return self._table("published", PUBLISHED)

    def commits(self) -> DataFrame:
        return self._table("commits", COMMIT)

    def compactions(self) -> DataFrame:
        return self._table("compactions", COMPACTION)

    def rejects(self) -> DataFrame:
        return self._table("rejects", STORED_REJECT)

    def reclaims(self) -> DataFrame:
        return self._table("reclaims", RECLAIM)

    def partitions(self) -> DataFrame:
        return topic_partitions(self.spark, self.topics, self.default_capacity)

    def bases(self) -> DataFrame:
        return self.compactions().groupBy(*log.KEYS).agg(F.max("base_offset").alias("base_offset"))

    def stored_messages(self, batches: DataFrame | None = None) -> DataFrame:
        """Messages of published batches (or of some of them), compacted ones included."""
        visible = (self.published() if batches is None else batches).select(*BATCH_KEYS).distinct()
        return self._table("messages", MESSAGE).join(checked_broadcast(visible), BATCH_KEYS, "left_semi").select(
            *MESSAGE.fieldNames()
        )

    def messages(self) -> DataFrame:
        """Live messages, absolute offsets."""
        return self._live(self.stored_messages(), self.topics)

    def _live(self, messages: DataFrame, topics: Sequence[TopicSpec]) -> DataFrame:
        """Messages at or above their base; bases of a log of ordinary width are literals that prune row groups."""
        known = self.bases().take(log.LITERAL_PARTITIONS + 1)
        if not known:
            return messages
        places = [(spec.name, p) for spec in topics for p in range(spec.partitions)]
        bases = {(r["topic"], r["partition"]): r["base_offset"] for r in known}
        if len(known) > log.LITERAL_PARTITIONS or len(places) > log.LITERAL_PARTITIONS:
            return log.live_messages(messages, self.bases())
        return messages.filter(log.at_or_above(places, bases))

    def _batch_folder(self, topic: str, batch_id: int) -> str:
        return f"{self.folder('messages')}/{partition_folder(self.spark, 'topic', topic)}/batch_id={int(batch_id)}"

    def batch_messages(self, batch_ids: Sequence[int], topic: str, live: bool = True) -> DataFrame:
        """Messages of given batches; only their folders are listed."""
        root = self.folder("messages")
        folders = [self._batch_folder(topic, b) for b in batch_ids]
        present = [f for f in folders if folder_exists(self.spark, f)]
        if not present:
            return local_rows(self.spark, [], MESSAGE)
        rows = self.spark.read.schema(MESSAGE).option("basePath", root).parquet(*present)
        rows = rows.select(*MESSAGE.fieldNames())
        return self._live(rows, [find_topic(self.topics, topic)]) if live else rows

    def extents(self) -> DataFrame:
        ends = self.published().groupBy(*log.KEYS).agg(F.max("next_offset").alias("end_offset"))
        return log.partition_extents(ends, self.partitions(), self.bases())

    def summary(self) -> DataFrame:
        ends = self.published().groupBy(*log.KEYS).agg(F.max("next_offset").alias("end_offset"))
        return log.topic_summary(ends, self.partitions(), self.bases())

    def watermarks(self, registered_groups: DataFrame | None = None) -> DataFrame:
        return log.offset_watermark(self.commits(), self.extents(), registered_groups)

    def stats(self) -> DataFrame:
        return log.partition_stats(self.watermarks())

    def lag(self) -> DataFrame:
        return log.consumer_lag(self.commits(), self.extents())

    def snapshots(self) -> DataFrame:
        return self._table("snapshots", SNAPSHOT)

    def take_snapshot(self) -> int:
        """Record tails and watermarks for :func:`pulsegrid.operators.log.stalled_watermarks`."""
        last = self.snapshots().agg(F.max("snapshot_id")).first()[0]
        number = 0 if last is None else last + 1
        self.watermarks().select(
            *log.KEYS,
            F.col("end_offset").alias("tail_offset"),
            "watermark",
            F.current_timestamp().alias("taken_at"),
            F.lit(number).cast("bigint").alias("snapshot_id"),
        ).coalesce(1).write.mode("append").parquet(self.folder("snapshots"))
        return number

    def stalled(self) -> DataFrame:
        """Partitions that grew between two snapshots while no group moved on."""
        return log.stalled_watermarks(self.snapshots())

    # -- publish -----------------------------------------------------------

    def next_batch_id(self) -> int:
        last = self.published().agg(F.max("batch_id")).first()[0]
        return 0 if last is None else last + 1

    def publish(
        self,
        messages: DataFrame,
        topic: str,
        order_by: Sequence[str | Column],
        router: Router | None = None,
        batch_id: int | None = None,
        payload: str | Column = "payload",
        source: str = "",
    ) -> Published:
        """Route, number and store ``key, payload`` rows in ``order_by`` order.

        ``payload`` may be an expression over the other columns. It is evaluated
        once, after the rows have been numbered.

        ``batch_id`` is the number of the batch at its ``source``. A batch that
        was published completely is not published again, so a retried
        micro-batch keeps its offsets; one that broke off was never visible and
        starts over. Rows without a key, outside the topic or beyond its
        capacity are set aside with a reason.
        """
        spec = find_topic(self.topics, topic)
        done = self._find_batch(topic, source, batch_id)
        if done is not None:
            return self._published_batch(topic, done)
        source_batch, batch_id = batch_id, self.next_batch_id()
        if source_batch is not None and not source:
            batch_id = max(batch_id, source_batch)
        content = (F.col(payload) if isinstance(payload, str) else payload).cast("string")
        chosen = router or route_modulo(spec.partitions)
        routed = route_messages(
            # A router only ever sees keys.
            messages, topic, lambda key: F.when(key != "", chosen(key)), spec.partitions, on_range_error="null"
        )
        reason = F.when(F.coalesce("key", F.lit("")) == "", MISSING_KEY).when(
            F.col("partition").isNull(), PARTITION_RANGE
        )
        seen = Observation()
        marked = routed.withColumn("reason", reason)
        counted = marked.observe(seen, F.count("reason").alias("refused"))
        accepted, source_rows = (df.filter(F.col("reason").isNull()).drop("reason") for df in (marked, counted))
        tails = (
            self.published()
            .filter(F.col("topic") == topic)
            .groupBy(*log.KEYS)
            .agg(F.max("next_offset").alias("tail_offset"))
        )
        remove_folder(self.spark, self._batch_folder(topic, batch_id))
        numbered = append_offsets(accepted, order_by, tails, source=source_rows)
        kept, refused = numbered.withColumn("payload", content), None
        kept = kept.select("topic", "partition", "offset", "key", "payload")
        if (spec.capacity or self.default_capacity) > 0:
            kept, refused = apply_capacity(kept, self.partitions(), self.bases())
        placed = [*BATCH_KEYS, "partition", "offset"]
        kept.select(
            "topic",
            "partition",
            "offset",
            "key",
            "payload",
            F.octet_length("payload").alias("payload_size"),
            F.current_timestamp().alias("append_ts"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
        ).sortWithinPartitions(*placed).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*BATCH_KEYS).parquet(self.folder("messages"))
        stored = self.batch_messages([batch_id], topic, live=False)
        # Refused rows cost a second pass over the input only if there are any.
        if _any_refused(seen):
            early = as_rejects(marked.filter(F.col("reason").isNotNull()).select("reason", content.alias("raw"), "topic"))
            refused = early if refused is None else refused.union(early)
        if refused is not None:
            self._write_batch(refused, "rejects", topic, batch_id)
        taken = stored.groupBy(*log.KEYS).agg(
            F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("next_offset"), F.count(F.lit(1)).alias("stored")
        )
        taken = pin_small(taken)
        # Nothing is visible yet: rows that changed between two evaluations leave no gap behind.
        if not taken.filter(F.col("next_offset") - F.col("first_offset") != F.col("stored")).isEmpty():
            raise InvalidArgument("the rows to publish differ from one evaluation to the next; persist them")
        taken = taken.drop("stored")
        if taken.isEmpty():
            # The batch exists, and takes no offsets.
            tail = tails.filter("partition = 0").first()
            at = tail["tail_offset"] if tail else 0
            taken = local_rows(self.spark, [(topic, 0, at, at)], T.StructType(PUBLISHED.fields[:4]))
        identity = {"source": F.lit(source), "source_batch": F.lit(source_batch).cast("bigint")}
        self._write_batch(taken.withColumns(identity).coalesce(1), "published", topic, batch_id)
        return self._published_batch(topic, batch_id)

    def _find_batch(self, topic: str, source: str, source_batch: int | None) -> int | None:
        """The batch that a source has published under a number."""
        if source_batch is None:
            return None
        same = (F.col("topic") == topic) & (F.col("source") == source) & (F.col("source_batch") == source_batch)
        return self.published().filter(same).agg(F.min("batch_id")).first()[0]

    def _published_batch(self, topic: str, batch_id: int) -> Published:
        refused = self.rejects().filter((F.col("topic") == topic) & (F.col("batch_id") == batch_id))
        return Published(batch_id, self.batch_messages([batch_id], topic, live=False), refused)

    def _write_batch(self, rows: DataFrame, name: str, topic: str, batch_id: int) -> None:
        """Store rows under the batch, replacing what an attempt that broke off left."""
        rows.withColumns({"topic": F.lit(topic), "batch_id": F.lit(batch_id).cast("bigint")}).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy(*BATCH_KEYS).parquet(self.folder(name))

    # -- consume -----------------------------------------------------------

    def positions(
        self, topic: str, group: str, batch: int | None = log.DEFAULT_BATCH, partition: int | None = None
    ) -> DataFrame:
        """Where the next poll of a group starts and ends, fixed at the time of the call."""
        spec = find_topic(self.topics, topic)
        if partition is not None:
            log.check_partition([spec], topic, partition)
        return pin_small(log.consume_positions(self.commits(), self.extents(), topic, group, batch, partition))

    def consume(
        self, topic: str, group: str, batch: int = log.DEFAULT_BATCH, partition: int | None = None
    ) -> DataFrame:
        """Next messages of a group from every partition, or from one."""
        return self.messages_at(self.positions(topic, group, batch, partition), topic)

    def messages_at(self, positions: DataFrame, topic: str) -> DataFrame:
        """Messages of fixed positions; only publish batches that overlap them are opened."""
        stop = F.col("next_offset").alias("stop_offset")
        wanted = (
            self.published()
            .join(positions.select(*log.KEYS, "start_offset", stop), log.KEYS)
            .filter((F.col("next_offset") > F.col("start_offset")) & (F.col("first_offset") < F.col("stop_offset")))
            .select("batch_id")
            .distinct()
            .take(LISTED_BATCHES + 1)
        )
        if len(wanted) > LISTED_BATCHES:
            source = self.stored_messages()
        else:
            source = self.batch_messages([r[0] for r in wanted], topic, live=False)
        return log.messages_at(source, positions)

    def next_commit_seq(self) -> int:
        last = self.commits().agg(F.max("commit_seq")).first()[0]
        return 0 if last is None else last + 1

    def acknowledge(self, positions: DataFrame, validate: bool = True) -> None:
        """Store ``topic, partition, group, offset`` rows; an invalid one fails the call."""
        seq = self.next_commit_seq()
        commits = positions.select(
            *log.KEYS, "group", "offset", F.lit(seq).cast("bigint").alias("commit_seq")
        )
        checked = pin_small(log.commit_errors(commits, self.extents(), validate))
        bad = checked.filter(F.col("error").isNotNull()).first()
        if bad is not None:
            raise InvalidArgument(f"{bad['topic']}-{bad['partition']}, group {bad['group']!r}: {bad['error']}")
        checked.drop("error").coalesce(1).write.mode("append").parquet(self.folder("commits"))

    def ack(self, topic: str, group: str, partition: int, offset: int) -> None:
        """Commit one absolute offset."""
        log.check_partition(self.topics, topic, partition)
        self.acknowledge(local_rows(self.spark, [(topic, partition, group, offset)], T.StructType(COMMIT.fields[:4])))

    # -- compaction --------------------------------------------------------

    def compact(self, topic: str | None = None, threshold: int | None = None) -> DataFrame:
        """Compact one topic, all topics, or with ``threshold`` the due ones.

        Returns the stored plan: removed messages per partition.
        """
        if topic is not None:
            find_topic(self.topics, topic)
        marks = pin_small(self.watermarks())
        if threshold is None:
            plan = compaction.compaction_plan(marks)
        else:
            plan = compaction.due_plan(marks, log.partition_stats(marks), threshold)
        if topic is not None:
            plan = plan.filter(F.col("topic") == topic)
        last = self.compactions().agg(F.max("compaction_id")).first()[0]
        number = 0 if last is None else last + 1
        plan.withColumn("compaction_id", F.lit(number).cast("bigint")).select(
            *COMPACTION.fieldNames()
        ).coalesce(1).write.mode("append").parquet(self.folder("compactions"))
        return self.compactions().filter(F.col("compaction_id") == number)

    def reclaim(self) -> int:
        """Delete message folders whose messages are all below their base.

        Batches up to a topic's frontier are gone already; a pass leaves out their
        rows of the index and never asks for their folders. The frontier moves after the
        deletions, so a pass that breaks off is repeated.
        """
        reached = self.reclaims().groupBy("topic").agg(F.max("up_to").alias("up_to"))
        below = F.col("next_offset") <= F.coalesce("base_offset", F.lit(0))
        batches = (
            self.published()
            .join(checked_broadcast(reached), "topic", "left")
            .filter(F.col("batch_id") > F.coalesce("up_to", F.lit(-1)))
            .join(checked_broadcast(self.bases()), log.KEYS, "left")
            .groupBy(*BATCH_KEYS)
            .agg(F.bool_and(below).alias("dead"))
        )
        removed = 0
        for row in batches.filter("dead").toLocalIterator():
            path = self._batch_folder(row["topic"], row["batch_id"])
            if folder_exists(self.spark, path):
                removed += remove_folder(self.spark, path)
        ends = batches.groupBy("topic").agg(
            F.coalesce(F.min(F.when(~F.col("dead"), F.col("batch_id"))) - 1, F.max("batch_id")).alias("up_to"), F.bool_or("dead").alias("moved")
        )
        moved = [(r["topic"], r["up_to"]) for r in ends.filter("moved").collect()]
        if moved:
            local_rows(self.spark, moved, RECLAIM).coalesce(1).write.mode("append").parquet(self.folder("reclaims"))
        return removed
