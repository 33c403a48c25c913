"""The message log as DataFrames: extents, reads, commits, lag, statistics.

A log table has ``topic, partition, offset, key, payload``. Stored offsets are
absolute and never change. ``bases`` (``topic, partition, base_offset``) says
how far each partition has been compacted; numbers shown to users are relative
to it, which is what a log that renumbers itself after compaction would show.
Frames with one row per (topic, partition) are called *partition frames* here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.errors import InvalidArgument, OffsetOutOfRange, PartitionOutOfRange
from pulsegrid.operators.numbering import LOG_KEYS
from pulsegrid.schema import TopicSpec, find_topic
from pulsegrid.session import checked_broadcast

KEYS = list(LOG_KEYS)
# Up to this many partitions, start positions become pushed-down predicates.
LITERAL_PARTITIONS = 256
DEFAULT_BATCH = 1


def check_partition(specs: Iterable[TopicSpec], topic: str, partition: int) -> TopicSpec:
    spec = find_topic(specs, topic)
    if not 0 <= partition < spec.partitions:
        raise PartitionOutOfRange(f"{topic}-{partition}")
    return spec


def with_base(frame: DataFrame, bases: DataFrame | None) -> DataFrame:
    """Add ``base_offset`` (0 where nothing was compacted)."""
    if bases is None:
        return frame.withColumn("base_offset", F.lit(0).cast("bigint"))
    joined = frame.join(checked_broadcast(bases.select(*KEYS, F.col("base_offset").alias("_base"))), KEYS, "left")
    return joined.withColumn("base_offset", F.coalesce("_base", F.lit(0))).drop("_base")


def live_messages(log: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Messages that compaction has not removed."""
    if bases is None:
        return log
    return with_base(log, bases).filter(F.col("offset") >= F.col("base_offset")).select(*log.columns)


def at_or_above(places: Iterable[tuple[str, int]], bases: dict[tuple[str, int], int]) -> Column:
    """Whether a message of one of these partitions lies at or above the partition's base.

    Every alternative names the offset, so that the scan can use its part of them.
    """
    wanted = F.lit(False)
    for topic, partition in places:
        wanted |= _in_partition(topic, partition) & (F.col("offset") >= bases.get((topic, partition), 0))
    return wanted


def partition_ends(log: DataFrame) -> DataFrame:
    """Absolute end offset of every partition that holds messages."""
    return log.groupBy(*KEYS).agg((F.max("offset") + 1).alias("end_offset"))


def partition_extents(
    ends: DataFrame, partitions: DataFrame, bases: DataFrame | None = None
) -> DataFrame:
    """One row per partition: ``base_offset, end_offset, message_count``.

    ``ends`` comes from :func:`partition_ends` or, without touching a message,
    from the publish index. Partitions without messages appear with zeros.
    """
    listed = with_base(partitions.select(*KEYS), bases)
    end = F.greatest(F.coalesce("end_offset", F.lit(0)), F.col("base_offset"))
    return listed.join(ends.select(*KEYS, "end_offset"), KEYS, "left").select(
        *KEYS, "base_offset", end.alias("end_offset"), (end - F.col("base_offset")).alias("message_count")
    )


def topic_summary(ends: DataFrame, partitions: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Topics with partition and message counts; empty topics are listed too."""
    return (
        partition_extents(ends, partitions, bases)
        .groupBy("topic")
        .agg(F.count(F.lit(1)).alias("partitions"), F.sum("message_count").alias("messages"))
    )


def tails(extents: DataFrame) -> DataFrame:
    """Next offset to assign, the seed of an append."""
    return extents.select(*KEYS, F.col("end_offset").alias("tail_offset"))


# -- reads ---------------------------------------------------------------------


def _extent_of(extents: DataFrame, topic: str, partition: int) -> tuple[int, int]:
    row = extents.filter((F.col("topic") == topic) & (F.col("partition") == partition)).first()
    if row is None:
        raise PartitionOutOfRange(f"{topic}-{partition}")
    return row["base_offset"], row["end_offset"]


def _in_partition(topic: str, partition: int) -> Column:
    return (F.col("topic") == topic) & (F.col("partition") == partition)


def read_from(
    log: DataFrame, extents: DataFrame, topic: str, partition: int, offset: int, max_messages: int = 0
) -> DataFrame:
    """Messages from a relative offset on, at most ``max_messages`` (0 = all).

    Reading at the tail is empty; beyond it, or below 0, is an error. The window
    reaches the scan as literals.
    """
    base, end = _extent_of(extents, topic, partition)
    if offset < 0 or base + offset > end:
        raise OffsetOutOfRange(f"{topic}-{partition}: offset {offset} outside [0, {end - base}]")
    rows = log.filter(_in_partition(topic, partition) & (F.col("offset") >= base + offset))
    if max_messages > 0:
        rows = rows.filter(F.col("offset") < base + offset + max_messages)
    return rows.orderBy("offset")


def get_message(log: DataFrame, extents: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    """The message at a relative offset; outside the log is an error."""
    base, end = _extent_of(extents, topic, partition)
    if offset < 0 or base + offset >= end:
        raise OffsetOutOfRange(f"{topic}-{partition}: no message at {offset}")
    return log.filter(_in_partition(topic, partition) & (F.col("offset") == base + offset))


# -- commits -------------------------------------------------------------------


def current_commits(commits: DataFrame) -> DataFrame:
    """Last commit per partition and group. The last write wins, so a group may rewind."""
    return commits.groupBy(*KEYS, "group").agg(F.max_by("offset", "commit_seq").alias("offset"))


def commit_errors(commits: DataFrame, extents: DataFrame, validate: bool = True) -> DataFrame:
    """Add ``error`` to (absolute) commits: NULL when the commit may be stored.

    ``validate=False`` skips the range check, as a group that keeps its own
    offsets does.
    """
    placed = commits.join(checked_broadcast(extents.select(*KEYS, "base_offset", "end_offset")), KEYS, "left")
    error = F.when(F.coalesce("group", F.lit("")) == "", "empty group").when(
        F.col("end_offset").isNull(), "partition out of range"
    )
    if validate:
        error = error.when(
            ~F.coalesce(F.col("offset").between(F.col("base_offset"), F.col("end_offset")), F.lit(False)),
            "offset out of range",
        )
    return placed.withColumn("error", error).select(*commits.columns, "error")


def valid_commits(commits: DataFrame, extents: DataFrame, validate: bool = True) -> DataFrame:
    return commit_errors(commits, extents, validate).filter(F.col("error").isNull()).drop("error")


def committed_offsets(commits: DataFrame, extents: DataFrame, group: str) -> DataFrame:
    """A group's absolute offset in every partition, the base where it has none."""
    if not group:
        raise InvalidArgument("group is required")
    mine = current_commits(commits.filter(F.col("group") == group)).select(*KEYS, F.col("offset").alias("_at"))
    return extents.join(mine, KEYS, "left").select(
        *KEYS,
        F.lit(group).alias("group"),
        "base_offset",
        "end_offset",
        # A commit below the base was overtaken by compaction.
        F.greatest(F.coalesce("_at", F.col("base_offset")), F.col("base_offset")).alias("offset"),
    )


def consume_positions(
    commits: DataFrame,
    extents: DataFrame,
    topic: str,
    group: str,
    batch: int | None = DEFAULT_BATCH,
    partition: int | None = None,
) -> DataFrame:
    """Where one poll of every partition starts and where the next one would.

    Without ``batch`` the poll reaches to the tail.
    """
    if batch is not None and batch <= 0:
        raise InvalidArgument("batch must be > 0")
    mine = extents.filter(F.col("topic") == topic)
    if partition is not None:
        mine = mine.filter(F.col("partition") == partition)
    at = committed_offsets(commits, mine, group)
    end = F.col("end_offset")
    stop = F.greatest(end if batch is None else F.least(F.col("offset") + batch, end), F.col("offset"))
    return at.select(
        *KEYS, "group", F.col("offset").alias("start_offset"), stop.alias("next_offset"), "end_offset"
    )


def messages_at(log: DataFrame, positions: DataFrame) -> DataFrame:
    """The messages between ``start_offset`` and ``next_offset`` of every position.

    Adds ``next_offset``, the offset to acknowledge. A topic of ordinary width
    is read by literal ranges that prune row groups; a very wide one by a join.
    """
    beyond = F.col("start_offset") > F.col("end_offset")
    head = positions.orderBy(beyond.desc(), *KEYS).limit(LITERAL_PARTITIONS + 1).collect()
    if head and head[0]["start_offset"] > head[0]["end_offset"]:
        first = head[0]
        raise OffsetOutOfRange(f"{first['topic']}-{first['partition']}: group {first['group']} is past the tail")
    if len(head) > LITERAL_PARTITIONS:
        joined = log.join(checked_broadcast(positions.select(*KEYS, "start_offset", "next_offset")), KEYS)
        inside = (F.col("offset") >= F.col("start_offset")) & (F.col("offset") < F.col("next_offset"))
        return joined.filter(inside).drop("start_offset").select(*log.columns, "next_offset")
    wanted, following = F.lit(False), F.lit(None).cast("bigint")
    for row in head:
        here = _in_partition(row["topic"], row["partition"])
        wanted |= here & (F.col("offset") >= row["start_offset"]) & (F.col("offset") < row["next_offset"])
        following = F.when(here, F.lit(row["next_offset"]).cast("bigint")).otherwise(following)
    return log.filter(wanted).withColumn("next_offset", following)


def consume_batch(
    log: DataFrame,
    commits: DataFrame,
    extents: DataFrame,
    topic: str,
    group: str,
    batch: int = DEFAULT_BATCH,
    partition: int | None = None,
) -> DataFrame:
    """The next ``batch`` messages of every partition (or one), not acknowledged."""
    return messages_at(log, consume_positions(commits, extents, topic, group, batch, partition))


# -- watermarks, lag, statistics -----------------------------------------------


def offset_watermark(
    commits: DataFrame, extents: DataFrame, registered_groups: DataFrame | None = None
) -> DataFrame:
    """Smallest committed offset per partition over the groups that committed.

    A partition nobody committed stays at its base. ``registered_groups``
    (``topic, group``) makes groups count from their registration on: one that
    has not committed yet holds the watermark.
    """
    current = current_commits(commits)
    if registered_groups is not None:
        current = (
            extents.select(*KEYS, F.col("base_offset").alias("_base"))
            .join(registered_groups.select("topic", "group").distinct(), "topic")
            .join(current, [*KEYS, "group"], "full")
            .select(*KEYS, "group", F.coalesce("offset", "_base").alias("offset"))
        )
    lowest = current.groupBy(*KEYS).agg(F.min("offset").alias("_low"))
    return extents.join(lowest, KEYS, "left").select(
        *KEYS,
        "base_offset",
        "end_offset",
        "message_count",
        F.greatest(F.coalesce("_low", F.col("base_offset")), F.col("base_offset")).alias("watermark"),
    )


def partition_stats(watermarks: DataFrame) -> DataFrame:
    """Monitoring view, in relative offsets."""
    behind = F.col("watermark") - F.col("base_offset")
    return watermarks.select(
        F.concat_ws("-", "topic", "partition").alias("id"),
        *KEYS,
        "message_count",
        F.col("message_count").alias("tail_offset"),
        behind.alias("min_consumer_offset"),
        behind.alias("compactable_count"),
    )


def consumer_lag(commits: DataFrame, extents: DataFrame) -> DataFrame:
    """Messages every committed group has still to read."""
    return (
        current_commits(commits)
        .join(checked_broadcast(extents), KEYS)
        .select(
            *KEYS,
            "group",
            (F.col("end_offset") - F.greatest(F.col("offset"), F.col("base_offset"))).alias("lag"),
        )
    )


def stalled_watermarks(snapshots: DataFrame) -> DataFrame:
    """Partitions whose tail grew since the previous snapshot while the watermark stood still.

    ``snapshots`` is ``topic, partition, snapshot_id, tail_offset, watermark``
    with consecutive ids. Joining each snapshot to its predecessor needs no
    ordered history of a partition in one task.
    """
    previous = snapshots.select(
        *KEYS,
        (F.col("snapshot_id") + 1).alias("snapshot_id"),
        F.col("tail_offset").alias("_tail"),
        F.col("watermark").alias("_watermark"),
    )
    grew = F.col("tail_offset") > F.col("_tail")
    return (
        snapshots.join(previous, [*KEYS, "snapshot_id"])
        .filter(grew & (F.col("watermark") == F.col("_watermark")))
        .select(*KEYS, "snapshot_id", "watermark", (F.col("tail_offset") - F.col("_tail")).alias("grown_by"))
    )


def retained_bytes(log: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Payload bytes per topic that the slowest group keeps alive, and the
    documented upper bound: largest lag x mean size x partitions."""
    per_topic = watermarks.groupBy("topic").agg(
        F.max(F.col("end_offset") - F.col("watermark")).alias("_lag"), F.count(F.lit(1)).alias("_partitions")
    )
    held = F.col("offset") >= F.col("watermark")
    # A stored size spares the scan the payload itself.
    size = F.col("payload_size") if "payload_size" in log.columns else F.octet_length("payload")
    measured = (
        log.join(checked_broadcast(watermarks.select(*KEYS, "watermark", "base_offset")), KEYS)
        .filter(F.col("offset") >= F.col("base_offset"))
        .groupBy("topic")
        .agg(
            F.coalesce(F.sum(F.when(held, size)), F.lit(0)).alias("retained_bytes"),
            F.sum(size).alias("_bytes"),
            F.count(F.lit(1)).alias("_messages"),
        )
    )
    bound = F.col("_lag") * F.col("_partitions") * (F.col("_bytes") / F.col("_messages"))
    return per_topic.join(measured, "topic", "left").select(
        "topic",
        F.coalesce("retained_bytes", F.lit(0)).alias("retained_bytes"),
        F.coalesce(bound, F.lit(0.0)).alias("bound_bytes"),
    )


# -- relative view -------------------------------------------------------------


def rebase_messages(log: DataFrame, bases: DataFrame | None) -> DataFrame:
    """Live messages with ``offset`` counted from the base."""
    return (
        with_base(log, bases)
        .filter(F.col("offset") >= F.col("base_offset"))
        .withColumn("offset", F.col("offset") - F.col("base_offset"))
        .select(*log.columns)
    )


def rebase_commits(commits: DataFrame, bases: DataFrame | None) -> DataFrame:
    """Current commits counted from the base, never below 0."""
    current = with_base(current_commits(commits), bases)
    return current.select(
        *KEYS, "group", F.greatest(F.col("offset") - F.col("base_offset"), F.lit(0)).alias("offset")
    )
