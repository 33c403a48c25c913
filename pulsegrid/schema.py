"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.errors import InvalidArgument, TopicExists, TopicNotFound
from pulsegrid.session import local_rows


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Column names of the long-form metric file.
METRIC_COLUMNS = (
    "timestamp",
    "metric_name",
    "gpu_id",
    "device",
    "uuid",
    "modelName",
    "Hostname",
    "container",
    "pod",
    "namespace",
    "value",
    "labels_raw",
)

TELEMETRY = _struct(
    ("gpu_id", T.StringType()),
    ("timestamp", T.TimestampType()),
    ("data", T.StringType()),
    ("created_at", T.TimestampType()),
    ("event_date", T.DateType()),
    ("batch_id", T.LongType()),
)

MESSAGE = _struct(
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("offset", T.LongType()),
    ("key", T.StringType()),
    ("payload", T.StringType()),
    ("payload_size", T.IntegerType()),
    ("append_ts", T.TimestampType()),
    ("batch_id", T.LongType()),
)

# One row per (topic, partition) a publish touched.
PUBLISHED = _struct(
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("first_offset", T.LongType()),
    ("next_offset", T.LongType()),
    ("batch_id", T.LongType()),
    ("source", T.StringType()),
    ("source_batch", T.LongType()),
)

INSERTED = _struct(
    ("batch_id", T.LongType()),
    ("source", T.StringType()),
    ("source_batch", T.LongType()),
)

COMMIT = _struct(
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("group", T.StringType()),
    ("offset", T.LongType()),
    ("commit_seq", T.LongType()),
)

# One row per partition and compaction.
COMPACTION = _struct(
    ("id", T.StringType()),
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("base_offset", T.LongType()),
    ("removed", T.LongType()),
    ("compaction_id", T.LongType()),
)

# One row per topic and reclaiming pass that deleted something.
RECLAIM = _struct(("topic", T.StringType()), ("up_to", T.LongType()))

# One row per partition and monitoring pass; ids are consecutive.
SNAPSHOT = _struct(
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("tail_offset", T.LongType()),
    ("watermark", T.LongType()),
    ("taken_at", T.TimestampType()),
    ("snapshot_id", T.LongType()),
)

# One row per micro-batch.
INGEST_METRICS = _struct(
    ("query", T.StringType()),
    ("topic", T.StringType()),
    ("batch_id", T.LongType()),
    ("polled", T.LongType()),
    ("rejected", T.LongType()),
    ("inserted", T.LongType()),
    ("duplicates", T.LongType()),
    ("recorded_at", T.TimestampType()),
)

REJECT = _struct(
    ("reason", T.StringType()),
    ("raw", T.StringType()),
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("offset", T.LongType()),
)

STORED_REJECT = T.StructType([*REJECT.fields, T.StructField("batch_id", T.LongType())])

DEFAULT_REPLICAS = 3


@dataclass(frozen=True)
class TopicSpec:
    """A topic: its name, partition count, ring replicas and per-partition capacity.

    ``capacity`` 0 takes the default given to :func:`topic_partitions`; zero or
    less after that means unlimited.
    """

    name: str
    partitions: int
    replicas: int = DEFAULT_REPLICAS
    capacity: int = 0

    def __post_init__(self):
        if not self.name or self.partitions <= 0:
            raise InvalidArgument("a topic needs a name and at least one partition")
        if self.replicas <= 0:
            object.__setattr__(self, "replicas", DEFAULT_REPLICAS)


def check_topics(specs: Iterable[TopicSpec]) -> list[TopicSpec]:
    """The specs as a list, refusing a repeated name."""
    out: dict[str, TopicSpec] = {}
    for spec in specs:
        if spec.name in out:
            raise TopicExists(spec.name)
        out[spec.name] = spec
    return list(out.values())


def find_topic(specs: Iterable[TopicSpec], name: str) -> TopicSpec:
    for spec in specs:
        if spec.name == name:
            return spec
    raise TopicNotFound(name)


def topic_partitions(
    spark: SparkSession, specs: Iterable[TopicSpec], default_capacity: int = 0
) -> DataFrame:
    """One row per partition of every topic: ``topic, partition, capacity``."""
    rows = [(s.name, s.partitions, s.capacity or default_capacity) for s in check_topics(specs)]
    kinds = _struct(("topic", T.StringType()), ("partitions", T.IntegerType()), ("capacity", T.LongType()))
    return local_rows(spark, rows, kinds).select(
        "topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"), "capacity"
    )
