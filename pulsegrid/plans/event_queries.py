"""Every operator, run over the ``events`` table.

``t`` below is the events table seen as telemetry: one device per user, the
event type as metric name, ``props`` as the JSON document. The log holds all
events in topic ``telemetry`` (3 partitions) and the errors once more in topic
``alerts`` (2 partitions), in ``event_id`` order; topic ``idle`` is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import (
    canonical_json,
    decode_payload,
    encode_payload,
    fnv1a32,
    json_number,
    parse_rfc3339,
    strict_json,
)
from pulsegrid.operators import compaction, dedup, log, numbering, records, routing, telemetry, validate
from pulsegrid.plans.ingest import collect_batch, publish_csv, publish_records
from pulsegrid.plans.response import get_gpu_telemetry, telemetry_of_all
from pulsegrid.schema import METRIC_COLUMNS, TopicSpec, topic_partitions
from pulsegrid.session import local_rows, pin_small, prepare_session, work_folder
from pulsegrid.sources.csv_records import read_csv_records, read_metric_rows, stream_csv_records
from pulsegrid.sources.message_log import MessageLog
from pulsegrid.sources.telemetry_table import TelemetryTable
from pulsegrid.streaming.collect import ingest_metrics, ingest_rates, stream_collect
from pulsegrid.streaming.compaction import compact_due_topics
from pulsegrid.streaming.publish import stream_publish
from pulsegrid.streaming.rollup import continuous_average, latest_average, telemetry_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GPU = "gpu-0001"
START = datetime(2024, 1, 10, tzinfo=timezone.utc)
END = datetime(2024, 1, 20, tzinfo=timezone.utc)
STAMP = datetime(2026, 4, 10, 15, 0, tzinfo=timezone.utc)
TOPICS = [TopicSpec("telemetry", 3), TopicSpec("alerts", 2), TopicSpec("idle", 1)]
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def query(fn: Query) -> Query:
    """Register a query; timestamps leave as zone-less UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(prepare_session(spark), sf_dir)
        return df.select(
            *[
                F.col(f.name).cast("timestamp_ntz").alias(f.name)
                if isinstance(f.dataType, T.TimestampType)
                else F.col(f.name)
                for f in df.schema.fields
            ]
        )

    QUERIES[fn.__name__] = run
    return run


# -- the events table as telemetry, messages, log -------------------------------


def gpu_name() -> Column:
    user = F.col("user_id").cast("string")
    return F.concat(F.lit("gpu-"), F.when(F.length(user) < 4, F.lpad(user, 4, "0")).otherwise(user))


def events_as_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        gpu_name().alias("gpu_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("metric_name"),
        "value",
        F.col("props").alias("data"),
    )


def by_the_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times cut to the hour, which makes keys collide."""
    return events_as_telemetry(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp"))


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, arrays, a literal null and text that is not JSON, by metric."""
    document = (
        F.when(F.col("metric_name") == "error", F.concat(F.lit("not json "), "data"))
        .when(F.col("metric_name") == "view", F.concat(F.lit("["), "data", F.lit("]")))
        .when(F.col("metric_name") == "signup", F.lit("null"))
        .otherwise(F.col("data"))
    )
    return events_as_telemetry(spark, sf_dir).withColumn("data", document)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String records as a CSV reader gives them."""
    return events_as_telemetry(spark, sf_dir).select(
        F.col("event_id").alias("arrival"),
        "gpu_id",
        F.date_format("timestamp", MICROS).alias("timestamp"),
        "metric_name",
        F.col("value").cast("string").alias("value"),
        "data",
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.to_message(event_records(spark, sf_dir), keep=("arrival",))


def routed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with topic and partition, hashed once for both topics."""
    h = fnv1a32("key")
    topics = F.array(
        *[
            F.struct(F.lit(name).alias("topic"), (F.col("hash") % n).cast("int").alias("partition"))
            for name, n in (("telemetry", 3), ("alerts", 2))
        ]
    )
    wanted = F.when(F.col("metric_name") == "error", topics).otherwise(F.slice(topics, 1, 1))
    hashed = event_records(spark, sf_dir).withColumn("key", F.col("gpu_id")).withColumn("hash", h)
    return hashed.select("*", F.inline(wanted)).drop("hash")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload is put together after the offsets are known, and only where it is read."""
    numbered = numbering.append_offsets(routed_records(spark, sf_dir), ["arrival"])
    columns = ["gpu_id", "timestamp", "metric_name", "value", "data"]
    return numbered.select(
        "topic", "partition", "offset", "key", records.record_json(columns).alias("payload"), "arrival"
    )


def partitions(spark: SparkSession) -> DataFrame:
    return topic_partitions(spark, TOPICS)


def tenths(n: int) -> Column:
    return F.floor(F.col("end_offset") * n / 10).cast("bigint")


def event_bases(ends: DataFrame) -> DataFrame:
    """A log compacted to its first tenth."""
    return ends.select(*log.KEYS, tenths(1).alias("base_offset"))


def event_commits(ends: DataFrame) -> DataFrame:
    """Group ``fast`` rewinds from 9/10 to 7/10, ``slow`` moves from 2/10 to 3/10."""
    moves = F.array(
        *[
            F.struct(F.lit(g).alias("group"), tenths(n).alias("offset"), F.lit(seq).cast("bigint").alias("commit_seq"))
            for g, n, seq in (("fast", 9, 1), ("slow", 2, 1), ("fast", 7, 2), ("slow", 3, 2))
        ]
    )
    return ends.select(*log.KEYS, F.inline(moves))


class EventLog:
    """Log, ends, bases, commits and extents over the events."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.messages = event_log(spark, sf_dir)
        self.ends = pin_small(log.partition_ends(self.messages))
        self.bases = event_bases(self.ends)
        self.commits = event_commits(self.ends)
        self.extents = log.partition_extents(self.ends, partitions(spark), self.bases)
        self.watermarks = log.offset_watermark(self.commits, self.extents)
        self.stats = log.partition_stats(self.watermarks)


# -- telemetry queries ------------------------------------------------------------


@query
def list_gpus(spark, sf_dir):
    return telemetry.list_gpus(events_as_telemetry(spark, sf_dir))


@query
def gpu_summary(spark, sf_dir):
    return telemetry.gpu_count(events_as_telemetry(spark, sf_dir))


@query
def telemetry_by_gpu(spark, sf_dir):
    return telemetry.telemetry_by_gpu(events_as_telemetry(spark, sf_dir), GPU)


@query
def telemetry_range(spark, sf_dir):
    return telemetry.telemetry_by_gpu_time_range(events_as_telemetry(spark, sf_dir), GPU, START, END)


@query
def effective_range(spark, sf_dir):
    return telemetry.effective_range(
        telemetry.in_range(events_as_telemetry(spark, sf_dir), start=START), start=START, per_gpu=True
    )


@query
def expand_data(spark, sf_dir):
    return telemetry.expand_data(mixed_documents(spark, sf_dir)).select("event_id", "data")


@query
def fields_available(spark, sf_dir):
    return telemetry.fields_available(telemetry.expand_data(mixed_documents(spark, sf_dir)))


@query
def fields_per_gpu(spark, sf_dir):
    return telemetry.fields_available(telemetry.expand_data(mixed_documents(spark, sf_dir)), per_gpu=True)


@query
def expand_field(spark, sf_dir):
    return events_as_telemetry(spark, sf_dir).select("event_id", json_number("data", "k").alias("k"))


@query
def response_records(spark, sf_dir):
    return telemetry_of_all(events_as_telemetry(spark, sf_dir), START, END).records


def one_gpu(spark: SparkSession, sf_dir: str):
    return get_gpu_telemetry(events_as_telemetry(spark, sf_dir), GPU, "2024-01-10T00:00:00Z", "2024-01-20T01:00:00+01:00")


@query
def gpu_records(spark, sf_dir):
    """One device between two times given as text."""
    return one_gpu(spark, sf_dir).records


@query
def gpu_fields(spark, sf_dir):
    return one_gpu(spark, sf_dir).fields


@query
def gpu_range(spark, sf_dir):
    return one_gpu(spark, sf_dir).summary


@query
def response_summary(spark, sf_dir):
    return telemetry_of_all(events_as_telemetry(spark, sf_dir), end=END).summary


@query
def count_records(spark, sf_dir):
    return telemetry.count_records(events_as_telemetry(spark, sf_dir))


@query
def recent_for_gpu(spark, sf_dir):
    return telemetry.recent_for_gpu(events_as_telemetry(spark, sf_dir), GPU, 10)


@query
def latest_ingested(spark, sf_dir):
    stored = events_as_telemetry(spark, sf_dir).withColumn("created_at", F.date_trunc("day", "timestamp"))
    return telemetry.latest_ingested(stored, 10, ties=("event_id",))


@query
def sample_rows(spark, sf_dir):
    """Any rows may be drawn: how many were, and how many of them the table does not have."""
    rows = events_as_telemetry(spark, sf_dir)
    drawn = telemetry.sample_rows(rows, 10).select("event_id", "gpu_id", F.lit(True).alias("drawn"))
    found = drawn.join(rows.select("event_id", "gpu_id", F.lit(True).alias("known")), ["event_id", "gpu_id"], "left")
    return found.agg(F.count("drawn").alias("sampled"), F.count(F.when(F.col("known").isNull(), True)).alias("foreign"))


@query
def hourly_average(spark, sf_dir):
    return telemetry.hourly_average(events_as_telemetry(spark, sf_dir), "k")


@query
def hourly_average_by_gpu(spark, sf_dir):
    return telemetry.bucket_average(events_as_telemetry(spark, sf_dir), "k")


@query
def records_per_gpu(spark, sf_dir):
    return telemetry.records_per_gpu(events_as_telemetry(spark, sf_dir))


@query
def by_metric(spark, sf_dir):
    return telemetry.by_metric(events_as_telemetry(spark, sf_dir), None, "error", START, END)


# -- duplicates and inserts ---------------------------------------------------------


@query
def find_duplicates(spark, sf_dir):
    return dedup.find_duplicates(by_the_hour(spark, sf_dir))


@query
def count_duplicate_keys(spark, sf_dir):
    return dedup.count_duplicate_keys(by_the_hour(spark, sf_dir))


@query
def dedup_first(spark, sf_dir):
    return dedup.dedup_first(by_the_hour(spark, sf_dir), ["event_id"])


@query
def insert_if_absent(spark, sf_dir):
    rows = by_the_hour(spark, sf_dir)
    return dedup.insert_if_absent(rows, rows.filter(F.col("timestamp") < F.lit(START)), ["event_id"])


@query
def write_telemetry(spark, sf_dir):
    """Two inserts into a fresh table: what was stored before the 10th, then everything."""
    table = TelemetryTable(spark, work_folder(spark, "table"))
    rows = by_the_hour(spark, sf_dir)
    table.insert(rows.filter(F.col("timestamp") < F.lit(START)), ["event_id"])
    table.insert(rows, ["event_id"])
    return table.read().select("gpu_id", "timestamp", "data", "batch_id")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of records."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.select(
        F.col("event_id").alias("arrival"),
        gpu_name().alias("gpu_id"),
        F.date_format(F.col("ts").cast("timestamp"), MICROS).alias("timestamp"),
        F.col("event_type").alias("metric_name"),
        F.col("value").cast("string").alias("value"),
        F.col("props").alias("data"),
    )


@query
def two_topics_streamed(spark, sf_dir):
    """Two streams with checkpoints of their own into one log."""
    store = MessageLog(spark, work_folder(spark, "log"), TOPICS)
    rows = events_stream(spark, sf_dir)
    for topic, mine in (("telemetry", rows), ("alerts", rows.filter(F.col("metric_name") == "error"))):
        stream_publish(mine, store, topic, work_folder(spark, "checkpoint"), restamped=False).awaitTermination()
    return store.messages().select("topic", "partition", "offset", "key")


@query
def two_sources_one_topic(spark, sf_dir):
    """Even and odd events from two producers that number their batches alike; both are retried."""
    store = MessageLog(spark, work_folder(spark, "log"), TOPICS)
    rows = event_records(spark, sf_dir)
    for name, rest in (("a", 0), ("b", 1), ("a", 0), ("b", 1)):
        publish_records(store, rows.filter(F.col("arrival") % 2 == rest), "telemetry", restamped=False, batch_id=0, source=name)
    return store.messages().select("topic", "partition", "offset", "key", "payload")


def split_log(spark: SparkSession, sf_dir: str) -> MessageLog:
    """Even events in one topic, odd ones in the other."""
    store = MessageLog(spark, work_folder(spark, "log"), TOPICS)
    rows = event_records(spark, sf_dir)
    for topic, rest in (("telemetry", 0), ("alerts", 1)):
        publish_records(store, rows.filter(F.col("arrival") % 2 == rest), topic, restamped=False)
    return store


@query
def two_collectors_one_table(spark, sf_dir):
    store, table = split_log(spark, sf_dir), TelemetryTable(spark, work_folder(spark, "table"))
    for topic in ("telemetry", "alerts"):
        stream_collect(store, table, topic, "db", work_folder(spark, "checkpoint")).awaitTermination()
    return table.read().select("gpu_id", "timestamp", "data")


@query
def stream_bounded(spark, sf_dir):
    """Two publish batches, one per micro-batch."""
    store, metrics = MessageLog(spark, work_folder(spark, "log"), TOPICS), work_folder(spark, "metrics")
    rows = event_records(spark, sf_dir)
    for rest in (0, 1):
        publish_records(store, rows.filter(F.col("arrival") % 2 == rest), "telemetry", restamped=False)
    table = TelemetryTable(spark, work_folder(spark, "table"))
    stream_collect(
        store, table, "telemetry", "db", work_folder(spark, "checkpoint"), max_batches=1, metrics_folder=metrics
    ).awaitTermination()
    return ingest_metrics(store, metrics).select("batch_id", "polled", "rejected", "inserted", "duplicates")


@query
def stream_bounded_messages(spark, sf_dir):
    """One publish batch, taken by a stream in turns of a tenth of the largest partition at most."""
    store, metrics = MessageLog(spark, work_folder(spark, "log"), TOPICS), work_folder(spark, "metrics")
    publish_records(store, event_records(spark, sf_dir), "telemetry", restamped=False)
    largest = store.extents().filter("topic = 'telemetry'").agg(F.max("end_offset")).first()[0]
    table = TelemetryTable(spark, work_folder(spark, "table"))
    stream_collect(
        store, table, "telemetry", "db", work_folder(spark, "checkpoint"), metrics_folder=metrics, max_messages=-(-largest // 10)
    ).awaitTermination()
    turns = ingest_metrics(store, metrics).agg(
        F.count(F.lit(1)).alias("turns"), *(F.sum(c).alias(c) for c in ("polled", "rejected", "inserted", "duplicates"))
    )
    return turns.join(table.read().agg(F.count(F.lit(1)).alias("stored")))


@query
def publish_rejects(spark, sf_dir):
    """What a publish sets aside: no key for purchases, a partition that is not there for errors."""
    store = MessageLog(spark, work_folder(spark, "log"), TOPICS)
    rows = event_records(spark, sf_dir).withColumn(
        "gpu_id", F.when(F.col("metric_name") == "purchase", "").when(F.col("metric_name") == "error", "gpu-far").otherwise(F.col("gpu_id"))
    )
    done = publish_records(
        store, rows, "telemetry", restamped=False, router=lambda key: F.when(key == "gpu-far", F.lit(7)).otherwise(F.lit(0))
    )
    kept = done.messages.groupBy().agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("messages"))
    return kept.union(done.rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("messages")))


@query
def own_publisher(spark, sf_dir):
    """A stream of records into a sink of the caller's."""
    folder = work_folder(spark, "own")
    stream_publish(
        events_stream(spark, sf_dir), None, "telemetry", work_folder(spark, "checkpoint"),
        sink=lambda batch, batch_id: batch.write.parquet(f"{folder}/{batch_id}"),
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/*").select("arrival", "gpu_id", "value")


@query
def own_sink(spark, sf_dir):
    """Validated messages into a sink of the caller's."""
    folder = work_folder(spark, "own")
    collect_batch(
        filled_log(spark, sf_dir), lambda rows, batch_id: rows.write.parquet(folder), "alerts", "db", batch=None
    )
    return spark.read.parquet(folder).select("gpu_id", "timestamp", "data")


@query
def multi_group_watermark(spark, sf_dir):
    """Two groups on one topic; the slower one holds the watermark."""
    store = filled_log(spark, sf_dir)
    for group, batch in (("fast", None), ("slow", 100)):
        collect_batch(store, lambda rows, batch_id: rows.count(), "telemetry", group, batch=batch)
    return store.watermarks().select("topic", "partition", "watermark")


@query
def assign_row_id(spark, sf_dir):
    rows = events_as_telemetry(spark, sf_dir).select("event_id", "gpu_id", "timestamp")
    return numbering.assign_row_ids(rows, ["timestamp", "event_id"])


# -- records, messages, validation ----------------------------------------------------


@query
def restamp(spark, sf_dir):
    return records.restamp(event_records(spark, sf_dir), STAMP)


@query
def require_key(spark, sf_dir):
    rows = event_records(spark, sf_dir).withColumn(
        "gpu_id", F.when(F.col("metric_name") == "view", "").when(F.col("metric_name") != "error", F.col("gpu_id"))
    )
    return records.require_key(rows).select("arrival", "gpu_id")


@query
def to_message(spark, sf_dir):
    return event_messages(spark, sf_dir)


@query
def payload_roundtrip(spark, sf_dir):
    coded = event_messages(spark, sf_dir).select("arrival", encode_payload("payload").alias("wire"))
    return coded.withColumn("payload", decode_payload("wire"))


def faulty_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which every metric but one has its own fault."""
    rows = event_records(spark, sf_dir)
    whole = records.record_json([c for c in rows.columns if c != "arrival"])
    fault, number = F.col("metric_name"), F.col("arrival").cast("string")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    gpu, stamp = F.col("gpu_id"), F.col("timestamp")
    payload = (
        F.when(fault == "view", text('{"gpu_id":', number, ',"timestamp":"', stamp, '"}'))
        .when(fault == "error", text('{"gpu_id":"', gpu, '","timestamp":"', F.replace(stamp, F.lit("T"), F.lit(" ")), '"}'))
        .when(fault == "signup", text(whole, " trailing"))
        .when(fault == "purchase", text('{"gpu_id":"', gpu, '","timestamp":"","n":', number, "}"))
        .otherwise(text('{"timestamp":"', stamp, '","n":', number, ',"n":1,"gpu_id":"', gpu, '"}'))
    )
    return rows.select("arrival", payload.alias("payload"))


@query
def validate_records(spark, sf_dir):
    checked = validate.validate_messages(faulty_messages(spark, sf_dir))
    return validate.to_telemetry(checked, keep=("arrival",))


@query
def rejects(spark, sf_dir):
    checked = validate.validate_messages(faulty_messages(spark, sf_dir))
    return checked.filter("reason is not null").select("arrival", "reason", "raw")


@query
def decode_base64_payload(spark, sf_dir):
    """The wire form: base64 payloads, those of one metric damaged."""
    rows = event_records(spark, sf_dir)
    wire = encode_payload(records.record_json([c for c in rows.columns if c != "arrival"]))
    damaged = F.concat(F.when(F.col("metric_name") == "view", "*").otherwise(""), wire)
    coded = rows.select("arrival", damaged.alias("payload"))
    checked = validate.validate_messages(coded, encoding="base64")
    return checked.select("arrival", "gpu_id", "timestamp", "reason")


@query
def parse_timestamps(spark, sf_dir):
    """RFC3339 in several spellings, and texts that are close to it."""
    plain = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format("timestamp", "SSSSSS")
    text = (
        F.when(F.col("metric_name") == "click", F.concat(plain, F.lit("Z")))
        .when(F.col("metric_name") == "view", F.concat(plain, F.lit("."), micros, F.lit("+05:30")))
        .when(F.col("metric_name") == "error", F.concat(plain, F.lit(","), micros, F.lit("789-20:00")))
        .when(F.col("metric_name") == "signup", F.date_format("timestamp", "yyyy-MM-dd"))
        .otherwise(F.replace(plain, F.lit("T"), F.lit(" ")))
    )
    return events_as_telemetry(spark, sf_dir).select("event_id", parse_rfc3339(text).alias("parsed"))


@query
def canonical_documents(spark, sf_dir):
    text = F.concat(F.lit('{ "z" : '), "data", F.lit(', "a":[1, 2.50,null], "z" : '), "event_id", F.lit(" }"))
    return events_as_telemetry(spark, sf_dir).select("event_id", canonical_json(strict_json(text)).alias("document"))


# -- routing and offsets ------------------------------------------------------------------


@query
def hash_keys(spark, sf_dir):
    return events_as_telemetry(spark, sf_dir).select("event_id", fnv1a32("gpu_id").alias("hash"))


@query
def route_modulo(spark, sf_dir):
    return events_as_telemetry(spark, sf_dir).select("event_id", routing.route_modulo(3)(F.col("gpu_id")).alias("partition"))


@query
def route_ring(spark, sf_dir):
    route = routing.route_ring("telemetry", 3)
    return events_as_telemetry(spark, sf_dir).select("event_id", route(F.col("gpu_id")).alias("partition"))


@query
def route_custom(spark, sf_dir):
    def last_digit(key: Column) -> Column:
        return F.right(key, F.lit(1)).cast("int") % 4

    routed = routing.route_messages(event_messages(spark, sf_dir), "telemetry", last_digit, 4)
    return routed.select("arrival", "topic", "partition")


@query
def append_offsets(spark, sf_dir):
    return event_log(spark, sf_dir).select("topic", "partition", "offset", "key", "arrival")


@query
def append_after_tail(spark, sf_dir):
    """A second append continues where the first ended."""
    ends = log.partition_ends(event_log(spark, sf_dir)).withColumnRenamed("end_offset", "tail_offset")
    again = numbering.append_offsets(routed_records(spark, sf_dir), ["arrival"], tails=ends)
    return again.select("topic", "partition", "offset", "arrival")


def limited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    messages = event_log(spark, sf_dir)
    room = log.partition_ends(messages).select(*log.KEYS, tenths(4).alias("capacity"))
    return numbering.apply_capacity(messages, room)


@query
def apply_capacity(spark, sf_dir):
    return limited(spark, sf_dir)[0].select("topic", "partition", "offset", "arrival")


@query
def partition_full(spark, sf_dir):
    full = limited(spark, sf_dir)[1]
    return full.groupBy("reason", "topic", "partition").agg(F.count(F.lit(1)).alias("refused"))


# -- log reads and bookkeeping ---------------------------------------------------------------


@query
def topic_summary(spark, sf_dir):
    return log.topic_summary(log.partition_ends(event_log(spark, sf_dir)), partitions(spark))


@query
def read_from(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    return log.read_from(e.messages, e.extents, "telemetry", 1, 100, 500).select("partition", "offset", "key", "arrival")


@query
def get_message(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    return log.get_message(e.messages, e.extents, "telemetry", 2, 0).select("partition", "offset", "key", "arrival")


@query
def consume_batch(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    taken = log.consume_batch(e.messages, e.commits, e.extents, "telemetry", "fast", 50)
    return taken.select("partition", "offset", "key", "arrival", "next_offset")


@query
def consume_positions(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    return log.consume_positions(e.commits, e.extents, "telemetry", "newcomer", 10)


@query
def commit_validity(spark, sf_dir):
    """Commits at, below and beyond the limits of each partition."""
    e = EventLog(spark, sf_dir)
    tries = F.array(
        *[
            F.struct(F.lit(g).alias("group"), at.cast("bigint").alias("offset"))
            for g, at in (
                ("tail", F.col("end_offset")),
                ("past", F.col("end_offset") + 1),
                ("base", F.col("base_offset")),
                ("below", F.col("base_offset") - 1),
                ("", F.col("base_offset")),
            )
        ]
    )
    return log.commit_errors(e.extents.select(*log.KEYS, F.inline(tries)), e.extents)


@query
def group_offsets(spark, sf_dir):
    """Offsets a group keeps itself: beyond the tail is allowed, and the last one counts."""
    e = EventLog(spark, sf_dir)
    moves = F.array(
        *[
            F.struct(F.lit(g).alias("group"), at.cast("bigint").alias("offset"), F.lit(seq).cast("bigint").alias("commit_seq"))
            for g, at, seq in (("own", F.col("end_offset") + 5, 1), ("own", F.col("end_offset") + 3, 2), ("", F.col("end_offset"), 3))
        ]
    )
    commits = log.valid_commits(e.extents.select(*log.KEYS, F.inline(moves)), e.extents, validate=False)
    return log.committed_offsets(commits, e.extents, "own").select(*log.KEYS, "offset")


@query
def committed_offsets(spark, sf_dir):
    return log.current_commits(EventLog(spark, sf_dir).commits)


@query
def offset_watermark(spark, sf_dir):
    return EventLog(spark, sf_dir).watermarks.select("topic", "partition", "watermark")


@query
def registered_watermark(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    groups = local_rows(
        spark, [("telemetry", "late"), ("alerts", "slow")], T.StructType.fromDDL("topic string, group string")
    )
    return log.offset_watermark(e.commits, e.extents, groups).select("topic", "partition", "watermark")


@query
def partition_stats(spark, sf_dir):
    return EventLog(spark, sf_dir).stats


@query
def consumer_lag(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    return log.consumer_lag(e.commits, e.extents)


@query
def retained_bytes(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    return log.retained_bytes(e.messages, e.watermarks)


@query
def stalled_watermark(spark, sf_dir):
    """Daily snapshots of a log whose watermark follows the tail every third day."""
    day = F.datediff(F.col("timestamp").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    daily = (
        events_as_telemetry(spark, sf_dir)
        .select(
            F.lit("telemetry").alias("topic"),
            routing.route_modulo(3)(F.col("gpu_id")).alias("partition"),
            day.alias("day"),
        )
        .groupBy("topic", "partition", "day")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A row per partition and day is left; both windows run over those.
    so_far = Window.partitionBy("topic", "partition").orderBy("day")
    in_block = Window.partitionBy("topic", "partition", F.floor(F.col("day") / 3)).orderBy("day")
    since_move = F.sum(F.when(F.col("day") % 3 > 0, F.col("n")).otherwise(0)).over(in_block)
    tails = daily.select(
        "topic",
        "partition",
        F.col("day").alias("snapshot_id"),
        F.sum("n").over(so_far).alias("tail_offset"),
        (F.sum("n").over(so_far) - since_move).alias("watermark"),
    )
    return log.stalled_watermarks(tails)


# -- compaction ---------------------------------------------------------------------------------


@query
def compact(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    kept, _ = compaction.compact(e.messages, e.watermarks)
    return kept.select("topic", "partition", "offset", "arrival")


@query
def compaction_plan(spark, sf_dir):
    return compaction.compaction_plan(EventLog(spark, sf_dir).watermarks)


@query
def rebase_offsets(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    return log.rebase_messages(e.messages, e.bases).select("topic", "partition", "offset", "arrival")


@query
def rebase_commits(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    return log.rebase_commits(e.commits, e.bases)


@query
def compaction_triggers(spark, sf_dir):
    return compaction.compaction_triggers(EventLog(spark, sf_dir).stats, 1000)


@query
def compaction_summary(spark, sf_dir):
    return compaction.compaction_summary(compaction.compaction_plan(EventLog(spark, sf_dir).watermarks))


@query
def compact_due(spark, sf_dir):
    e = EventLog(spark, sf_dir)
    return compaction.due_plan(e.watermarks, e.stats, 1000)


# -- whole pipelines, stored and read back ---------------------------------------------------------


def csv_folder(spark: SparkSession, sf_dir: str, as_metrics: bool = False) -> str:
    """The events as CSV files."""
    folder = work_folder(spark, "csv")
    rows = event_records(spark, sf_dir)
    if as_metrics:
        filled = {c: F.lit("") for c in METRIC_COLUMNS if c not in rows.columns}
        rows = rows.withColumns(filled).withColumn("labels_raw", F.col("data")).select(*METRIC_COLUMNS)
    else:
        rows = rows.withColumn("arrival_no", F.col("arrival")).drop("arrival")
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    return folder


@query
def read_csv(spark, sf_dir):
    return read_csv_records(spark, csv_folder(spark, sf_dir))


@query
def read_metrics(spark, sf_dir):
    return read_metric_rows(spark, csv_folder(spark, sf_dir, as_metrics=True))


def in_key_order(messages: DataFrame) -> DataFrame:
    """The arrival number in each message, and that of the message of its device before it."""
    number = F.get_json_object("payload", "$.arrival_no").cast("bigint")
    w = Window.partitionBy("key", "partition").orderBy("offset")
    return messages.withColumn("number", number).withColumn("before", F.lag("number").over(w))


@query
def publish_from_csv(spark, sf_dir):
    """CSV in, messages out; offsets depend on the file split, so their density shows, and the order per device."""
    store = MessageLog(spark, work_folder(spark, "log"), TOPICS)
    publish_csv(store, csv_folder(spark, sf_dir), "telemetry", STAMP)
    return in_key_order(store.messages()).groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("messages"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.countDistinct("offset").alias("offsets"),
        F.countDistinct("key").alias("gpus"),
        F.count(F.when(F.col("number") < F.col("before"), True)).alias("out_of_order"),
    )


def filled_log(spark: SparkSession, sf_dir: str) -> MessageLog:
    store = MessageLog(spark, work_folder(spark, "log"), TOPICS)
    rows = event_records(spark, sf_dir)
    publish_records(store, rows, "telemetry", restamped=False)
    publish_records(store, rows.filter(F.col("metric_name") == "error"), "alerts", restamped=False)
    return store


@query
def publish_log(spark, sf_dir):
    return filled_log(spark, sf_dir).messages().select("topic", "partition", "offset", "key", "payload")


@query
def collect_from_log(spark, sf_dir):
    """One poll to the tail, then the same messages once more."""
    store, table = filled_log(spark, sf_dir), TelemetryTable(spark, work_folder(spark, "table"))
    collect_batch(store, table, "telemetry", "db", batch=None)
    collect_batch(store, table, "alerts", "db", batch=None)
    return table.read().select("gpu_id", "timestamp", "data", "batch_id")


@query
def stored_compaction(spark, sf_dir):
    """Publish, acknowledge, compact what is due, delete, read what is left."""
    store = filled_log(spark, sf_dir)
    extents = store.extents()
    for group, n in (("fast", 7), ("slow", 3)):
        store.acknowledge(extents.select(*log.KEYS, F.lit(group).alias("group"), tenths(n).alias("offset")))
    compact_due_topics(store, threshold=1000)
    return store.messages().select("topic", "partition", "offset")


@query
def stream_publish_csv(spark, sf_dir):
    """CSV files as a stream into the log; counts and order per key and partition."""
    store = MessageLog(spark, work_folder(spark, "log"), TOPICS)
    columns = ["gpu_id", "timestamp", "metric_name", "value", "data", "arrival_no"]
    source = stream_csv_records(spark, csv_folder(spark, sf_dir), columns, max_files_per_trigger=4)
    running = stream_publish(source, store, "telemetry", work_folder(spark, "checkpoint"), restamped=False)
    running.awaitTermination()
    top = F.max("offset") + 1 - F.count(F.lit(1))
    dense = store.messages().groupBy("partition").agg(top.alias("gaps"), F.countDistinct("offset").alias("offsets"))
    by_key = store.messages().groupBy("key", "partition").agg(F.count(F.lit(1)).alias("messages"))
    return by_key.join(dense, "partition")


def collected_stream(spark: SparkSession, sf_dir: str) -> tuple[TelemetryTable, DataFrame]:
    """Events streamed into the log, cut to the hour, and from there into a table."""
    store = MessageLog(spark, work_folder(spark, "log"), TOPICS)
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = events.select(
        F.col("event_id").alias("arrival"),
        gpu_name().alias("gpu_id"),
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    stream_publish(rows, store, "telemetry", work_folder(spark, "checkpoint"), restamped=False).awaitTermination()
    table, metrics = TelemetryTable(spark, work_folder(spark, "table")), work_folder(spark, "metrics")
    stream_collect(
        store, table, "telemetry", "db", work_folder(spark, "checkpoint"), metrics_folder=metrics
    ).awaitTermination()
    return table, ingest_metrics(store, metrics)


@query
def stream_collected(spark, sf_dir):
    return collected_stream(spark, sf_dir)[0].read().select("gpu_id", "timestamp", "data")


@query
def stream_metrics(spark, sf_dir):
    return ingest_rates(collected_stream(spark, sf_dir)[1])


@query
def continuous_hourly(spark, sf_dir):
    """Q16 kept up to date over a stream of table files."""
    table = TelemetryTable(spark, work_folder(spark, "table"))
    averages, checkpoint = work_folder(spark, "averages"), work_folder(spark, "checkpoint")
    # The insert is retried after its rows have been rolled up.
    for _ in range(2):
        table.insert(events_as_telemetry(spark, sf_dir), ["event_id"], batch_id=0)
        source = telemetry_stream(spark, table.path, max_files=16)
        continuous_average(source, "k", averages, checkpoint).awaitTermination()
    return latest_average(spark.read.parquet(averages))
