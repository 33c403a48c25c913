from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.telemetry import bucket_average
from pulsegrid.schema import TopicSpec
from pulsegrid.sources.csv_records import stream_csv_records
from pulsegrid.sources.message_log import MessageLog
from pulsegrid.sources.telemetry_table import TelemetryTable
from pulsegrid.streaming.collect import ingest_metrics, ingest_rates, stream_collect
from pulsegrid.streaming.publish import spread_rows, stream_publish
from pulsegrid.streaming.rollup import continuous_average, latest_average, telemetry_stream

COLUMNS = ["gpu_id", "timestamp", "temp"]
T0 = datetime(2026, 4, 10, 15, tzinfo=timezone.utc)


def drop_file(folder, number, count=40):
    """A CSV file in which every fourth record lacks its device and two records share a key."""
    inbox = Path(folder) / "in"
    inbox.mkdir(exist_ok=True)
    lines = [",".join(COLUMNS)]
    for i in range(count):
        at = (T0 + timedelta(minutes=number * 100 + i // 2 * 2)).strftime("%Y-%m-%dT%H:%M:%SZ")
        lines.append(f"{'' if i % 4 == 3 else f'gpu-{i // 2 % 3}'},{at},{i}")
    (inbox / f"{number}.csv").write_text("\n".join(lines) + "\n")
    return str(inbox)


@pytest.fixture
def flow(spark, folder):
    """Publish and collect whatever lies in the inbox; checkpoints persist between calls."""
    store = MessageLog(spark, folder + "/log", [TopicSpec("t", 3)])
    table = TelemetryTable(spark, folder + "/table")

    def publish():
        source = stream_csv_records(spark, folder + "/in", COLUMNS, max_files_per_trigger=1)
        stream_publish(source, store, "t", folder + "/cp-publish", restamped=False).awaitTermination()

    def collect(group="db", sink=table, name="collect"):
        stream_collect(
            store, sink, "t", group, f"{folder}/cp-{name}-{group}", max_batches=1,
            rejects_folder=f"{folder}/bad-{group}", metrics_folder=folder + "/metrics",
        ).awaitTermination()

    return store, table, publish, collect


def test_publish_and_collect(spark, folder, flow):
    store, table, publish, collect = flow
    for number in (0, 1):
        drop_file(folder, number)
    publish()
    assert store.messages().count() == 60 and store.rejects().filter("reason = 'missing_key'").count() == 20
    dense = store.messages().groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("top"), F.countDistinct("offset").alias("d"))
    assert dense.filter("n != d or top != n - 1").count() == 0
    collect()
    # Two records per device and minute, of which one lacks the device in every other pair.
    batch = store.messages().select("key", F.get_json_object("payload", "$.timestamp").alias("at")).distinct()
    assert table.read().count() == batch.count() == 40
    first = table.read().select(F.get_json_object("data", "$.temp").cast("int").alias("temp")).filter("temp % 2 = 1")
    assert first.count() == 0
    assert {r["lag"] for r in store.lag().collect()} == {0}
    rates = ingest_rates(ingest_metrics(store, folder + "/metrics")).first()
    assert (rates["polled"], rates["rejected"], rates["inserted"], rates["duplicates"]) == (60, 0, 40, 20)
    assert ingest_metrics(store, folder + "/metrics").count() == 2


def test_restart_continues(spark, folder, flow):
    store, table, publish, collect = flow
    for number in (0, 1, 2):
        drop_file(folder, number)
        publish()
        collect()
    assert store.messages().count() == 90 and table.read().count() == 60
    assert store.messages().groupBy("partition", "offset").count().filter("count > 1").count() == 0
    publish()
    collect()
    assert table.read().count() == 60


def test_replay_adds_nothing(spark, folder, flow):
    store, table, publish, collect = flow
    drop_file(folder, 0)
    publish()
    collect()
    before = table.read().count()
    again = TelemetryTable(spark, table.path)
    from pulsegrid.plans.ingest import ingest_messages

    done = ingest_messages(store.messages(), again, batch_id=99)
    assert (done.inserted, again.read().count()) == (0, before)


def test_groups_read_independently(spark, folder, flow):
    store, table, publish, collect = flow
    drop_file(folder, 0)
    publish()
    other = TelemetryTable(spark, folder + "/other")
    collect("a")
    drop_file(folder, 1)
    publish()
    collect("b", other)
    assert (table.read().count(), other.read().count()) == (20, 40)
    lag = store.lag().groupBy("group").agg(F.sum("lag").alias("lag"))
    assert {tuple(r) for r in lag.collect()} == {("a", 30), ("b", 0)}
    removed = store.compact().agg(F.sum("removed")).first()[0]
    assert removed == 30 and store.messages().count() == 30
    collect("a")
    assert table.read().count() == 40


def test_bad_messages_in_the_stream(spark, folder, flow):
    store, table, publish, collect = flow
    rows = [(0, "k", "oops"), (1, "k", '{"gpu_id":"g","timestamp":"2026-04-10T15:00:00Z"}')]
    store.publish(spark.createDataFrame(rows, "n int, key string, payload string"), "t", ["n"])
    collect()
    assert table.read().count() == 1
    assert [r["reason"] for r in spark.read.parquet(folder + "/bad-db").collect()] == ["bad_json"]


def test_own_publisher(spark, folder):
    drop_file(folder, 0)
    seen = []
    source = stream_csv_records(spark, folder + "/in", COLUMNS)
    stream_publish(source, None, "t", folder + "/cp", sink=lambda df, batch_id: seen.append((batch_id, df.count()))).awaitTermination()
    assert seen == [(0, 40)]


def test_continuous_average_equals_batch(spark, folder):
    table = TelemetryTable(spark, folder + "/t")
    for part in range(3):
        rows = spark.range(200).selectExpr(
            "concat('g', id % 5) as gpu_id",
            f"timestamp'2026-01-01' + make_dt_interval(0, 0, id * 7 + {part}) as timestamp",
            "concat('{\"k\":', id, '}') as data",
        )
        table.insert(rows)
        source = telemetry_stream(spark, table.path, max_files=2)
        continuous_average(source, "k", folder + "/avg", folder + "/cp").awaitTermination()
    live = latest_average(spark.read.parquet(folder + "/avg"))
    batch = bucket_average(table.read(), "k")
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_bounded_average_closes_buckets(spark, folder):
    table = TelemetryTable(spark, folder + "/t")
    for hour in range(4):
        rows = spark.sql(f"select 'g' as gpu_id, timestamp'2026-01-01 0{hour}:30:00' as timestamp, '{{\"k\":{hour}}}' as data")
        table.insert(rows)
        source = telemetry_stream(spark, table.path)
        continuous_average(source, "k", folder + "/avg", folder + "/cp", lateness="1 hour").awaitTermination()
    closed = spark.read.parquet(folder + "/avg")
    assert {r["average"] for r in closed.collect()} == {0.0, 1.0}


def streamed(spark, store, folder, name, topic, count):
    """``count`` records of a stream of its own into ``topic``."""
    inbox = Path(folder) / name
    inbox.mkdir(exist_ok=True)
    lines = [",".join(COLUMNS)] + [f"{name}-{i},2026-04-10T15:00:00Z,{i}" for i in range(count)]
    (inbox / "0.csv").write_text("\n".join(lines) + "\n")
    source = stream_csv_records(spark, str(inbox), COLUMNS)
    stream_publish(source, store, topic, f"{folder}/cp-{name}", restamped=False).awaitTermination()


def messages_of(spark, count):
    return spark.range(count).selectExpr("id as n", "concat('b-', id) as key", "'{}' as payload")


def test_two_topics_share_a_log(spark, folder):
    store = MessageLog(spark, folder + "/log", [TopicSpec("t", 3), TopicSpec("u", 2)])
    for name, topic, count in (("a", "t", 100), ("b", "u", 60), ("a", "t", 100)):
        streamed(spark, store, folder, name, topic, count)
    assert {tuple(r) for r in store.messages().groupBy("topic").count().collect()} == {("t", 100), ("u", 60)}


def test_batch_and_stream_share_a_topic(spark, folder):
    store = MessageLog(spark, folder + "/log", [TopicSpec("t", 3)])
    store.publish(messages_of(spark, 100), "t", ["n"])
    streamed(spark, store, folder, "a", "t", 60)
    rows = store.messages().groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("top"), F.countDistinct("offset").alias("d"))
    assert store.messages().count() == 160 and rows.filter("n != d or top != n - 1").count() == 0


def test_two_collectors_share_a_table(spark, folder):
    store = MessageLog(spark, folder + "/log", [TopicSpec("t", 3), TopicSpec("u", 2)])
    table = TelemetryTable(spark, folder + "/table")
    for name, topic, count in (("a", "t", 100), ("b", "u", 60)):
        streamed(spark, store, folder, name, topic, count)
        stream_collect(store, table, topic, "db", f"{folder}/cp-collect-{topic}").awaitTermination()
    assert table.read().count() == 160


def test_retries_change_nothing(spark, folder):
    store = MessageLog(spark, folder + "/log", [TopicSpec("t", 1)])
    table = TelemetryTable(spark, folder + "/table")
    rows = spark.range(10).selectExpr("concat('g', id) as gpu_id", "timestamp'2026-01-01' as timestamp", "'{}' as data", "id as n")
    for _ in range(2):
        for source in ("a", "b"):
            store.publish(messages_of(spark, 10), "t", ["n"], batch_id=0, source=source)
            table.insert(rows.withColumn("gpu_id", F.concat("gpu_id", F.lit(source))), ["n"], batch_id=0, source=source)
    assert (store.messages().count(), table.read().count()) == (20, 20)
    assert store.published().count() == 2 and table.inserts().count() == 2
    nothing = messages_of(spark, 3).withColumn("key", F.lit(""))
    for _ in range(2):
        done = store.publish(nothing, "t", ["n"], batch_id=1, source="a")
        assert (done.messages.count(), done.rejects.count()) == (0, 3)
    store.publish(messages_of(spark, 5), "t", ["n"])
    assert store.messages().agg(F.max("offset")).first()[0] == 24 and store.rejects().count() == 3


def test_average_after_a_retried_insert(spark, folder):
    table = TelemetryTable(spark, folder + "/t")

    def step(value, batch_id):
        row = spark.sql(f"select 'g' as gpu_id, timestamp'2026-01-01 00:{value}:00' as timestamp, '{{\"k\":{value}}}' as data")
        table.insert(row, batch_id=batch_id)
        continuous_average(telemetry_stream(spark, table.path), "k", folder + "/avg", folder + "/cp").awaitTermination()

    for value, batch_id in ((10, 0), (20, 1), (20, 1)):
        step(value, batch_id)
    assert latest_average(spark.read.parquet(folder + "/avg")).first()["average"] == 15.0


def test_a_row_without_time_is_refused(spark, folder):
    from pulsegrid.errors import InvalidArgument

    rows = spark.sql("select 'g' as gpu_id, cast(null as timestamp) as timestamp, '{}' as data")
    with pytest.raises(InvalidArgument):
        TelemetryTable(spark, folder + "/t").insert(rows)


def big_publish(spark, store, count, start=0):
    rows = [(i, f"g{i % 5}", f'{{"gpu_id":"g{i % 5}","timestamp":"{(T0 + timedelta(seconds=i)).isoformat()}"}}') for i in range(start, start + count)]
    store.publish(spark.createDataFrame(rows, "n int, key string, payload string"), "t", ["n"])


def test_one_large_publish_is_taken_in_turns(spark, folder, flow):
    store, table, publish, _ = flow
    big_publish(spark, store, 500)
    seen, broken = [], []

    def collect(most, sink=table):
        return stream_collect(store, sink, "t", "db", folder + "/cp-turns", metrics_folder=folder + "/metrics", max_messages=most)

    class Broken(Exception):
        pass

    def breaks(rows, number):
        seen.append(rows.groupBy("partition").count().agg(F.max("count")).first()[0])
        if len(seen) == 3:
            raise Broken("stop here")
        table.insert(rows.drop("partition", "offset"), ["timestamp"], number, source="own")

    with pytest.raises(Exception, match="stop here"):
        collect(60, breaks).awaitTermination()
    done = {r["partition"]: r["offset"] for r in store.commits().groupBy("partition").agg(F.max("offset").alias("offset")).collect()}
    assert max(seen) <= 60 and max(done.values()) == 120 and table.read().count() > 0
    collect(60).awaitTermination()
    assert table.read().count() == 500 and {r["lag"] for r in store.lag().collect()} == {0}
    turns = ingest_metrics(store, folder + "/metrics")
    assert turns.count() > 1 and turns.agg(F.sum("duplicates")).first()[0] == 0
    # Another bound, and what arrives later.
    big_publish(spark, store, 100, 500)
    collect(7).awaitTermination()
    assert table.read().count() == 600 and {r["lag"] for r in store.lag().collect()} == {0}


def test_turns_cover_every_offset_once():
    from pulsegrid.streaming.collect import offset_turns

    ends = {0: (5, 25), 1: (0, 3), 2: (7, 7)}
    for committed in ({}, {0: 9}, {0: 25, 1: 3}, {0: 2, 1: 9}):
        turns = list(offset_turns(ends, committed, 4))
        got = [(p, o) for _, turn in turns for p, (a, b) in turn.items() for o in range(a, b)]
        assert got == [(p, o) for p, o in got if o < ends[p][1]] and len(set(got)) == len(got)
        assert set(got) == {(p, o) for p, (a, b) in ends.items() for o in range(max(a, committed.get(p, a)), b)}
        assert len({before for before, _ in turns}) == len(turns) and all(b - a <= 4 for _, turn in turns for a, b in turn.values())


def test_few_files_are_published_by_all_cores(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("gpu_id")).coalesce(2)
    spread = spread_rows(rows).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in spread.groupBy("task").count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)
    # The order is that of the files.
    in_order = [int(r["gpu_id"]) for r in spread.orderBy("arrival").collect()]
    assert in_order == [int(r["gpu_id"]) for r in rows.collect()]
