import json
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import dedup, records, validate
from pulsegrid.plans.ingest import collect_batch, publish_csv, publish_records
from pulsegrid.schema import TopicSpec
from pulsegrid.sources.message_log import MessageLog
from pulsegrid.sources.telemetry_table import TelemetryTable

STAMP = datetime(2026, 4, 10, 15, 0, 0, 999999, tzinfo=timezone.utc)


def messages_of(spark, *payloads):
    rows = [("t", 0, i, "k", p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, key string, payload string")


def record(gpu, at, **fields):
    return json.dumps({"gpu_id": gpu, "timestamp": at, **fields})


def reasons(spark, *payloads, **options):
    checked = validate.validate_messages(messages_of(spark, *payloads), **options)
    return [r["reason"] for r in checked.orderBy("offset").collect()]


def test_restamp_copies(spark):
    df = spark.createDataFrame([("g", "old")], "gpu_id string, timestamp string")
    assert records.restamp(df, STAMP).first()["timestamp"] == "2026-04-10T15:00:00Z"
    assert df.first()["timestamp"] == "old"
    now = records.restamp(df).first()["timestamp"]
    assert len(now) == 20 and now.endswith("Z")


def test_message_text(spark):
    df = spark.createDataFrame([("g", "1", "<a> &  ", None)], "gpu_id string, b string, A string, n string")
    row = records.to_message(df).first()
    assert row["key"] == "g"
    assert row["payload"] == '{"A":"\\u003ca\\u003e \\u0026 \\u2028","b":"1","gpu_id":"g"}'
    assert json.loads(row["payload"])["A"] == "<a> &  "


def test_record_without_key(spark):
    df = spark.createDataFrame([("", "1"), (None, "2"), ("g", "3")], "gpu_id string, v string")
    assert [r["v"] for r in records.require_key(df).collect()] == ["3"]
    no_column = spark.createDataFrame([("250",)], "power string")
    assert records.to_message(no_column).collect() == []
    assert records.to_message(no_column, keyed_only=False).first()["payload"] == '{"power":"250"}'


GOOD = '{"gpu_id":"gpu-001","timestamp":"2026-04-10T15:00:00Z"}'


def test_reasons(spark):
    at = "2026-04-10T15:00:00Z"
    cases = {
        GOOD: None,
        record("g", "2026-04-10T15:00:00+05:30"): None,
        record("g", at, i=1, f=1.5, b=True, s="x", n=None, nested={"k": [1]}): None,
        record("g", at, **{f"f{i}": {"v": i} for i in range(100)}): None,
        json.dumps({"timestamp": at}): "missing_fields",
        json.dumps({"gpu_id": "g"}): "missing_fields",
        record("", at): "missing_fields",
        record("g", ""): "missing_fields",
        record(7, at): "missing_fields",
        record("g", 7): "missing_fields",
        "null": "missing_fields",
        "{}": "missing_fields",
        record("g", "not-a-timestamp"): "bad_timestamp",
        record("g", "2026-04-10"): "bad_timestamp",
        "not-json": "bad_json",
        "[1]": "bad_json",
        "5": "bad_json",
        "": "bad_json",
        GOOD + " x": "bad_json",
    }
    assert dict(zip(cases, reasons(spark, *cases))) == cases
    assert reasons(spark, None) == ["bad_json"]


def test_base64_payloads(spark):
    coded = messages_of(spark, GOOD, "x").withColumn("payload", F.base64(F.col("payload").cast("binary")))
    coded = coded.union(messages_of(spark, "*").withColumn("offset", F.lit(9)))
    checked = validate.validate_messages(coded, encoding="base64").orderBy("offset").collect()
    assert [r["reason"] for r in checked] == [None, "bad_json", "bad_base64"]


def test_telemetry_and_rejects_split(spark):
    checked = validate.validate_messages(messages_of(spark, '{"timestamp":"2026-04-10T15:00:00Z","z":1,"gpu_id":"g"}', "oops"))
    row = validate.to_telemetry(checked).first()
    assert (row["gpu_id"], row["timestamp"], row["data"]) == (
        "g",
        datetime(2026, 4, 10, 15),
        '{"gpu_id":"g","timestamp":"2026-04-10T15:00:00Z","z":1}',
    )
    assert [tuple(r) for r in validate.rejects(checked).collect()] == [("bad_json", "oops", "t", 0, 1)]


def test_first_arrival_wins_by_instant(spark):
    same = messages_of(
        spark,
        record("g", "2026-04-10T15:00:00+05:30", n=1),
        record("g", "2026-04-10T09:30:00Z", n=2),
        record("g", "2026-04-10T09:30:01Z", n=3),
    )
    rows = validate.to_telemetry(validate.validate_messages(same), keep=("partition", "offset"))
    first = dedup.dedup_first(rows.orderBy(F.desc("offset")), ["partition", "offset"])
    assert sorted(json.loads(r["data"])["n"] for r in first.collect()) == [1, 3]


def test_hot_key_is_combined_before_the_shuffle(spark):
    df = spark.range(20000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('g', id)) as gpu_id", "timestamp'2026-01-01' as timestamp", "string(id) as data", "id as offset"
    )
    first = dedup.dedup_first(df, ["offset"])
    assert first.filter("gpu_id = 'hot'").first()["data"] == "0"
    assert first.count() == 1 + 20000 - 6667
    plan = first._jdf.queryExecution().executedPlan().toString()
    # The plan is printed top down: a limit per key stands below the exchange too.
    assert "SortAggregate" not in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


@pytest.mark.parametrize("small", [0, 10_000])
def test_insert_keeps_what_is_stored(spark, small):
    target = spark.createDataFrame([("a", 1, "old")], "gpu_id string, timestamp int, data string")
    batch = spark.createDataFrame(
        [("a", 1, "new", 0), ("a", 2, "second", 2), ("a", 2, "first", 1), ("b", 1, "x", 3)],
        "gpu_id string, timestamp int, data string, n int",
    )
    fresh = dedup.insert_if_absent(batch, target, ["n"], small_batch=small)
    assert {r["data"] for r in fresh.collect()} == {"first", "x"}


def test_date_pruning_is_a_superset(spark, monkeypatch):
    target = spark.sql("select explode(sequence(date'2026-01-01', date'2026-01-31')) as event_date")
    batch = target.filter("day(event_date) in (3, 9)")
    assert dedup.prune_dates(target, batch).count() == 2
    monkeypatch.setattr(dedup, "PRUNE_DATES", 1)
    assert dedup.prune_dates(target, batch).count() == 7


def test_table_insert_is_repeatable(spark, folder):
    table = TelemetryTable(spark, folder + "/t")
    rows = spark.range(500).selectExpr(
        "concat('g', id % 7) as gpu_id", "timestamp'2026-01-01' + make_dt_interval(id div 100, 0, id) as timestamp", "string(id) as data"
    )
    assert table.next_batch_id() == 0
    assert table.insert(rows, ["data"]).count() == 500
    assert table.insert(rows, ["data"]).count() == 0
    more = rows.withColumn("gpu_id", F.lit("late"))
    for _ in range(2):
        assert table.insert(more, ["data"], batch_id=5).count() == 500
    assert table.read().count() == 1000 and table.next_batch_id() == 6
    assert dedup.find_duplicates(table.read()).count() == 0
    assert table.read().filter("created_at is null or event_date != date(timestamp)").count() == 0


def test_metric_name_in_the_key(spark, folder):
    """Metrics of one device and second collapse, unless the key tells them apart."""
    rows = spark.createDataFrame(
        [("g", STAMP, '{"metric_name":"a"}', 0), ("g", STAMP, '{"metric_name":"b"}', 1)],
        "gpu_id string, timestamp timestamp, data string, n int",
    )
    assert TelemetryTable(spark, folder + "/1").insert(rows, ["n"]).count() == 1
    wide = TelemetryTable(spark, folder + "/2")
    key = ("gpu_id", "timestamp", "metric_name")
    assert wide.insert(rows, ["n"], key_cols=key).count() == 2
    assert wide.insert(rows, ["n"], key_cols=key).count() == 0


def csv_of(folder, count=30):
    path = Path(folder) / "in.csv"
    lines = [f"gpu-{i % 4},{i}" if i % 10 else f",{i}" for i in range(count)]
    path.write_text("gpu_id,power\n" + "\n".join(lines) + "\n")
    return str(path)


def test_csv_to_table(spark, folder):
    store = MessageLog(spark, folder + "/log", [TopicSpec("telemetry", 3)])
    table = TelemetryTable(spark, folder + "/table")
    done = publish_csv(store, csv_of(folder), "telemetry", STAMP)
    assert done.messages.count() == 27
    assert {r["reason"] for r in done.rejects.collect()} == {"missing_key"} and done.rejects.count() == 3
    # One device, one partition; the file order holds inside it.
    assert done.messages.groupBy("key").agg(F.countDistinct("partition").alias("n")).filter("n > 1").count() == 0
    power = F.get_json_object("payload", "$.power").cast("int")
    placed = done.messages.select("partition", "offset", power.alias("power"))
    later = placed.select("partition", F.col("offset").alias("later"), F.col("power").alias("later_power"))
    assert placed.join(later, "partition").filter("offset < later and power > later_power").count() == 0
    polled = inserted = 0
    for _ in range(20):
        step = collect_batch(store, table, "telemetry", "db", batch=5)
        polled, inserted = polled + step.polled, inserted + step.inserted
        if not step.polled:
            break
    # Restamped to one second, a device has a single row.
    assert (polled, inserted, table.read().count()) == (27, 4, 4)
    assert {r["lag"] for r in store.lag().collect()} == {0}


def test_lost_acknowledgement_is_absorbed(spark, folder):
    store = MessageLog(spark, folder + "/log", [TopicSpec("t", 1)])
    table = TelemetryTable(spark, folder + "/table")
    rows = spark.range(8).selectExpr(
        "id as arrival", "concat('g', id) as gpu_id", "'2026-04-10T15:00:00Z' as timestamp"
    )
    publish_records(store, rows, "t", restamped=False)
    kept, store.acknowledge = store.acknowledge, lambda *_: None
    assert collect_batch(store, table, "t", "db").inserted == 8
    store.acknowledge = kept
    again = collect_batch(store, table, "t", "db")
    assert (again.polled, again.inserted, again.duplicates) == (8, 0, 8)
    assert collect_batch(store, table, "t", "db").polled == 0


def test_bad_messages_do_not_block(spark, folder):
    store = MessageLog(spark, folder + "/log", [TopicSpec("t", 1)])
    rows = spark.createDataFrame(
        [(0, "k", "not-json"), (1, "k", GOOD), (2, "k", record("g", "soon"))], "n int, key string, payload string"
    )
    store.publish(rows, "t", ["n"])
    done = collect_batch(store, TelemetryTable(spark, folder + "/t"), "t", "db", rejects_folder=folder + "/bad")
    assert (done.polled, done.rejected, done.inserted) == (3, 2, 1)
    assert {(r["reason"], r["offset"]) for r in spark.read.parquet(folder + "/bad").collect()} == {("bad_json", 0), ("bad_timestamp", 2)}
    assert store.lag().first()["lag"] == 0


def test_own_sink(spark, folder):
    store = MessageLog(spark, folder + "/log", [TopicSpec("t", 1)])
    store.publish(spark.createDataFrame([("k", GOOD, 1)], "key string, payload string, n int"), "t", ["n"])
    got = []
    collect_batch(store, lambda df, batch_id: got.extend(df.collect()), "t", "db")
    assert [r["gpu_id"] for r in got] == ["gpu-001"]
