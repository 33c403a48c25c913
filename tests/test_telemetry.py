from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pulsegrid.errors import InvalidArgument, TelemetryNotFound
from pulsegrid.operators import telemetry as ops
from pulsegrid.plans.response import get_gpu_telemetry, parse_time_bounds, query_telemetry, telemetry_of_all
from pulsegrid.schema import TELEMETRY
from pulsegrid.session import local_rows
from pulsegrid.sources.telemetry_table import TelemetryTable

T0 = datetime(2026, 4, 10, 15, tzinfo=timezone.utc)


def minute(n):
    return T0 + timedelta(minutes=n)


def rows_of(spark, *rows):
    df = spark.createDataFrame(rows, "gpu_id string, timestamp timestamp, data string")
    return df.withColumn("event_date", F.to_date("timestamp"))


@pytest.fixture(scope="module")
def table(spark):
    return rows_of(
        spark,
        ("gpu-002", minute(0), '{"temp": 45}'),
        ("gpu-001", minute(2), '{"temp": 46, "power": 100}'),
        ("gpu-001", minute(0), '{"temp":45,"power":100,"memory":4096}'),
        ("gpu-001", minute(1), "invalid json"),
        ("gpu-003", minute(90), "null"),
    ).persist()


def test_list(spark, table):
    assert [r[0] for r in ops.list_gpus(table).collect()] == ["gpu-001", "gpu-002", "gpu-003"]
    assert ops.gpu_count(table).first()["count"] == 3


def test_list_of_nothing(spark):
    empty = local_rows(spark, [], TELEMETRY)
    assert ops.list_gpus(empty).collect() == []
    assert ops.gpu_count(empty).first()["count"] == 0
    assert ops.count_records(empty).first()["count"] == 0


def test_by_gpu_in_time_order(table):
    assert [r["timestamp"] for r in ops.telemetry_by_gpu(table, "gpu-001").collect()] == [
        minute(i).replace(tzinfo=None) for i in range(3)
    ]
    assert ops.telemetry_by_gpu(table, "gpu-009").collect() == []
    with pytest.raises(InvalidArgument):
        ops.telemetry_by_gpu(table, "")


@pytest.mark.parametrize("start,end,want", [(0, 2, 3), (0, 1, 2), (1, 1, 1), (1, None, 2), (None, 1, 2), (None, None, 3), (3, 9, 0)])
def test_range_is_inclusive(table, start, end, want):
    at = lambda n: None if n is None else minute(n)
    assert ops.telemetry_by_gpu_time_range(table, "gpu-001", at(start), at(end)).count() == want


def test_response(table):
    answer = get_gpu_telemetry(table, "gpu-001")
    assert [r["data"] for r in answer.records.collect()] == [
        '{"memory":4096,"power":100,"temp":45}',
        '{"raw":"invalid json"}',
        '{"power":100,"temp":46}',
    ]
    assert [r["field"] for r in answer.fields.collect()] == ["memory", "power", "raw", "temp"]
    summary = answer.summary.first()
    assert (summary["gpu_id"], summary["count"]) == ("gpu-001", 3)
    assert (summary["start_time"], summary["end_time"]) == (minute(0).replace(tzinfo=None), minute(2).replace(tzinfo=None))


def test_response_echoes_bounds(table):
    summary = get_gpu_telemetry(table, "gpu-001", "2026-04-10T20:00:00+05:30", "2026-04-10T15:01:00Z").summary.first()
    assert (summary["count"], summary["start_time"]) == (2, datetime(2026, 4, 10, 14, 30))
    assert summary["end_time"] == datetime(2026, 4, 10, 15, 1)


def test_null_document(table):
    answer = query_telemetry(table, "gpu-003")
    assert [r["data"] for r in answer.records.collect()] == [None] and answer.fields.collect() == []


def test_response_errors(table):
    with pytest.raises(TelemetryNotFound, match="no telemetry data found for gpu_id: gpu-009"):
        query_telemetry(table, "gpu-009")
    with pytest.raises(TelemetryNotFound):
        query_telemetry(table, "gpu-001", minute(50), minute(60))
    for call in (get_gpu_telemetry, query_telemetry):
        with pytest.raises(InvalidArgument, match="gpu_id is required"):
            call(table, "")
    with pytest.raises(InvalidArgument, match="invalid start_time format"):
        get_gpu_telemetry(table, "gpu-001", "invalid-time")
    with pytest.raises(InvalidArgument, match="invalid end_time format"):
        get_gpu_telemetry(table, "gpu-001", "", "2026-04-10")
    assert parse_time_bounds() == (None, None)


def test_response_of_all(table, folder):
    answer = telemetry_of_all(table)
    assert {r["gpu_id"]: r["count"] for r in answer.summary.collect()} == {"gpu-001": 3, "gpu-002": 1, "gpu-003": 1}
    answer.write(folder)
    spark = table.sparkSession
    assert spark.read.json(folder + "/records").count() == 5
    assert spark.read.json(folder + "/fields_available").count() == 5


def test_top_and_counts(table):
    assert [r["timestamp"].minute for r in ops.recent_for_gpu(table, "gpu-001", 2).collect()] == [2, 1]
    assert [tuple(r) for r in ops.records_per_gpu(table).collect()] == [("gpu-001", 3), ("gpu-002", 1), ("gpu-003", 1)]
    assert ops.sample_rows(table, 2).count() == 2


def test_averages(table):
    hours = ops.hourly_average(table, "temp").collect()
    assert [(r["hour"].hour, r["average"]) for r in hours] == [(16, None), (15, (45 + 46 + 45) / 3)]
    buckets = {(r["bucket"].minute, r["gpu_id"]): r["average"] for r in ops.bucket_average(table, "temp", "1 minute").collect()}
    assert buckets[(0, "gpu-002")] == 45.0 and buckets[(2, "gpu-001")] == 46.0


def test_by_metric(spark):
    df = rows_of(spark, ("a", minute(1), '{"metric_name":"x"}'), ("a", minute(0), '{"metric_name":"x"}'), ("a", minute(2), '{"metric_name":"y"}'))
    assert [r["timestamp"].minute for r in ops.by_metric(df, "a", "x").collect()] == [0, 1]


def test_scan_is_pruned(spark, folder):
    """Device, time and date bounds and the column list all reach the scan."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    store = TelemetryTable(spark, folder + "/t")
    store.insert(rows_of(spark, *[(f"g{i % 5}", minute(i * 600), "{}") for i in range(50)]).drop("event_date"))
    day = ops.telemetry_by_gpu_time_range(store.read(), "g1", minute(0), minute(1440)).select("timestamp")
    plan = day._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    for part in ("EqualTo(gpu_id,g1)", "GreaterThanOrEqual(timestamp", "LessThanOrEqual(timestamp", "event_date#"):
        assert part in scan
    assert "ReadSchema: struct<gpu_id:string,timestamp:timestamp>" in scan
    assert "PartitionFilters: [isnotnull(event_date" in scan
