"""Questions asked of the telemetry table.

Every function takes any DataFrame with ``gpu_id, timestamp, data`` and returns
one; nothing is collected.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.errors import InvalidArgument
from pulsegrid.functions import expand_json, json_field, json_number, strict_json


def list_gpus(telemetry: DataFrame) -> DataFrame:
    """Distinct devices, ascending."""
    return telemetry.select("gpu_id").distinct().orderBy("gpu_id")


def gpu_count(telemetry: DataFrame) -> DataFrame:
    """One row, 0 for an empty table."""
    return telemetry.agg(F.countDistinct("gpu_id").alias("count"))


def at_or_after(start: datetime) -> Column:
    return F.col("timestamp") >= F.lit(start)


def at_or_before(end: datetime) -> Column:
    return F.col("timestamp") <= F.lit(end)


def in_range(telemetry: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows between both bounds, inclusive; None leaves a side open.

    A table partitioned by ``event_date`` also gets date bounds, so whole
    folders are skipped.
    """
    dated = "event_date" in telemetry.columns
    if start is not None:
        telemetry = telemetry.filter(at_or_after(start))
        if dated:
            telemetry = telemetry.filter(F.col("event_date") >= F.to_date(F.lit(start)))
    if end is not None:
        telemetry = telemetry.filter(at_or_before(end))
        if dated:
            telemetry = telemetry.filter(F.col("event_date") <= F.to_date(F.lit(end)))
    return telemetry


def of_gpu(telemetry: DataFrame, gpu_id: str) -> DataFrame:
    if not gpu_id:
        raise InvalidArgument("gpu_id is required")
    return telemetry.filter(F.col("gpu_id") == gpu_id)


def telemetry_by_gpu(telemetry: DataFrame, gpu_id: str) -> DataFrame:
    """All rows of a device, oldest first."""
    return of_gpu(telemetry, gpu_id).orderBy("timestamp")


def telemetry_by_gpu_time_range(
    telemetry: DataFrame, gpu_id: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Rows of a device between two instants, oldest first."""
    return in_range(of_gpu(telemetry, gpu_id), start, end).orderBy("timestamp")


def by_metric(
    telemetry: DataFrame,
    gpu_id: str | None,
    metric_name: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Rows of one metric (of one device or of all), oldest first; the name is a
    column or a field of ``data``."""
    rows = of_gpu(telemetry, gpu_id) if gpu_id is not None else telemetry
    name = F.col("metric_name") if "metric_name" in rows.columns else json_field("data", "metric_name")
    return in_range(rows, start, end).filter(name == metric_name).orderBy("timestamp", "gpu_id")


def expand_data(telemetry: DataFrame) -> DataFrame:
    """``data`` as canonical object text, ``{"raw": ...}`` for anything else."""
    parsed = telemetry.withColumn("_document", strict_json("data"))
    return parsed.withColumn("data", expand_json("data", "_document")).select(*telemetry.columns)


def fields_available(expanded: DataFrame, per_gpu: bool = False) -> DataFrame:
    """Distinct top-level keys of expanded rows, sorted, one row per key.

    Rows rather than one array: the set is as large as the producers make it.
    """
    by = ["gpu_id"] if per_gpu else []
    field = F.explode(F.json_object_keys("data")).alias("field")
    return expanded.select(*by, field).distinct().orderBy(*by, "field")


def effective_range(
    telemetry: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    per_gpu: bool = False,
) -> DataFrame:
    """``count`` and the time span: a given bound is echoed, an open one is the
    first or last row's time."""
    low, high = F.min("timestamp"), F.max("timestamp")
    aggregates = (
        F.count(F.lit(1)).alias("count"),
        (low if start is None else F.coalesce(F.lit(start), low)).alias("start_time"),
        (high if end is None else F.coalesce(F.lit(end), high)).alias("end_time"),
    )
    return telemetry.groupBy("gpu_id").agg(*aggregates) if per_gpu else telemetry.agg(*aggregates)


def count_records(telemetry: DataFrame) -> DataFrame:
    return telemetry.agg(F.count(F.lit(1)).alias("count"))


def recent_for_gpu(telemetry: DataFrame, gpu_id: str, n: int = 10) -> DataFrame:
    """The newest ``n`` rows of a device, newest first."""
    return of_gpu(telemetry, gpu_id).orderBy(F.desc("timestamp")).limit(n)


def latest_ingested(telemetry: DataFrame, n: int = 10, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` rows stored last; a batch shares one ``created_at``, so name
    columns in ``ties`` for a fixed order."""
    return telemetry.orderBy(F.desc("created_at"), *[F.desc(c) for c in ties]).limit(n)


def sample_rows(telemetry: DataFrame, n: int = 10) -> DataFrame:
    """Any ``n`` rows."""
    return telemetry.limit(n)


def hourly_average(telemetry: DataFrame, field: str, strict: bool = False) -> DataFrame:
    """Average of a JSON field per hour, newest hour first; rows without it do not count."""
    return (
        telemetry.groupBy(F.date_trunc("hour", "timestamp").alias("hour"))
        .agg(F.avg(json_number("data", field, strict)).alias("average"))
        .orderBy(F.desc("hour"))
    )


def bucket_average(telemetry: DataFrame, field: str, width: str = "1 hour", strict: bool = False) -> DataFrame:
    """Average of a JSON field per time bucket and device; works on a stream too."""
    return (
        telemetry.groupBy(F.window("timestamp", width), "gpu_id")
        .agg(F.avg(json_number("data", field, strict)).alias("average"))
        .select(F.col("window.start").alias("bucket"), "gpu_id", "average")
    )


def records_per_gpu(telemetry: DataFrame) -> DataFrame:
    """Rows per device, largest first."""
    return (
        telemetry.groupBy("gpu_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "gpu_id")
    )
