"""Hourly averages kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators.telemetry import bucket_average
from pulsegrid.schema import TELEMETRY
from pulsegrid.session import prepare_session


def telemetry_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files of the telemetry table as a stream."""
    reader = prepare_session(spark).readStream.schema(TELEMETRY)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def continuous_average(
    telemetry: DataFrame,
    field: str,
    table: str,
    checkpoint: str,
    width: str = "1 hour",
    lateness: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Average of a field per bucket and device, continuously.

    With ``lateness`` the state is bounded: a bucket is appended to ``table``
    once rows that late can no longer change it, and later rows are dropped.
    Without it every bucket stays open, each micro-batch writes the buckets it
    changed, and :func:`latest_average` reads the current ones.
    """
    source = telemetry.withWatermark("timestamp", lateness) if lateness else telemetry
    averages = bucket_average(source, field, width)

    def store(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(table)

    return (
        averages.writeStream.outputMode("append" if lateness else "update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_average(changes: DataFrame) -> DataFrame:
    """The newest value of every bucket and device."""
    return changes.groupBy("bucket", "gpu_id").agg(F.max_by("average", "batch_id").alias("average"))
