"""The telemetry table: parquet by date and insert batch.

Files are sorted by (gpu_id, timestamp), so a scan for one device reads few row
groups; ``event_date`` folders answer time ranges. Every insert writes its own
``batch_id`` folders and then a row of the index ``_inserts`` that says which
batch of which source it was. A batch found there is not inserted again, so
several collectors share a table and a retry writes no file. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.errors import InvalidArgument
from pulsegrid.functions import json_field
from pulsegrid.operators.dedup import TELEMETRY_KEY, distinct_dates, insert_if_absent, prune_dates
from pulsegrid.schema import INSERTED, TELEMETRY
from pulsegrid.session import folder_exists, local_rows, split_by_range


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).parquet(path)


def read_telemetry_jdbc(
    spark: SparkSession, url: str, bounds: tuple[int, int], partitions: int, table: str = "telemetry", **options: str
) -> DataFrame:
    """An existing relational table, read by ``partitions`` tasks split over its ``id``.

    ``bounds`` (smallest and largest id) only place the splits; rows beyond them
    are read too.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    reader = reader.options(partitionColumn="id", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def cluster(rows: DataFrame, order: Sequence[str] = ("event_date", "gpu_id", "timestamp")) -> DataFrame:
    """Range-split and sort for writing. The time in the range key also splits a
    device, or a date, that holds most of the rows."""
    return split_by_range(rows, *order)


def with_key_fields(rows: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Key columns that are not stored as columns are fields of ``data``."""
    absent = {c: F.coalesce(json_field("data", c), F.lit("")) for c in key_cols if c not in rows.columns}
    return rows.withColumns(absent) if absent else rows


class TelemetryTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self, dates: Sequence[date] | None = None) -> DataFrame:
        """The table, or only the folders of some dates; others are not even listed."""
        if dates is None:
            if folder_exists(self.spark, self.path):
                return read_telemetry(self.spark, self.path)
        else:
            folders = [f"{self.path}/event_date={d.isoformat()}" for d in dates]
            present = [f for f in folders if folder_exists(self.spark, f)]
            if present:
                return self.spark.read.schema(TELEMETRY).option("basePath", self.path).parquet(*present)
        return local_rows(self.spark, [], TELEMETRY)

    def inserts(self) -> DataFrame:
        """Batches inserted so far and where they came from: a row each."""
        folder = f"{self.path}/_inserts"
        if not folder_exists(self.spark, folder):
            return local_rows(self.spark, [], INSERTED)
        return self.spark.read.schema(INSERTED).parquet(folder)

    def next_batch_id(self) -> int:
        """One more than the largest batch; only the index is read."""
        last = self.inserts().agg(F.max("batch_id")).first()[0]
        return 0 if last is None else last + 1

    def _find_batch(self, source: str, source_batch: int | None) -> int | None:
        if source_batch is None:
            return None
        same = (F.col("source") == source) & (F.col("source_batch") == source_batch)
        return self.inserts().filter(same).agg(F.min("batch_id")).first()[0]

    def insert(
        self,
        rows: DataFrame,
        order_by: Sequence[str | Column] | None = None,
        batch_id: int | None = None,
        key_cols: Sequence[str] = TELEMETRY_KEY,
        clustered: bool = True,
        source: str = "",
    ) -> DataFrame:
        """Store the rows whose key is new and return them as stored.

        ``order_by`` says which of two rows with one key arrived first. It may
        name columns that are not stored, such as a log offset. ``key_cols`` may
        add fields of ``data`` (``metric_name``) to the key. ``batch_id`` is the
        number of the batch at its ``source``; a batch that was inserted before
        is returned as it is. A row without a timestamp fails the call.
        """
        source_batch, done = batch_id, self._find_batch(source, batch_id)
        dated = with_key_fields(rows.withColumn("event_date", F.to_date("timestamp")), key_cols)
        dates = distinct_dates(dated)
        if done is not None:
            return self.read(dates).filter(F.col("batch_id") == done)
        if dates is not None and None in dates:
            raise InvalidArgument("a row has no timestamp")
        batch_id = self.next_batch_id()
        if source_batch is not None and not source:
            batch_id = max(batch_id, source_batch)
        stored = self.read(dates).filter(F.col("batch_id") != batch_id)
        target = with_key_fields(stored, key_cols)
        if dates is None:
            target = prune_dates(target, dated)
        fresh = insert_if_absent(dated, target, order_by, key_cols).select(
            "gpu_id",
            "timestamp",
            "data",
            F.current_timestamp().alias("created_at"),
            "event_date",
            F.lit(batch_id).cast("bigint").alias("batch_id"),
        )
        write = (cluster(fresh) if clustered else fresh).write.mode("overwrite")
        write.option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch_id").parquet(self.path)
        local_rows(self.spark, [(batch_id, source, source_batch)], INSERTED).coalesce(1).write.mode("append").parquet(
            f"{self.path}/_inserts"
        )
        return self.read(dates).filter(F.col("batch_id") == batch_id)
