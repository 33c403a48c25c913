"""First arrival wins, inside a batch and against a stored table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import BROADCAST_ROWS, has_at_most

TELEMETRY_KEY = ("gpu_id", "timestamp")
# Above this many distinct dates a batch is pruned by its date span instead.
PRUNE_DATES = 366


def dedup_first(
    rows: DataFrame, order_by: Sequence[str | Column], key_cols: Sequence[str] = TELEMETRY_KEY
) -> DataFrame:
    """One row per key: the one that arrived first.

    Each task keeps the first row of every key before the shuffle (a group
    limit), so a key that is repeated a billion times crosses the network once
    per task.
    """
    place = F.row_number().over(Window.partitionBy(*key_cols).orderBy(*order_by))
    return rows.withColumn("_place", place).filter("_place = 1").select(*rows.columns)


def distinct_dates(batch: DataFrame, date_col: str = "event_date") -> list[date] | None:
    """The dates of a batch, or None when there are more than ``PRUNE_DATES``."""
    dates = [r[0] for r in batch.select(date_col).distinct().limit(PRUNE_DATES + 1).collect()]
    return dates if len(dates) <= PRUNE_DATES else None


def prune_dates(target: DataFrame, batch: DataFrame, date_col: str = "event_date") -> DataFrame:
    """The partitions of ``target`` that a batch can touch, as literal predicates.

    Late rows reach old dates, so the dates come from the batch itself. A batch
    with more dates than ``PRUNE_DATES`` is cut to its first and last date,
    which is a superset.
    """
    dates = distinct_dates(batch, date_col)
    if dates is not None:
        return target.filter(F.col(date_col).isin(dates)) if dates else target.filter(F.lit(False))
    low, high = batch.agg(F.min(date_col), F.max(date_col)).first()
    return target.filter(F.col(date_col).between(low, high))


def insert_if_absent(
    batch: DataFrame,
    target: DataFrame,
    order_by: Sequence[str | Column] | None = None,
    key_cols: Sequence[str] = TELEMETRY_KEY,
    date_col: str | None = None,
    small_batch: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows of ``batch`` whose key ``target`` lacks; stored rows never change.

    ``order_by`` de-duplicates the batch first. ``date_col`` prunes the target.
    A small batch does not shuffle the target: the target is cut down to the
    batch's keys by a broadcast semi join, and only what is left is compared.
    """
    keys = list(key_cols)
    fresh = dedup_first(batch, order_by, keys) if order_by is not None else batch
    if date_col is not None:
        target = prune_dates(target, batch, date_col)
    known = target.select(*keys)
    if has_at_most(batch, small_batch):
        known = known.join(batch.select(*keys).hint("broadcast"), keys, "left_semi")
    return fresh.join(known, keys, "left_anti")


def find_duplicates(rows: DataFrame, key_cols: Sequence[str] = TELEMETRY_KEY) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def count_duplicate_keys(rows: DataFrame, key_cols: Sequence[str] = TELEMETRY_KEY) -> DataFrame:
    return find_duplicates(rows, key_cols).agg(F.count(F.lit(1)).alias("duplicate_keys"))
