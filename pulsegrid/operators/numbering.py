"""Dense offsets per log partition, however few partitions there are.

A window over the log partition would sort each one in a single task, and one
partition may hold a third of all messages. Instead the arrival order is cut into
ranges at bounds drawn from a sample. The bounds are literals, so every pass puts
a row into the same range: one pass counts the rows of each partition and range,
and the next numbers the rows inside them and adds what lies before. Nothing is
staged. A small input is one range, and needs neither bounds nor counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.errors import InvalidArgument
from pulsegrid.operators.records import as_rejects
from pulsegrid.session import checked_broadcast, has_at_most, input_size, range_count

LOG_KEYS = ("topic", "partition")
# Inputs of up to so many bytes, or rows where the size is unknown, are one range.
SINGLE_BYTES = 32 << 20
SINGLE_ROWS = 200_000
# Rows drawn per range, and the most ranges: their bounds are literals of the plan.
DRAWN = 64
MOST_RANGES = 4096

# A column with a direction, as it prints.
SORTED = re.compile(r" (ASC|DESC) NULLS (FIRST|LAST)'>$")

PARTITION_FULL = "partition_full"


def plan_ranges(df: DataFrame) -> int:
    """How many ranges the rows are cut into."""
    size = input_size(df)
    if size is None and has_at_most(df, SINGLE_ROWS) or size is not None and size <= SINGLE_BYTES:
        return 1
    return min(MOST_RANGES, range_count(df) or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _plain(value: Column, kind: T.DataType) -> Column:
    """An order column as something that sorts the same and has literals: instants become numbers."""
    if isinstance(kind, T.StructType):
        fields = [_plain(value.getField(f.name), f.dataType).alias(f"k{i}") for i, f in enumerate(kind.fields)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    return F.unix_date(value) if isinstance(kind, T.DateType) else value


def _literal(value: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)))
    return F.lit(value).cast(kind)


def order_key(df: DataFrame, order_by: Sequence[str | Column]) -> Column:
    """The order columns as one comparable value."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if any(SORTED.search(str(c)) for c in columns):
        raise InvalidArgument("a large input is numbered in ascending order of plain columns only")
    kinds = df.select(*columns).schema
    return F.struct(*(_plain(c, f.dataType).alias(f"k{i}") for i, (c, f) in enumerate(zip(columns, kinds.fields))))


def range_bounds(df: DataFrame, key: Column, ranges: int) -> tuple[list[Any], T.DataType]:
    """Ascending bounds between the ranges, from a uniform sample (the rows of the smallest hashes)."""
    keys = df.select(key.alias("key"), F.monotonically_increasing_id().alias("row"))
    drawn = keys.withColumn("draw", F.xxhash64("row", F.lit(1))).orderBy("draw").limit(DRAWN * ranges).select("key")
    found = [r[0] for r in drawn.orderBy("key").collect()]
    step = max(1, len(found) // ranges)
    bounds: list[Any] = []
    for value in found[step::step]:
        if not bounds or value != bounds[-1]:
            bounds.append(value)
    return bounds, keys.schema["key"].dataType


def with_range(df: DataFrame, key: Column, bounds: list[Any], kind: T.DataType, name: str = "_range") -> DataFrame:
    """Add how many bounds lie at or below the key, by halving.

    Each step is a projection of its own, so that all of them are compiled and the
    key is built once; a lambda over the bounds would be interpreted row by row.
    """
    if not bounds:
        return df.withColumn(name, F.lit(0))
    table = F.array(*(_literal(b, kind) for b in bounds))
    found = df.withColumns({"_range_key": key, name: F.lit(0)})
    for step in (1 << i for i in reversed(range(len(bounds).bit_length()))):
        # Beyond the last bound there is none, and the comparison is null.
        lies_right = F.get(table, F.col(name) + step - 1) <= F.col("_range_key")
        found = found.withColumn(name, F.when(lies_right, F.col(name) + step).otherwise(F.col(name)))
    return found.drop("_range_key")


def number_rows(
    df: DataFrame,
    order_by: Sequence[str | Column],
    keys: Sequence[str] = LOG_KEYS,
    name: str = "position",
    ranges: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add a dense 0-based ``name`` per ``keys`` in ``order_by`` order.

    ``order_by`` must be a total order inside each key; without ``keys`` the
    whole input is one sequence. ``df`` is evaluated up to three times and must
    give the same rows each time. ``source`` are the same rows for the last
    evaluation, with an observation for instance.
    """
    keys = list(keys)
    rows = df if source is None else source
    ranges = plan_ranges(df) if ranges is None else ranges
    if ranges == 1:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
        return rows.select("*", (place - 1).cast("bigint").alias(name))
    key = order_key(df, order_by)
    bounds, kind = range_bounds(df, key, ranges)
    counts = with_range(df, key, bounds, kind).groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order_by))
    numbered = with_range(rows, key, bounds, kind).withColumn("_place", place - 1).join(checked_broadcast(shift), [*keys, "_range"])
    return numbered.select(*rows.columns, (F.col("_place") + F.col("_shift")).cast("bigint").alias(name))


def append_offsets(
    routed: DataFrame,
    order_by: Sequence[str | Column],
    tails: DataFrame | None = None,
    ranges: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Number routed messages in arrival order, continuing at the current tail.

    ``tails`` is ``topic, partition, tail_offset``; partitions it lacks start at 0.
    """
    numbered = number_rows(routed, order_by, name="offset", ranges=ranges, source=source)
    if tails is None:
        return numbered
    seed = tails.select(*LOG_KEYS, F.col("tail_offset").alias("_tail"))
    joined = numbered.join(checked_broadcast(seed), list(LOG_KEYS), "left")
    return joined.withColumn("offset", F.col("offset") + F.coalesce("_tail", F.lit(0))).select(*numbered.columns)


def assign_row_ids(rows: DataFrame, order_by: Sequence[str | Column], start: int = 1, ranges: int | None = None) -> DataFrame:
    """Add ``id``, consecutive in arrival order from ``start``."""
    return number_rows(rows, order_by, keys=(), name="id", ranges=ranges).withColumn("id", F.col("id") + start)


def within_capacity(capacity: Column, base: Column) -> Column:
    """Whether an offset fits: capacity of zero or less means unlimited."""
    return (capacity <= 0) | (F.col("offset") - base < capacity)


def apply_capacity(
    numbered: DataFrame, partitions: DataFrame, bases: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split numbered messages into those that fit their partition and the rest.

    ``partitions`` carries ``topic, partition, capacity``. Offsets are dense and
    arrival-ordered, so exactly the messages past the capacity are refused and
    no accepted offset has a gap.
    """
    limits = partitions.select(*LOG_KEYS, "capacity")
    if bases is not None:
        limits = limits.join(bases, list(LOG_KEYS), "left")
    else:
        limits = limits.withColumn("base_offset", F.lit(0).cast("bigint"))
    limits = limits.withColumn("base_offset", F.coalesce("base_offset", F.lit(0)))
    marked = numbered.join(checked_broadcast(limits), list(LOG_KEYS), "left").withColumn(
        "_fits", F.coalesce(within_capacity(F.col("capacity"), F.col("base_offset")), F.lit(True))
    )
    kept = marked.filter("_fits").select(*numbered.columns)
    full = marked.filter(~F.col("_fits")).select(
        F.lit(PARTITION_FULL).alias("reason"),
        F.col("payload").alias("raw") if "payload" in numbered.columns else F.lit(None).alias("raw"),
        *LOG_KEYS,
    )
    return kept, as_rejects(full)
