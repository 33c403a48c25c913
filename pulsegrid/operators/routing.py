"""Which log partition a key belongs to."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.errors import InvalidArgument
from pulsegrid.functions import fnv1a32, fnv1a32_text
from pulsegrid.schema import DEFAULT_REPLICAS

Router = Callable[[Column], Column]


def route_modulo(partitions: int) -> Router:
    """Hash of the key modulo the partition count; an empty key goes to 0."""
    if partitions <= 0:
        raise InvalidArgument("a topic needs at least one partition")

    def route(key: Column) -> Column:
        return F.when(key == "", F.lit(0)).otherwise((fnv1a32(key) % F.lit(partitions)).cast("int"))

    return route


def ring_points(topic: str, partitions: int, replicas: int = DEFAULT_REPLICAS) -> list[tuple[int, int]]:
    """Sorted ``(hash, partition)`` points; on a collision the later partition wins."""
    partitions = partitions if partitions > 0 else 1
    replicas = replicas if replicas > 0 else DEFAULT_REPLICAS
    owner = {
        fnv1a32_text(f"{topic}-{part}-{copy}"): part for part in range(partitions) for copy in range(replicas)
    }
    return sorted(owner.items())


def route_ring(topic: str, partitions: int, replicas: int = DEFAULT_REPLICAS) -> Router:
    """Consistent hashing: the first ring point at or after the key's hash, else the first point.

    The hash space is cut into equal slots, about one per point. Each slot
    holds its own points and the one that follows, so a row looks at a handful
    of points however large the ring is.
    """
    points = ring_points(topic, partitions, replicas)
    bits = max(1, (len(points) - 1).bit_length())
    width = 32 - bits
    hashes = [h for h, _ in points]
    slots = []
    for slot in range(1 << bits):
        first = bisect_left(hashes, slot << width)
        last = bisect_left(hashes, (slot + 1) << width)
        inside = [{"h": h, "p": p} for h, p in points[first:last]]
        after = points[last] if last < len(points) else (1 << 32, points[0][1])
        slots.append(inside + [{"h": after[0], "p": after[1]}])
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<h:bigint,p:int>>>")

    def route(key: Column) -> Column:
        h = fnv1a32(key)
        near = F.get(table, F.shiftright(h, width).cast("int"))
        hit = F.get(F.filter(near, lambda point: point["h"] >= h), F.lit(0))
        return F.when(key == "", F.lit(0)).otherwise(hit["p"])

    return route


def route_messages(
    messages: DataFrame, topic: str, router: Router, partitions: int, on_range_error: str = "raise"
) -> DataFrame:
    """Add ``topic`` and ``partition``.

    A router of the caller's own may answer outside ``[0, partitions)``. That
    raises, or with ``on_range_error='null'`` leaves ``partition`` NULL so that
    the row can be set aside.
    """
    placed = router(F.col("key")).cast("int")
    inside = (placed >= 0) & (placed < partitions)
    if on_range_error == "raise":
        checked = F.when(inside, placed).otherwise(
            F.raise_error(F.concat(F.lit("partition out of range: "), F.coalesce(placed.cast("string"), F.lit("NULL")))).cast("int")
        )
    elif on_range_error == "null":
        checked = F.when(inside, placed)
    else:
        raise InvalidArgument("on_range_error is 'raise' or 'null'")
    return messages.withColumn("topic", F.lit(topic)).withColumn("partition", checked)
