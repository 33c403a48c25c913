"""Minimax contiguous partition of atomic groups into shards of near equal size.

Groups (equal texts) lie in digest order. The smallest capacity that lets a
greedy fill use no more than the given shards is found by binary search, and
the order is cut there. The running totals of all groups stay in a table. The
driver holds a summary of bounded size, ranges of totals with their first and
last group end, and asks the table for finer ranges only where the answer still
depends on what lies inside one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import ROW, in_order, staged, table, text_or_empty, with_row_id
from pulsegrid.session import local_rows

SHARDS = 40
ROW_OVERHEAD = 16
# Ranges asked for at once; the summary on the driver has a few times as many.
RANGES = 1 << 14


class GroupEnds:
    """Where the groups end, in bytes from the start, as far as it is known."""

    def __init__(self, ends: DataFrame, last: int, groups: int, ranges: int = RANGES):
        self.ends, self.ranges = ends, ranges
        self.first, self.final, self.count = (np.array([v], dtype=np.int64) for v in (1, last, groups))
        self.refine({0})

    def refine(self, wanted: set[int]) -> None:
        """Split ranges; one whose groups all fit the summary is read group by group."""
        # At least two bins a span, or nothing is split; what is too many for that waits for the next turn.
        ids = sorted(wanted)[: max(1, self.ranges // 2)]
        share = max(2, self.ranges // len(ids))
        spans = [(int(self.first[i]), int(self.final[i])) for i in ids]
        widths = [1 if self.count[i] <= share else -(-(b - a + 1) // share) for i, (a, b) in zip(ids, spans)]
        if self.count[ids].sum() <= self.ranges:
            widths = [1] * len(ids)
        # The spans as literals: a few hundred at most, as each is where a cut may lie.
        low, high, wide = (F.array(*(F.lit(v) for v in c)) for c in ([a for a, _ in spans], [b for _, b in spans], widths))
        near = self.ends.filter(F.col("end").between(spans[0][0], spans[-1][1]))
        near = near.withColumn("span", F.size(F.filter(low, lambda v: v <= F.col("end"))))
        found = (
            near.filter(F.col("end") <= F.element_at(high, F.col("span")))
            .groupBy("span", F.floor((F.col("end") - F.element_at(low, F.col("span"))) / F.element_at(wide, F.col("span"))).alias("bin"))
            .agg(F.min("end").alias("first"), F.max("end").alias("final"), F.count(F.lit(1)).alias("n"))
            .select("first", "final", "n")
            .collect()
        )
        rest = np.setdiff1d(np.arange(len(self.first)), ids)
        fresh = np.array([tuple(r) for r in found], dtype=np.int64).reshape(-1, 3)
        parts = [np.concatenate(p) for p in zip((self.first[rest], self.final[rest], self.count[rest]), fresh.T)]
        order = np.argsort(parts[0])
        self.first, self.final, self.count = (p[order] for p in parts)

    def floor(self, x: int) -> tuple[int, int, int | None]:
        """Bounds of the last end at or before ``x``, and the range to refine when they differ."""
        i = int(np.searchsorted(self.first, x, "right")) - 1
        if i < 0:
            return 0, 0, None
        if x >= self.final[i]:
            return int(self.final[i]), int(self.final[i]), None
        if self.count[i] <= 2:
            return int(self.first[i]), int(self.first[i]), None
        return int(self.first[i]), x, i

    def ceil(self, x: int) -> tuple[int, int, int | None]:
        """The same for the first end at or after ``x``."""
        i = int(np.searchsorted(self.final, x, "left"))
        if i >= len(self.final):
            return int(self.final[-1]), int(self.final[-1]), None
        if x <= self.first[i]:
            return int(self.first[i]), int(self.first[i]), None
        if self.count[i] <= 2:
            return int(self.final[i]), int(self.final[i]), None
        return x, int(self.final[i]), i


def _fits(ends: GroupEnds, capacity: int, shards: int, side: int, open_ranges: set[int] | None = None) -> bool:
    """Greedy check with the lower (0) or upper (1) bound of every cut."""
    at, total = 0, int(ends.final[-1])
    for _ in range(shards):
        bounds = ends.floor(at + capacity)
        if open_ranges is not None and bounds[2] is not None:
            open_ranges.add(bounds[2])
        if bounds[side] <= at:
            return False
        at = bounds[side]
        if at >= total:
            return True
    return False


def smallest_capacity(ends: GroupEnds, shards: int, largest: int) -> int:
    """Binary search for the smallest capacity that a greedy fill can use."""
    total = int(ends.final[-1])

    def first_true(test, low: int, high: int) -> int:
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if test(middle) else (middle + 1, high)
        return low

    least, most = max(largest, -(-total // shards)), total
    while True:
        most = first_true(lambda c: _fits(ends, c, shards, 0), least, most)  # surely enough
        least = first_true(lambda c: _fits(ends, c, shards, 1), least, most)  # below it, surely not
        if least >= most:
            return most
        unsure: set[int] = set()
        for capacity in {least, most, (least + most) // 2}:
            for side in (0, 1):
                _fits(ends, capacity, shards, side, unsure)
        ends.refine(unsure)


def cuts(ends: GroupEnds, shards: int, capacity: int) -> list[int]:
    """Ends of the shards: each as near to an equal share of the rest as the capacity allows."""
    total = int(ends.final[-1])
    while True:
        unsure: set[int] = set()

        def known(bounds: tuple[int, int, int | None]) -> int:
            if bounds[2] is not None:
                unsure.add(bounds[2])
            return bounds[0]

        # What follows the i-th cut must fit the shards left: the earliest places, from the back.
        earliest = [total]
        for _ in range(shards - 1):
            earliest.append(known(ends.ceil(earliest[-1] - capacity)) if earliest[-1] > capacity else 0)
        earliest.reverse()
        at, found = 0, []
        for i in range(shards - 1):
            goal = at + (total - at) / (shards - i)
            latest = known(ends.floor(at + capacity))
            below, above = known(ends.floor(int(goal))), known(ends.ceil(int(goal) + 1))
            near = below if goal - below <= above - goal else above
            at = max(at, min(latest, max(earliest[i], near)))
            found.append(at)
        if not unsure:
            return found
        ends.refine(unsure)


def minimax_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = ROW_OVERHEAD, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The size is the UTF-8 length of the text (null: none) plus ``overhead``. Rows
    of equal texts are one group and share a shard, so a group larger than an
    even share is a shard of its own; null and empty text are one group. Shards
    keep to the smallest possible largest size, near equal where groups allow.
    With fewer groups than shards some stay empty. Slots follow (digest,
    doc_id); repeated rows get slots of their own. Other columns are ignored.
    """
    spark = docs.sparkSession
    body = text_or_empty(text)
    rows = staged(
        with_row_id(
            docs,
            F.col("doc_id").cast("long"),
            (F.octet_length(body).cast("long") + overhead).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body.cast("binary")).alias("digest"),
        ),
        "shard-rows",
    )
    placed = staged(
        in_order(rows, ["digest", "doc_id", ROW], {"before": F.col("size"), "rank": F.lit(1)}, "shard-order"),
        "shard-places",
    )
    groups = placed.groupBy("digest").agg(F.max(F.col("before") + F.col("size")).alias("end"), F.sum("size").alias("bytes"))
    ends = staged(groups.repartitionByRange("end").sortWithinPartitions("end"), "shard-ends")
    last, largest, count = ends.agg(F.max("end"), F.max("bytes"), F.count(F.lit(1))).first()
    found = []
    if count:
        summary = GroupEnds(ends, last, count)
        found = cuts(summary, shards, smallest_capacity(summary, shards, largest))
    shard = sum(((F.col("before") >= c).cast("int") for c in found), F.lit(0))
    placed = placed.withColumn("shard", shard.cast("int"))
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # a row per shard
    starts = local_rows(spark, starts.collect(), starts.schema)
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))
