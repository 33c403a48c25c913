"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word budget. It is filled by whole passes over the source
and by one more, partial pass whose words meet the rest of the budget exactly
where lengths allow: documents are counted by exact length, a proportional
number of every length is taken, and a bounded knapsack over the lengths closes
the gap. Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import ROW, WORD, in_order, row_column, staged, table, text_or_empty, with_row_id
from pulsegrid.session import local_rows

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = 20240501
# Totals of the sources go to the driver; a table with more sources than this is refused.
MAX_SOURCES = 100_000
# Sums that a knapsack over more than the last gap may reach.
KNAPSACK_WORDS = 1 << 20


def share_out(sizes: list[int], weights: list[float], most: int = MOST_TIMES) -> list[float]:
    """Share the sum of ``sizes`` by weight; none gets more than ``most`` times its size.

    What a full source cannot take is shared again by weight among the others.
    """
    targets, full = [0.0] * len(sizes), [s == 0 for s in sizes]
    while not all(full):
        rest = sum(sizes) - sum(t for t, f in zip(targets, full) if f)
        weight = sum(w for w, f in zip(weights, full) if not f)
        targets = [t if f else rest * w / weight for t, f, w in zip(targets, full, weights)]
        over = [i for i, t in enumerate(targets) if not full[i] and t > most * sizes[i]]
        if not over:
            break
        for i in over:
            targets[i], full[i] = float(most * sizes[i]), True
    return targets


def _close_gap(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Add documents to ``take`` by a bounded knapsack so that the words come nearest to ``budget``."""
    take, rest, longest = take.copy(), budget - int((lengths * take).sum()), int(lengths[-1])
    reach, mask = 1, (1 << (rest + longest + 1)) - 1  # bit s: some chosen subset sums to s
    steps: list[tuple[int, int, int]] = []
    for i in order:
        left, size = int(counts[i] - take[i]), 1
        while left > 0 and not reach >> rest & 1 and size * int(lengths[i]) <= rest + longest:
            n = min(size, left)
            steps.append((int(i), n, reach))
            reach |= reach << (n * int(lengths[i])) & mask
            left, size = left - n, size * 2
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    high = reach >> rest
    above = rest + (high & -high).bit_length() - 1 if high else None
    goal = above if above is not None and above - rest < rest - below else below
    for i, n, before in reversed(steps):
        if not before >> goal & 1:
            take[i] += n
            goal -= n * int(lengths[i])
    return take


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of every length to take so that their words sum to ``budget``.

    Starts with the same share of every length, rounded down, goes through the
    lengths in seeded order adding one where it fits, and leaves the last few
    longest lengths' worth to a bounded knapsack. Where that misses the budget,
    the knapsack gets half of the share to place, and then all of it, as long as
    its sums stay within ``KNAPSACK_WORDS``; the nearest result counts.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if 2 * budget > total:  # fewer documents are left out than taken
        return counts - fit_counts(lengths, counts, total - budget, seed)
    order = np.random.default_rng(seed).permutation(len(lengths))
    share = np.minimum(counts, (counts * (budget / total)).astype(np.int64))
    even, rest = share.copy(), budget - int((lengths * share).sum())
    for _ in range(2):
        for i in order:
            if even[i] < counts[i] and rest - lengths[i] >= 2 * lengths[-1]:
                even[i] += 1
                rest -= int(lengths[i])
    best = None
    for begin in (even, share // 2, np.zeros_like(share)):
        if begin is not even and budget - int((lengths * begin).sum()) > KNAPSACK_WORDS:
            break
        take = _close_gap(lengths, counts, begin, budget, order)
        off = abs(int((lengths * take).sum()) - budget)
        if best is None or off < best[0]:
            best = off, take
        if not off:
            break
    return best[1]


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    take = fit_counts(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["budget"].iat[0]))
    return pdf[["src", "size", "n"]].assign(take=take)


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST_TIMES,
    seed: int = SEED,
    row_id: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    The size of a document is its words (null text: none). Sources in code point
    order, null last, have the ``weights`` in turn. ``taken`` is the size times
    how often the document is taken, up to ``most`` times. A document without
    words is taken no words. Equal lengths are told apart by a seeded hash of
    the doc_id, then doc_id, then position, so reruns agree; rows that repeat a
    doc_id count each. ``row_id`` names a column that numbers the rows, which is
    returned too. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = staged(
        with_row_id(
            docs,
            F.col("doc_id").cast("long"),
            F.col("source").cast("string"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("draw"),
            row_id=row_id,
        ),
        "mix-rows",
    )
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size")).take(MAX_SOURCES + 1)
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_source.sort(key=lambda r: (r["source"] is None, r["source"]))
    sizes = [r["source_size"] for r in by_source]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    plan = []
    for i, (r, size, target) in enumerate(zip(by_source, sizes, targets)):
        words = min(round(target), most * size)
        passes = words // size if size else 0
        plan.append((i, r["source"], size, target, passes, words - passes * size))
    schema = T.StructType(
        [T.StructField("src", T.IntegerType()), T.StructField("name", T.StringType())]
        + [T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]
        + [T.StructField("passes", T.LongType()), T.StructField("budget", T.LongType())]
    )
    sources = F.broadcast(local_rows(spark, plan, schema))
    known = rows.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")

    # A row per source and length: what the knapsack sees, whatever the number of documents.
    spoken = known.filter("size > 0")
    lengths = spoken.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"), F.first("budget").alias("budget"))
    chosen = staged(lengths.groupBy("src").applyInPandas(_fit_source, "src int, size long, n long, take long"), "mix-lengths")

    # A document is taken once more if its draw is among the first of its length.
    order = ["src", "size", "draw", "doc_id", ROW]
    ranked = in_order(spoken.select(*order), order, {"rank": F.lit(1)}, "mix-order")
    starts = in_order(chosen, ["src", "size"], {"start": F.col("n")}, "mix-starts")
    more = (
        ranked.join(starts, ["src", "size"])
        .filter(F.col("rank") - F.col("start") < F.col("take"))
        .select(ROW, F.lit(1).alias("more"))
    )
    return known.join(more, ROW, "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("passes") + F.coalesce(F.col("more"), F.lit(0)))).alias("taken"),
        *row_column(row_id),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
