"""Near-duplicate detection by circulant MinHash (C-MinHash, Li and Li 2022).

Two permutations of the 32-bit numbers make a signature of any length: shingles
pass the first once, and coordinate k is the smallest value of the second,
shifted circularly by k. Bands of coordinates propose pairs, and full shingle
sets confirm them.

Texts with equal shingle sets are one class from the start. In a band bucket the
members are not paired with each other: each text is compared with the first
member of its buckets, which settles a group of near copies with one comparison
per member. Texts in buckets that still hold several components, as a passage
shared by many documents makes them, get more and longer bands. Texts that these
leave undecided are compared only where they share one of their rarest shingles:
in a common order from rare to frequent, the first shingle that two similar sets
share lies so early in both that enough of either set follows it (prefix and
position filter of set joins). A shared passage is frequent and meets nobody there.
Variants of one original that are not near each other may meet; a parity bitmap of
each set, which two sets cannot differ in more often than in their shingles,
refuses them before full sets are read (bitmap filter, Sandes et al. 2018). Among the texts with such a shingle the first few are hubs, and then the
next, many times as many in each round, until every pair is linked, compared or
joined through others. So no link is lost that the bands propose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import ROW, in_order, row_column, staged, table, text_or_empty, with_row_id
from pulsegrid.llm.components import components
from pulsegrid.llm.shingles import SPREAD, hash_shingles, hash_words, mix64, text_slices

SHINGLE = 4
# A pair at similarity 0.8 is missed by all bands with probability (1 - 0.8**4)**32 = 5e-8.
BANDS, BAND_ROWS = 32, 4
# The longer bands: (1 - 0.8**8)**100 = 1e-8, and a pair at 0.4 is proposed in 6 of 100 cases.
LONG_BANDS, LONG_ROWS = 100, 8
PERCENT = 80
# 64-bit words of the parity bitmap. Sets of many more shingles than it has bits fill it at random and pass.
PARITY_WORDS = 8
# Members of a bucket that are hubs in the first round, and how many times as many are in each further one.
HUBS, MORE_HUBS = 8, 32
NO_ID = (1 << 63) - 1


def _permute32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers: shifts and odd multipliers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x21F0AAAD)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xD35A2D97)
    x ^= x >> np.uint32(15)
    return x


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of every set; all ones for an empty set."""
    out = np.full((len(sets), size), 0xFFFFFFFF, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    lengths = np.array([len(sets[i]) for i in full])
    first = _permute32((np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32))
    starts = np.cumsum(lengths) - lengths
    for k in range(size):
        out[full, k] = np.minimum.reduceat(_permute32(first - np.uint32(k)), starts)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key per band; equal only for equal coordinates of the same band."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)[None, :].repeat(len(signature), 0)
    for r in range(parts.shape[2]):
        key = mix64(key * SPREAD[0] + parts[:, :, r] * SPREAD[1] + SPREAD[2])
    return key.view(np.int64)


def _sets(part: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    words, bounds = hash_words([t.encode() for t in part.column("text").to_pylist()])
    return [hash_shingles(words[a:b], shingle) for a, b in zip(bounds[:-1], bounds[1:])]


def _profile(shingle: int, bands: int, band_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = _sets(part, shingle)
                keys = band_keys(signatures(sets, bands * band_rows), bands)
                one = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                two = np.array([mix64(s ^ SPREAD[3]).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in (ROW, "doc_id", "text_key"))]
                    + [pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)]
                    + [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.ravel()))],
                    names=[ROW, "doc_id", "text_key", "n", "k1", "k2", "bands"],
                )

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = [s.tobytes() for s in _sets(part, shingle)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _long_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
            sets = [mix64(np.frombuffer(b, np.uint64) ^ SPREAD[4]) for b in part.column("shingles").to_pylist()]
            keys = band_keys(signatures(sets, LONG_BANDS * LONG_ROWS), LONG_BANDS)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * LONG_BANDS, pa.int32()), pa.array(keys.ravel()))],
                names=["node", "bands"],
            )


def _parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set a bitmap; a bit says whether an odd number of its shingles falls there."""
    size = 64 * PARITY_WORDS
    for batch in batches:
        bits = []
        for b in batch.column("shingles").to_pylist():
            place = (mix64(np.frombuffer(b, np.uint64) ^ SPREAD[5]) % np.uint64(size)).astype(np.int64)
            bits.append(np.packbits((np.bincount(place, minlength=size) & 1).astype(np.uint8)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.list_(pa.int64()))], names=["node", "parity"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
            sets = [np.frombuffer(b, np.int64) for b in part.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            nodes = np.repeat(part.column("node").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets))], names=["node", "n", "key"]
            )


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """``key, node, n, rest, parity``: the shingles of every set that may be the first it shares with a similar one.

    Shingles are ordered by how many of the sets have them. ``rest`` counts the
    shared shingles of the set from this one on: no set whose first common
    shingle this is can have more in common with it. ``parity`` is the set's bitmap.
    """
    each = staged(sets.mapInArrow(_shingle_rows, "node long, n long, key long"), "near-shingles")
    spread = each.groupBy("key").agg(F.count(F.lit(1)).alias("spread")).filter("spread > 1")
    backwards = Window.partitionBy("node").orderBy(F.desc("spread"), F.desc("key"))
    placed = each.join(spread, "key").withColumn("rest", F.row_number().over(backwards))
    placed = placed.filter(100 * F.col("rest") >= percent * F.col("n")).select("key", "node", "n", "rest")
    return placed.join(sets.mapInArrow(_parity, "node long, parity array<long>"), "node")


def may_be_similar(percent: int) -> Column:
    """Whether members (n, rest, parity) and (m, left, other) of a rare shingle can be similar; false only if they are not."""
    sizes = F.col("n") + F.col("m")
    enough = (100 + percent) * F.least("rest", "left") >= percent * sizes
    differ = sum(F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("other")[i])) for i in range(PARITY_WORDS))
    return enough & ((100 + percent) * differ <= (100 - percent) * sizes)


def _several(buckets: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, with the component of each member."""
    now = buckets.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = staged(now, "near-open")
    several = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return now.join(several.filter("x < y").select("key"), "key")


def _placed(buckets: DataFrame) -> DataFrame:
    """The same with the ``size`` of each member's bucket and its ``place`` there, which follows the node."""
    rows = staged(in_order(buckets, ["key", "node"], {"place": F.lit(1)}, "near-order"), "near-order")
    starts = rows.groupBy("key").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("size"))
    return rows.join(starts, "key").withColumn("place", F.col("place") - F.col("start")).drop("start")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with whether their full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    both = pairs.join(two, "b").join(one, "a")
    return staged(both.select("a", "b", "one", "two").mapInArrow(_confirm(percent), "a long, b long, linked boolean"), "near-links")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    text: str = "text",
    row_id: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    A document's set has the distinct ``shingle``-word shingles of its text with
    A-Z in lower case; a shorter text is one shingle. Documents whose sets
    overlap by ``percent`` of their union are linked; the component is the
    smallest doc_id reachable by links, and its document is kept. A null, empty
    or blank text is linked with nothing and kept. Rows that repeat a doc_id are
    linked by their texts; all rows with the component's doc_id count as kept
    except repeated rows of one class, of which one is. A null doc_id yields to
    any other. ``row_id`` names a column that numbers the rows, which is returned
    too. Other columns are ignored. An empty table gives no rows.
    """
    source = docs.select(
        F.col("doc_id").cast("long"), text_or_empty(text).alias("text"), F.md5(text_or_empty(text).cast("binary")).alias("text_key"),
        *([] if row_id is None else [F.col(row_id).alias(ROW)]),
    )
    profile = f"{ROW} long, doc_id long, text_key string, n long, k1 long, k2 long, bands array<long>"
    rows = staged(
        with_row_id(source, "doc_id", "text", "text_key", row_id=None if row_id is None else ROW).select(ROW, "doc_id", "text", "text_key").mapInArrow(_profile(shingle, bands, band_rows), profile),
        "near-rows",
    )
    spoken = rows.filter("n > 0")
    rank = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col(ROW).alias("node"))
    classes = spoken.groupBy("n", "k1", "k2").agg(F.min(rank).alias("rep"), F.count(F.lit(1)).alias("copies"))
    member = staged(
        spoken.select(ROW, "doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"])
        .select(ROW, "doc_id", "n", F.col("rep.node").alias("node"), F.col("rep.id").alias("node_id")),
        "near-classes",
    )

    # Bands of one text per class; buckets with a single class propose nothing.
    first = member.filter(F.col(ROW) == F.col("node")).select("node")
    keys = rows.select(F.col(ROW).alias("node"), "bands").join(first, "node").select("node", F.explode("bands").alias("key"))
    keys = staged(keys, "near-bands")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("hub")).filter("members > 1")
    buckets = staged(keys.join(shared, "key"), "near-buckets")

    # Full sets of the texts that any bucket proposes.
    wanted = buckets.select("node").distinct().join(rows.select(F.col(ROW).alias("node"), "doc_id", "text_key"), "node")
    wanted = wanted.select("node", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_key")
    texts = source.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_key", "text").join(wanted, ["id", "text_key"])
    sets = staged(
        texts.select("node", "text").mapInArrow(_full_sets(shingle), "node long, shingles binary").dropDuplicates(["node"]), "near-sets"
    )

    # First each text with the first member of any of its buckets.
    pairs = buckets.filter("hub < node").groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("b"))
    checked = _linked(pairs, sets, percent)
    joined = staged(components(checked.filter("linked").select("a", "b")), "near-components")
    # Longer bands for the texts of buckets that hold several components.
    unsure = _several(buckets.select("key", "node"), joined).select("node").distinct()
    bands2 = sets.join(unsure, "node", "left_semi").mapInArrow(_long_bands, "node long, bands array<long>")
    keys = staged(bands2.select("node", F.explode("bands").alias("key")), "near-bands")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key")
    unsure = _several(keys.join(shared, "key"), joined).select("node").distinct()
    buckets = staged(rare_shingles(sets.join(unsure, "node", "left_semi"), percent), "near-buckets")
    # A bucket is open or closed as a whole, so sizes and places hold for all rounds.
    buckets = staged(_placed(_several(buckets, joined).drop("component")), "near-buckets")
    begin, width, open_ = 0, HUBS, None
    while True:
        if open_ is None:  # components have changed
            open_ = staged(_several(buckets.filter(F.col("size") > begin + 1), joined), "near-open")
            largest = open_.agg(F.max("size")).first()[0] or 0
        if largest <= begin + 1:
            break
        members = open_.filter(F.col("size") > begin + 1)
        hubs = members.filter((F.col("place") >= begin) & (F.col("place") < begin + width))
        hubs = hubs.select(
            "key", F.col("node").alias("b"), F.col("component").alias("of"), F.col("n").alias("m"), F.col("rest").alias("left"), F.col("parity").alias("other")
        )
        fresh = members.join(hubs, "key").filter((F.col("b") < F.col("node")) & (F.col("of") != F.col("component")) & may_be_similar(percent))
        fresh = staged(fresh.select(F.col("node").alias("a"), "b").distinct().join(checked, ["a", "b"], "left_anti"), "near-fresh")
        begin, width = begin + width, width * MORE_HUBS
        if fresh.isEmpty():
            continue
        more = _linked(fresh, sets, percent)
        checked = checked.unionByName(more)
        linked = more.filter("linked").select("a", "b")
        if not linked.isEmpty():
            links = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(linked)
            joined, open_ = staged(components(links), "near-components"), None

    whole = member.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min(F.struct("node_id", "node")).alias("least"))
    known = whole.join(least, "component").select(
        ROW,
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("least.node_id") < NO_ID, F.col("least.node_id")).alias("component_id"),
        (F.col(ROW) == F.col("least.node")).alias("kept"),
    )
    silent = rows.filter("n = 0").select(ROW, "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return known.unionByName(silent).select("doc_id", "n_shingles", "component_id", "kept", *row_column(row_id))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [md5(array_to_string(words, ' '))]
    ELSE list_transform(range(1, len(words) - 2), lambda i: md5(array_to_string(words[i:i + 3], ' '))) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""
