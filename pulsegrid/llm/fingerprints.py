"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Paragraphs are lines; long lines are cut into chunks of some words at places that
follow from the words there, so an edit changes the chunks it touches only.

Every paragraph digest falls into one cell of each of three subtables; a cell
has the number of digests, their xor and the xor of their checks. Subtracting
the cells of two texts leaves the digests they do not share. A cell left with a
single digest gives it away, and taking it out of its other cells may free more.

The fingerprint is a sketch of fixed size. Where the difference of two
fingerprints does not peel, the digests are dealt into buckets by their leading
bits, and a larger sketch per bucket is subtracted and peeled, subtable by subtable
and only in cells that hold something; what gets stuck is tried again with more
cells. All of it happens inside a row: only the texts are shuffled, once, to meet
the next document.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import table, text_or_empty
from pulsegrid.session import local_rows

SUBTABLES = 3
# Cells per subtable of the fingerprint itself.
BASE_CELLS = 4
# Rounds of peeling before a difference counts as stuck; each goes through one subtable.
ROUNDS = 12
# Digests of both texts in a bucket of the larger sketches, about.
BUCKET = 16
# Cells per subtable of a bucket, in the order they are tried. By estimate, all fail for one bucket of 16 in about 1e17.
BUCKET_CELLS = (8, 16, 64, 256, 1024)
# Lines of more code points are cut, between two tokens in MEAN_CHUNK.
WHOLE_LINE = 128
MEAN_CHUNK = 8
# A word; of more than 33 code points without white space, each but the last ones.
TOKEN = r"\S(?=\S{32})|\S+?(?=\s|$|\S{33})"
# Bytes of a block of consecutive ids, about.
BLOCK_BYTES = 64 << 20
LEAST_ID = -(1 << 63)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``; a lambda's argument is worked out once, an expression inside it for every element.

    The value is the start of an aggregate over nothing: unlike a transform, it copies no result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the lines of a text that are not blank, long ones by chunk."""
    lines = F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")
    units = F.transform(lines, lambda p: F.when(F.length(p) > WHOLE_LINE, _chunks(p)).otherwise(F.array(F.xxhash64(p))))
    return F.array_distinct(F.flatten(units))


def _chunks(line: Column) -> Column:
    """Digests of the chunks of a line, cut where the hash of two neighbouring tokens says so."""

    def cut(tokens: Column) -> Column:
        n = F.size(tokens)
        starts_here = lambda i: (i == 1) | (F.pmod(F.xxhash64(F.get(tokens, i - 2), F.get(tokens, i - 1)), F.lit(MEAN_CHUNK)) == 0)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), starts_here)
        return _once(starts, lambda at: F.transform(at, lambda s, i: F.xxhash64(F.slice(tokens, s, F.coalesce(F.get(at, i + 1), n + 1) - s))))

    return _once(F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0)), cut)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _cell(digest: Column, subtable: int, cells: int) -> Column:
    """Cell of a digest in a subtable, counted through all subtables."""
    return (F.pmod(F.xxhash64(digest, F.lit(subtable), F.lit(cells)), F.lit(cells)) + subtable * cells).cast("int")


def _entry(digest: Column, cells: int) -> Column:
    """A digest with its check and its cells."""
    return F.struct(digest.alias("k"), _check(digest).alias("h"), *(_cell(digest, j, cells).alias(f"c{j}") for j in range(SUBTABLES)))


def sketch(digests: Column, cells: int = BASE_CELLS) -> Column:
    """The cells of all subtables: number of digests, xor, xor of checks."""

    def subtable(entries: Column, j: int) -> Column:
        def cell(own: Column) -> Column:
            xor = lambda name: F.aggregate(own, F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(e[name]))
            return F.struct(F.size(own).alias("n"), xor("k").alias("k"), xor("h").alias("h"))

        at = F.sequence(F.lit(j * cells), F.lit((j + 1) * cells - 1))
        return F.transform(at, lambda i: _once(F.filter(entries, lambda e: e[f"c{j}"] == i), cell))

    return _once(F.transform(digests, lambda d: _entry(d, cells)), lambda e: F.concat(*(subtable(e, j) for j in range(SUBTABLES))))


def fingerprint(n_digests: Column, cells: Column) -> Column:
    """A sketch as text: number of digests, then count, xor and check of every cell in hexadecimal."""
    shown = F.transform(cells, lambda c: F.concat_ws(".", F.hex(c["n"]), F.hex(c["k"]), F.hex(c["h"])))
    return F.concat_ws("-", F.hex(n_digests), F.array_join(shown, "-"))


def peel(ours: Column, theirs: Column, cells: int) -> Column:
    """How many digests the difference of two sketches holds, null where ROUNDS rounds do not empty it.

    A round goes through one subtable. Its cells that hold a single digest hold
    different ones, so all of them are taken out.
    """

    def less(x: Column, y: Column) -> Column:
        return F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))

    def state(left: Column, found: Column) -> Column:
        return F.struct(left.alias("left"), found.cast("int").alias("found"))

    def without(s: Column, alone: Column) -> Column:
        def take_out(entry: Column) -> Column:
            gone = F.struct(alone["n"].alias("n"), entry["k"].alias("k"), entry["h"].alias("h"))
            parts, begin = [], F.lit(0)
            for j in range(SUBTABLES):  # places ascend: a subtable follows the other
                at = entry[f"c{j}"]
                parts += [F.slice(s["left"], begin + 1, at - begin), F.array(less(F.get(s["left"], at), gone))]
                begin = at + 1
            rest = F.slice(s["left"], begin + 1, F.lit(SUBTABLES * cells))
            return state(F.concat(*parts, rest), s["found"] + 1)

        return _once(_entry(alone["k"], cells), take_out)

    def one_round(s: Column, r: Column) -> Column:
        subtable = F.slice(s["left"], (r % SUBTABLES) * cells + 1, cells)
        single = F.filter(subtable, lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"])))
        return F.aggregate(single, s, without)

    start = state(F.zip_with(ours, theirs, less), F.lit(0))
    empty = lambda s: F.forall(s["left"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round, lambda s: F.when(empty(s), s["found"]))


def _cells_of(entries: Column, cell: Callable[[Column], Column]) -> Column:
    """The entries ``n, k`` by their cell, an array for each cell that has any."""

    def cut(e: Column) -> Column:
        of = lambda i: F.get(e, i)["c"]
        at = F.filter(F.transform(e, lambda _, i: i), lambda i: (i == 0) | (of(i) != of(i - 1)))
        return _once(at, lambda at: F.transform(at, lambda s, i: F.slice(e, s + 1, F.coalesce(F.get(at, i + 1), F.size(e)) - s)))

    return _once(F.sort_array(F.transform(entries, lambda e: F.struct(cell(e["k"]).alias("c"), e["n"].alias("n"), e["k"].alias("k")))), cut)


def _open(own: Column) -> Column:
    """Whether the difference in a cell is neither empty nor a single digest."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    add = lambda a, e: F.struct((a["n"] + e["n"]).alias("n"), a["k"].bitwiseXOR(e["k"]).alias("k"), a["h"].bitwiseXOR(_check(e["k"])).alias("h"))
    empty = lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0)
    single = lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"]))
    return (F.size(own) > 1) & F.aggregate(own, zero, add, lambda c: ~(empty(c) | single(c)))


def differing(ours: Column, theirs: Column) -> Column:
    """How many digests two texts do not share, from the differences of sketches per bucket.

    A bucket has the digests of the same leading bits. A round works out one subtable
    of all buckets, as far as its cells have anything. What lies in a cell that is
    empty or holds a single digest is settled: to take it out of the other subtables
    is to leave it out when their cells are added up, as cells are sums. What is
    stuck goes on with more cells, and what no sketch of a bucket peels is counted
    from its digests.
    """
    bits = F.greatest(F.lit(1), F.ceil(F.log2((F.size(ours) + F.size(theirs) + 1) / BUCKET))).cast("int")
    signed = lambda digests, n: F.transform(digests, lambda d: F.struct(F.lit(0).cast("long").alias("c"), F.lit(n).alias("n"), d.alias("k")))
    odd = lambda by_cell: F.size(F.filter(by_cell, lambda own: F.size(own) % 2 == 1))

    def state(left: Column, found: Column) -> Column:
        return F.struct(left.alias("left"), found.cast("int").alias("found"))

    def one_round(s: Column, r: Column, b: Column, cells: int) -> Column:
        def cell(k: Column) -> Column:
            # Spark's shiftright keeps the sign, so buckets follow the order of the digests.
            return F.call_function("shiftright", k, F.lit(64) - b) * cells + F.pmod(F.xxhash64(k, r % SUBTABLES, F.lit(cells)), F.lit(cells))

        def settle(by_cell: Column) -> Column:
            # A cell of odd size that is settled held a single digest, beside shared ones.
            return _once(F.filter(by_cell, _open), lambda rest: state(F.flatten(rest), s["found"] + odd(by_cell) - odd(rest)))

        return F.when(F.size(s["left"]) == 0, s).otherwise(_once(_cells_of(s["left"], cell), settle))

    def rounds(s: Column, b: Column, cells: int) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), s, lambda s, r: one_round(s, r, b, cells))

    def counted(s: Column) -> Column:
        of = lambda n: F.transform(F.filter(s["left"], lambda e: e["n"] == n), lambda e: e["k"])
        rest = _once(of(1), lambda x: _once(of(-1), lambda y: F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))))
        return s["found"] + F.when(F.size(s["left"]) == 0, 0).otherwise(rest)

    def peeled(b: Column) -> Column:
        s = state(F.concat(signed(ours, 1), signed(theirs, -1)), F.lit(0))
        for cells in BUCKET_CELLS:
            s = rounds(s, b, cells)
        return _once(s, counted)

    return _once(bits, peeled)


def likeness(ours: Column, our_sketch: Column, theirs: Column, their_sketch: Column) -> Column:
    """Shared digests over all digests of two texts, from their sketches' difference; 1 where neither has any."""
    sizes = F.size(ours) + F.size(theirs)
    found = F.coalesce(peel(our_sketch, their_sketch, BASE_CELLS), differing(ours, theirs))
    return F.when(sizes == 0, 1.0).otherwise(_once(found, lambda n: (sizes - n) / (sizes + n)))


def _edges_below(value: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are at most ``value``: first by every k-th edge, then inside that stretch."""
    step = math.isqrt(len(edges)) + 1

    def longs(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def stretch(i: Column) -> Column:
        return i * step + F.size(F.filter(F.slice(longs(edges), i * step + 1, step), lambda e: e <= value))

    return _once(F.greatest(F.size(F.filter(longs(edges[::step]), lambda e: e <= value)) - 1, F.lit(0)), stretch)


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows (id, text, digests) with ``next_text`` and ``next_digests`` of the next smaller id, at the end the largest.

    Blocks of consecutive ids are sorted each in a task. The first document of a
    block is also dealt to the block before it, so texts are shuffled once.
    """
    spark = docs.sparkSession
    if blocks is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES)
    bounds = sorted(set(docs.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [i / blocks for i in range(1, blocks)], 0.25 / blocks)))
    edges = [int(b) for b in bounds] or [0]
    # Descending ids: block 0 has the largest.
    block = F.lit(len(edges)) - _edges_below(F.col("id"), edges)
    dealt = docs.withColumn("block", block.cast("int"))
    tops = sorted((r["block"], r["top"]) for r in dealt.groupBy("block").agg(F.max("id").alias("top")).collect())
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("top", T.LongType()), T.StructField("guest_of", T.IntegerType())])
    # The block before, among those with documents; before the first comes the last.
    guests = local_rows(spark, [(b, top, tops[i - 1][0]) for i, (b, top) in enumerate(tops)], schema)
    both = dealt.join(F.broadcast(guests), "block").select(
        "id", "text", "digests",
        F.explode(
            F.when(
                F.col("id") == F.col("top"),
                F.array(F.struct("block", F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("block"), F.lit(True).alias("guest"))),
            ).otherwise(F.array(F.struct("block", F.lit(False).alias("guest"))))
        ).alias("b"),
    ).select("id", "text", "digests", "b.block", "b.guest")
    w = Window.partitionBy("block").orderBy("guest", F.desc("id"), "text")
    return (
        both.repartition(max(len(tops), 1), "block")
        .withColumns({"next_text": F.lead("text").over(w), "next_digests": F.lead("digests").over(w)})
        .filter(~F.col("guest"))
    )


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last third (code points, rounded down) replaced by
    as many first code points of the next document, or all of it where that is
    shorter. Next is by descending doc_id, a null doc_id last; rows that repeat a
    doc_id follow each other by text; after the last document comes the first,
    so a table of one document is its own next. Paragraphs are lines, those of more
    than WHOLE_LINE code points chunks of some words; blank ones and repetitions
    do not count. A null text counts as empty, and two texts
    without paragraphs are alike (1). Other columns are ignored. An empty table
    gives no rows.
    """
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), text_or_empty(text).alias("text"))
    rows = with_next(body.withColumn("digests", paragraph_digests(F.col("text"))))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_digests", paragraph_digests(F.col("edited")))
    sides = ("digests", "edited_digests", "next_digests")
    rows = rows.withColumns({f"{d}_sketch": sketch(F.col(d)) for d in sides})

    def near(other: str) -> Column:
        return likeness(F.col("digests"), F.col("digests_sketch"), F.col(other), F.col(f"{other}_sketch"))

    return rows.select(
        F.nullif("id", F.lit(LEAST_ID)).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.size("digests"), F.col("digests_sketch")).alias("fingerprint"),
        fingerprint(F.size("edited_digests"), F.col("edited_digests_sketch")).alias("edited_fingerprint"),
        near("edited_digests").alias("near_edited"),
        near("next_digests").alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
