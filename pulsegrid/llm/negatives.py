"""Hard negatives from an inverted multi-index.

Two codebooks quantise the halves of a vector; a pair of centroids is a cell and
every row lies in one. A row's inner product with an anchor is at most the sum,
over the halves, of anchor times centroid plus anchor norm times the centroid's
radius (its farthest row). An anchor walks the cells in falling order of that sum
with a heap over the two sorted lists, and stops once the bound of the next cell
certifies what it has: no unseen row can change its windows.

Rows of cells are packed into bins of bounded size (a large cell has several),
anchors into chunks, and a task scores the anchors of a chunk that visit cells of
a bin. The index is fitted on a bounded sample, holds every row, and the answer
is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import staged, table
from pulsegrid.session import local_rows

# The codebooks are fitted on about so many rows, drawn by a hash of their id.
SAMPLE = 16_384
ITERATIONS = 8
# Rows of an average cell, and the largest number of centroids of a half.
CELL_ROWS = 32
MOST_CENTROIDS = 256
# Rows of a bin and anchors of a chunk: what one task scores at once.
BIN_ROWS = 4096
CHUNK_ANCHORS = 4096
SLICE = 256
# An anchor's first turn takes cells of so many rows, every later one so many times more.
FIRST_ROWS = 4096
GROWTH = 8
# Slack for the rounding of bounds; scores are whole numbers.
SLACK = 1e-6
POSITIVES = 5
NEGATIVES = 5

FOUND = "array<struct<w:int,score:long,vec_id:long,row:long>>"
STATE = f"anchor long, anchor_id long, label int, vec array<long>, windows array<long>, ids array<long>, found {FOUND}, pos int"
HITS = "anchor long, w int, score long, vec_id long, row long"


def prepare(embeddings: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """``row, vec_id, label, vec``: the rows that take part, components as whole numbers."""
    vector = F.col("embedding").cast("array<double>")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("label") if label is None else label).cast("int").alias("label"),
        F.when(usable, F.transform(vector, lambda x: F.floor(x * scale))).alias("vec"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    return rows.withColumn("row", F.monotonically_increasing_id())


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long vectors as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def fit_codebook(half: np.ndarray, centroids: int, seed: int = 7) -> np.ndarray:
    """k-means of a sample; a centroid that loses all its rows stays where it was."""
    points = np.unique(half, axis=0) if half.size else half[:1]
    rng = np.random.default_rng(seed)
    book = points[rng.permutation(len(points))[:centroids]].astype(float)
    for _ in range(ITERATIONS):
        near = nearest(half, book)[0]
        count = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, half)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def nearest(half: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row and the distance to it."""
    best = np.argmin((book**2).sum(axis=1)[None, :] - 2.0 * (half @ book.T), axis=1)
    return best, np.sqrt(((half - book[best]) ** 2).sum(axis=1))


def _assigner(books: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("vec")).astype(float)
            cut = books[0].shape[1]
            (a, far_a), (b, far_b) = nearest(vectors[:, :cut], books[0]), nearest(vectors[:, cut:], books[1])
            extra = [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(far_a), pa.array(far_b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "a", "b", "far_a", "far_b"])

    return run


class MultiIndex:
    """All rows by cell, with what the driver needs to plan visits: two codebooks, radii, and a number per cell.

    That is at most ``MOST_CENTROIDS`` rows a half and their square of cells,
    however many rows there are.
    """

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        rows = staged(rows, "vectors")
        self.count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        self.width = width or 0
        # Shorter vectors count as padded with zeros.
        padded = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(self.width) - F.size("vec")))
        rows = rows.withColumn("vec", padded)
        sample = rows.select("vec", F.xxhash64("vec_id", "row").alias("h")).orderBy("h").limit(SAMPLE).select("vec").toArrow()
        vectors = matrix(sample.column("vec")).astype(float)
        k = max(1, min(MOST_CENTROIDS, round((self.count / CELL_ROWS) ** 0.5)))
        cut = self.width // 2
        self.books = (fit_codebook(vectors[:, :cut], k), fit_codebook(vectors[:, cut:], k))
        placed = rows.select("row", "vec_id", "label", "vec").mapInArrow(
            _assigner(self.books), "row long, vec_id long, label int, vec array<long>, a int, b int, far_a double, far_b double"
        )
        self.assigned = staged(placed.withColumn("cell", F.col("a") * len(self.books[1]) + F.col("b")), "cells")
        self.radii = tuple(self._radius(half, len(book)) for half, book in zip("ab", self.books))
        self.cells = len(self.books[0]) * len(self.books[1])
        self.counts = np.zeros(self.cells, np.int64)
        for r in self.assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
            self.counts[r["cell"]] = r["n"]
        self._pack(spark)

    def _radius(self, half: str, k: int) -> np.ndarray:
        out = np.zeros(k)
        for r in self.assigned.groupBy(half).agg(F.max(f"far_{half}").alias("far")).collect():
            out[r[half]] = r["far"]
        return out

    def _pack(self, spark: SparkSession) -> None:
        """Neighbouring small cells share a bin, large cells are split over several."""
        self.first_bin, self.bins = np.zeros(self.cells, np.int64), np.ones(self.cells, np.int64)
        at, held = 0, 0
        for cell, n in enumerate(self.counts.tolist()):
            if held + n > BIN_ROWS and held:
                at, held = at + 1, 0
            self.first_bin[cell], self.bins[cell] = at, max(1, -(-n // BIN_ROWS))
            if self.bins[cell] > 1:
                at, held = at + int(self.bins[cell]), 0
            else:
                held += n
        plan = [(c, int(self.first_bin[c]), int(self.bins[c])) for c in np.flatnonzero(self.counts).tolist()]
        fields = [T.StructField("cell", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("parts", T.LongType())]
        side = F.broadcast(local_rows(spark, plan, T.StructType(fields)))
        bin_of = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))
        self.rows = self.assigned.join(side, "cell").select("cell", "row", "vec_id", "label", "vec", bin_of.alias("bin"))

    def visitor(self, budget: int):
        """The next cells of each anchor, at least ``budget`` rows of them, and the bound of what follows."""
        books, radii, counts, cut = self.books, self.radii, self.counts, self.width // 2
        first, parts = self.first_bin, self.bins

        def turn(vector: np.ndarray, done: int) -> tuple[list[int], int, float]:
            halves = (vector[:cut], vector[cut:])
            bound = [book @ h + np.sqrt(h @ h) * r for book, h, r in zip(books, halves, radii)]
            order = [np.argsort(-b, kind="stable") for b in bound]
            up, down = bound[0][order[0]].tolist(), bound[1][order[1]].tolist()
            heap, rows, cells, popped = [(-(up[0] + down[0]), 0, 0)], 0, [], 0
            while heap and (rows < budget or popped < done):
                _, i, j = heapq.heappop(heap)
                # Each pair is reached once: rightwards along a row, downwards only from its first pair.
                if j + 1 < len(down):
                    heapq.heappush(heap, (-(up[i] + down[j + 1]), i, j + 1))
                if j == 0 and i + 1 < len(up):
                    heapq.heappush(heap, (-(up[i + 1] + down[0]), i + 1, 0))
                popped += 1
                if popped > done:
                    cell = int(order[0][i]) * len(down) + int(order[1][j])
                    if counts[cell]:
                        cells.append(cell)
                        rows += int(counts[cell])
            rest = -heap[0][0] if heap else float("-inf")
            return cells, popped, rest + SLACK * (1 + abs(rest)) if heap else rest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                visits, at, bounds = [], [], []
                for vector, done in zip(matrix(batch.column("vec")).astype(float), batch.column("pos").to_pylist()):
                    cells, popped, bound = turn(vector, done)
                    by_bin: dict[int, list[int]] = {}
                    for cell in cells:
                        for part in range(int(parts[cell])):
                            by_bin.setdefault(int(first[cell]) + part, []).append(cell)
                    visits.append([{"bin": b, "cells": c} for b, c in by_bin.items()])
                    at.append(popped)
                    bounds.append(bound)
                kept = {n: batch.column(n) for n in batch.schema.names if n != "pos"}
                kind = pa.list_(pa.struct([("bin", pa.int64()), ("cells", pa.list_(pa.int32()))]))
                extra = [pa.array(at, pa.int32()), pa.array(bounds, pa.float64()), pa.array(visits, kind)]
                yield pa.RecordBatch.from_arrays([*kept.values(), *extra], names=[*kept, "pos", "bound", "visits"])

        return run


def best_of(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` highest scores of each line; of ties the leftmost. The lowest number means none."""
    none = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    n = scores.shape[1]
    least = np.partition(scores, n - most, axis=1)[:, n - most] if n > most else np.full(len(scores), none)
    line, place = np.nonzero((scores >= least[:, None]) & (scores != none))
    order = np.lexsort((place, -scores[line, place], line))
    line, place = line[order], place[order]
    start = np.searchsorted(line, line)
    keep = np.arange(len(line)) - start < most
    return line[keep], place[keep]


def _scorer(same: bool, most: int, ratio: tuple[int, int]):
    """Candidates of the anchors of a chunk among the rows of a bin that lie in cells they visit."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            ids, numbers = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
            order = np.lexsort((numbers, ids))
            ids, numbers = ids[order], numbers[order]
            labels = rows.column("label").to_numpy()[order]
            cells, local = np.unique(rows.column("cell").to_numpy()[order], return_inverse=True)
            stored, asked = matrix(rows.column("vec"))[order], matrix(anchors.column("vec"))
            reach = float(np.abs(stored).max(initial=0)) * float(np.abs(asked).max(initial=0)) * stored.shape[1]
            kind = np.float64 if reach < 2**53 else np.int64
            none = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
            columns = stored.astype(kind).T
            keys, own = anchors.column("anchor").to_numpy(), anchors.column("label").to_numpy()
            visited, windows = anchors.column("cells").to_pylist(), anchors.column("windows").to_pylist()
            for at in range(0, len(keys), SLICE):
                part = slice(at, at + SLICE)
                scores = asked[part].astype(kind) @ columns
                open_cells = np.zeros((len(scores), len(cells)), bool)
                for i, mine in enumerate(visited[part]):
                    open_cells[i] = np.isin(cells, mine)
                fits = open_cells[:, local] & ((own[part][:, None] == labels[None, :]) == same)
                if same:
                    fits &= keys[part][:, None] != numbers[None, :]
                    masked = [(0, np.where(fits, scores, none))]
                else:
                    masked = []
                    for w in range(max((len(x) for x in windows[part]), default=0)):
                        has = np.array([len(x) > w for x in windows[part]])
                        top = np.array([x[w] if len(x) > w else 0 for x in windows[part]], kind)[:, None]
                        inside = (scores <= top) & (ratio[1] * scores >= ratio[0] * top) & has[:, None]
                        masked.append((w, np.where(fits & inside, scores, none)))
                for w, held in masked:
                    line, place = best_of(held, most)
                    found.append((keys[part][line], np.full(len(line), w, np.int32), held[line, place].astype(np.int64), ids[place], numbers[place]))
        kinds = (np.int64, np.int32, np.int64, np.int64, np.int64)
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate(kinds)]
        return pa.table([pa.array(c.astype(k)) for c, k in zip(columns, kinds)], names=["anchor", "w", "score", "vec_id", "row"])

    return run


def search(index: MultiIndex, state: DataFrame, anchors: int, same: bool, most: int, ratio: tuple[int, int] = (0, 1)) -> DataFrame:
    """``state`` with ``found`` filled: the ``most`` best rows of each window, certified.

    With ``same`` there is one window, the rows that share the anchor's label.
    Otherwise there is one per entry of ``windows``: rows of other labels that
    score at most that and at least ``ratio`` of it. Anchors take turns until the
    bound of their next cell closes all their windows or no cell is left.
    """
    chunks = max(1, -(-anchors // CHUNK_ANCHORS))
    budget, done = FIRST_ROWS, []
    here = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id", "row")

    def closed(i: Column, limit: Column | None) -> Column:
        mine = F.filter("found", lambda f: f["w"] == i)
        full = (F.size(mine) >= most) & (F.array_min(F.transform(mine, lambda f: f["score"])) > F.col("bound"))
        return full if limit is None else full | (limit < 0) | (ratio[1] * F.col("bound") < ratio[0] * limit)

    certified = closed(F.lit(0), None) if same else F.forall(F.transform("windows", closed), lambda c: c)
    while True:
        schema = f"{STATE.removesuffix(', pos int')}, pos int, bound double, visits array<struct<bin:long,cells:array<int>>>"
        turn = staged(state.mapInArrow(index.visitor(budget), schema), "turns")
        visits = turn.select(
            F.pmod(F.xxhash64("anchor"), F.lit(chunks)).alias("chunk"), "anchor", "label", "vec", "windows", F.explode("visits").alias("v")
        ).select("chunk", F.col("v.bin").alias("bin"), "anchor", "label", "vec", "windows", F.col("v.cells").alias("cells"))
        wanted = visits.select(F.col("chunk").alias("for_chunk"), F.col("bin").alias("of_bin")).distinct()
        blocks = index.rows.join(wanted, F.col("bin") == F.col("of_bin")).select("for_chunk", "of_bin", "cell", "row", "vec_id", "label", "vec")
        hits = (
            visits.groupBy("chunk", "bin")
            .cogroup(blocks.groupBy("for_chunk", "of_bin"))
            .applyInArrow(_scorer(same, most, ratio), HITS)
        )
        before = turn.select("anchor", F.explode("found").alias("f")).select("anchor", "f.*")
        best = hits.unionByName(before).withColumn("place", F.row_number().over(here)).filter(F.col("place") <= most)
        found = best.groupBy("anchor").agg(F.collect_list(F.struct("w", "score", "vec_id", "row")).alias("found"))
        after = turn.drop("found", "visits").join(found, "anchor", "left")
        after = after.withColumn("found", F.coalesce("found", F.array().cast(FOUND)))
        ended = (F.col("bound") == float("-inf")) | certified
        after = staged(after.withColumn("ended", ended), "turns")
        done.append(after.filter("ended"))
        state = after.filter("NOT ended").select(*(c.split()[0] for c in ("anchor", "anchor_id", "label", "vec", "windows", "ids", "found", "pos")))
        budget *= GROWTH
        if state.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mine_negatives(
    embeddings: DataFrame,
    anchors: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    ratio: tuple[int, int] = (80, 100),
) -> DataFrame:
    """For each anchor and positive the hardest rows of other labels that still look less alike than the positive.

    Columns: ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``. ``anchors`` is a condition on vec_id. Rows with a null
    vec_id, label, vector or component, or one that is not finite, take no part.
    Components become floor(256 * x); scores are exact while they fit 64 bits.
    Shorter vectors count as padded with zeros. Of equal scores the smaller vec_id
    comes first; rows that repeat a vec_id are rows of their own, also as anchors.
    A positive with a negative score has no negatives. Other columns are ignored.
    An empty table, or one without anchors, gives no rows.
    """
    spark = embeddings.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = prepare(embeddings, label)
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    index = MultiIndex(rows)
    asked = index.rows.filter(anchors)
    n = asked.count()
    if not n:
        return spark.createDataFrame([], schema)
    none = F.array().cast("array<long>")
    start = asked.select(
        F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec", none.alias("windows"), none.alias("ids"),
        F.array().cast(FOUND).alias("found"), F.lit(0).alias("pos"),
    )
    near = search(index, start, n, True, positives)
    ranked = F.sort_array(F.transform("found", lambda f: F.struct((-f["score"]).alias("s"), f["vec_id"].alias("vec_id"), f["row"].alias("row"))))
    again = near.withColumn("best", ranked).select(
        "anchor", "anchor_id", "label", "vec", F.transform("best", lambda f: -f["s"]).alias("windows"), F.col("best.vec_id").alias("ids"),
        F.array().cast(FOUND).alias("found"), F.lit(0).alias("pos"),
    )
    far = search(index, again, n, False, negatives, ratio)
    lists = far.select("anchor_id", "found", F.posexplode(F.arrays_zip("windows", "ids")).alias("w", "p"))
    mine = F.transform(
        F.filter("found", lambda f: f["w"] == F.col("w")), lambda f: F.struct((-f["score"]).alias("s"), f["vec_id"].alias("vec_id"), f["row"].alias("row"))
    )
    return lists.select("anchor_id", "p", F.posexplode(F.sort_array(mine)).alias("place", "f")).select(
        "anchor_id",
        F.col("p.ids").alias("positive_id"),
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("f.vec_id").alias("negative_id"),
        F.col("p.windows").alias("positive_score"),
        (-F.col("f.s")).alias("negative_score"),
    )


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(coalesce(list_inner_product(a.vec, b.vec), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
