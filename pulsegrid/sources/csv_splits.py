"""Records of CSV files whose cells hold line breaks, read by many tasks per file.

Whether a line of a split begins a record depends on everything before it: it
does unless a quoted cell is open. What a line does to that state is known from
the line alone, for both states it may find, so a split is summed up by where it
leads from either state and how many records it begins. These sums, one narrow
row per split, are chained on the driver, which plans the splits anyway. A second
pass then knows the state and the number of the first record of its split and
cuts lines into records; only records that cross a split meet in a shuffle.

Lines are looked at in Arrow batches; lines without a quote cost no Python step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import local_rows

NUMBER = "number"
# A quoted cell with what follows it, or a cell that does not begin with a quote.
CELLS = r'(?:(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+)(?:,|\Z))*+'
FROM_START = re.compile(CELLS, re.S)
FROM_INSIDE = re.compile(r'(?:[^"]|"")*+"[^,]*+(?:,|\Z)' + CELLS, re.S)

SUMS = "file string, start long, end_0 int, end_1 int, records_0 long, records_1 long"
PIECES = "number long, place long, open boolean, record string"


def opens(line: str, inside: bool) -> int:
    """1 if a quoted cell is open at the end of the line, given whether one is at its start."""
    found = (FROM_INSIDE if inside else FROM_START).match(line)
    return int(found is None or found.end() < len(line))


def _runs(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[int, int]]:
    """Stretches of rows that lie in one split."""
    changes = np.zeros(max(batch.num_rows - 1, 0), bool)
    for key in keys:
        column = batch.column(key)
        changes |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
    yield from zip(edges, edges[1:])


def _shape(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of lines with a quote, and whether each line has more than its line end."""
    lines = batch.column("value")
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    blank = pc.or_(pc.equal(lines, ""), pc.equal(lines, "\r"))
    return quoted, ~blank.to_numpy(zero_copy_only=False)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, count = None, [0, 1], [0, 0]

    def row() -> pa.RecordBatch:
        values = [*key, *state, *count]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        names = ["file", "start", "end_0", "end_1", "records_0", "records_1"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        quoted, filled = _shape(batch)
        before = np.concatenate(([0], np.cumsum(filled)))
        for begin, end in _runs(batch, "file", "start"):
            here = (batch.column("file")[begin].as_py(), batch.column("start")[begin].as_py())
            if here != key:
                if key is not None:
                    yield row()
                key, state, count = here, [0, 1], [0, 0]
            at = begin
            for place in quoted[np.searchsorted(quoted, begin) : np.searchsorted(quoted, end)].tolist():
                line = batch.column("value")[place].as_py()
                lead = [opens(line, False), opens(line, True)]
                for h in (0, 1):
                    if state[h] == 0:
                        count[h] += int(before[place + 1] - before[at])
                    state[h] = lead[state[h]]
                at = place + 1
            for h in (0, 1):
                if state[h] == 0:
                    count[h] += int(before[end] - before[at])
    if key is not None:
        yield row()


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the state and number their split begins with, into records and the pieces at split edges."""
    key, state, number, held = None, 0, 0, None

    def close(out: list, is_open: bool) -> None:
        if held is not None:
            out.append((held[0], key, is_open or held[1], "\n".join(held[2])))

    for batch in batches:
        if not batch.num_rows:
            continue
        lines = batch.column("value")
        quoted, filled = _shape(batch)
        out: list[tuple] = []
        singles, numbers = [], []
        for begin, end in _runs(batch, "place"):
            here = batch.column("place")[begin].as_py()
            if here != key:
                close(out, state == 1)
                key, held = here, None
                state, number = batch.column("state")[begin].as_py(), batch.column("first")[begin].as_py()
            inside = np.zeros(end - begin, bool)
            at = begin
            for place in quoted[np.searchsorted(quoted, begin) : np.searchsorted(quoted, end)].tolist():
                inside[at - begin : place + 1 - begin] = state
                state = opens(lines[place].as_py(), bool(state))
                at = place + 1
            inside[at - begin :] = state
            starts = ~inside & filled[begin:end]
            # Blank lines between records belong to none.
            kept = np.flatnonzero(starts | inside)
            if not len(kept):
                continue
            joined = np.append(inside[kept][1:], False)
            alone = starts[kept] & ~joined
            if alone[-1] and state == 0:
                last = len(kept)
            else:
                # The record that the batch ends with may go on.
                last = int(np.flatnonzero(starts[kept])[-1]) if starts[kept].any() else 0
                alone[last:] = False
            ids = number - 1 + np.cumsum(starts[kept])
            number = int(ids[-1]) + 1
            if alone.any() or starts[kept[0]]:
                if starts[kept[0]]:
                    close(out, False)
                    held = None
            singles.append(begin + kept[alone])
            numbers.append(ids[alone])
            for i in np.flatnonzero(~alone).tolist():
                text = lines[int(begin + kept[i])].as_py()
                if starts[kept[i]]:
                    close(out, False)
                    held = (int(ids[i]), False, [text])
                elif held is None:
                    held = (int(ids[i]), True, [text])
                else:
                    held[2].append(text)
            if last == len(kept):
                close(out, False)
                held = None
        where = np.concatenate(singles) if singles else np.zeros(0, np.int64)
        if len(where):
            n = len(where)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(numbers).astype(np.int64)), batch.column("place").take(pa.array(where)), pa.array(np.zeros(n, bool)), lines.take(pa.array(where))],
                names=["number", "place", "open", "record"],
            )
        if out:
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["number", "place", "open", "record"])
    out = []
    close(out, state == 1)
    if out:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["number", "place", "open", "record"])


def split_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``number, header, record``: the records of CSV files as text, numbered over all files.

    Files follow each other by path. ``header`` marks the first record of a file.
    Lines end with LF or CRLF; blank lines between records are skipped. A quote
    inside a cell that does not begin with one is an ordinary character.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    place = lines.metadataColumn("_metadata")
    lines = lines.select(place["file_path"].alias("file"), place["file_block_start"].alias("start"), "value")
    sums = sorted(lines.mapInArrow(_sums, SUMS).collect(), key=lambda r: (r["file"], r["start"]))
    plan, first, state, opened = [], 0, 0, False
    for i, r in enumerate(sums):
        if i == 0 or r["file"] != sums[i - 1]["file"]:
            state, begin = 0, first
        plan.append((r["file"], r["start"], i, state, first, begin))
        first += r[f"records_{state}"]
        state = r[f"end_{state}"]
        opened |= state == 1
    fields = [("file", T.StringType()), ("start", T.LongType()), ("place", T.LongType()), ("state", T.IntegerType()), ("first", T.LongType())]
    schema = T.StructType([T.StructField(n, k) for n, k in [*fields, ("begin", T.LongType())]])
    # One narrow row per split of the scan.
    splits = local_rows(spark, plan, schema)
    placed = lines.join(F.broadcast(splits.drop("begin")), ["file", "start"]).select("place", "state", "first", "value")
    pieces = placed.mapInArrow(_cutter, PIECES)
    records = pieces.filter("NOT open").select("number", "place", "record")
    if opened:
        # Records that cross a split edge: a handful, joined by their number.
        one = F.sort_array(F.collect_list(F.struct("place", "record")))
        crossing = pieces.filter("open").groupBy("number").agg(F.min("place").alias("place"), F.array_join(one["record"], "\n").alias("record"))
        records = records.unionByName(crossing)
    begins = splits.select("place", "begin")
    ended = F.regexp_replace("record", "\r$", "")
    return records.join(F.broadcast(begins), "place").select("number", (F.col("number") == F.col("begin")).alias("header"), ended.alias("record"))
