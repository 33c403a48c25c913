"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import local_rows, remove_folder, shared_root, split_by_range, work_folder

# Python workers need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules["pulsegrid.llm"])

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What separates words: space and the control characters 0x09 to 0x0D.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# The number of a row inside an operator. It never comes from a column of this name in the input.
ROW = "__pulsegrid_row"
# Bits of the bitmap of a sieve.
SIEVE_BITS = 1 << 24
# Folders that were staged since the innermost ``work_dropped`` began.
_WORK: ContextVar[list[str] | None] = ContextVar("work", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z to lower case; no other letter changes."""
    return F.translate(column, UPPER, UPPER.lower())


def input_bytes(df: DataFrame) -> int:
    """Size of the tables a plan reads, as estimated."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage at a copy every executor can reach, so a lost executor
    costs only the tasks it had.
    """
    path = work_folder(df.sparkSession, purpose)
    note_work(path)
    # Without the marker file: nobody else reads the table, and on a local path its permissions cost two processes forked from the driver.
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def note_work(path: str) -> None:
    """Remember a work folder, for the ``work_dropped`` that surrounds the call to delete."""
    work = _WORK.get()
    if work is not None:
        work.append(path)


@contextmanager
def work_dropped(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete at the end what was staged inside, except by the function this gives."""
    work: list[str] = []
    token = _WORK.set(work)

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        out = staged(df, purpose)
        work.pop()
        return out

    try:
        yield kept
    finally:
        _WORK.reset(token)
        for path in work:
            remove_folder(spark, path)


def checkpoint_root(spark: SparkSession) -> str:
    return shared_root(spark)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no returned plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove_folder(df.sparkSession, path)


def with_row_id(df: DataFrame, *columns: str | Column, row_id: str | None = None) -> DataFrame:
    """``columns`` and a number per row, which is stable only once the result is staged.

    ``row_id`` names a column that numbers the rows already.
    """
    number = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    return df.select(*columns, number.alias(ROW))


def row_column(row_id: str | None) -> list[Column]:
    """The number of a row under the name its caller gave it, if any."""
    return [] if row_id is None else [F.col(ROW).alias(row_id)]


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column begins like it."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def numbered_rows(df: DataFrame, row_id: str) -> DataFrame:
    """``df`` with a number per row that every later read repeats.

    Rows of a frame that is just read from Parquet are numbered by file and place
    in the file, without a copy; any other frame is staged. There is one number
    per file on the driver.
    """
    spark = df.sparkSession
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return staged(df.withColumn(row_id, F.monotonically_increasing_id()), "stage-rows")
    place = df.metadataColumn("_metadata")
    placed = df.withColumns({f"{row_id}_file": place["file_path"], f"{row_id}_at": place["row_index"]})
    files = sorted(r[0] for r in placed.select(f"{row_id}_file").distinct().collect())
    fields = T.StructType([T.StructField(f"{row_id}_file", T.StringType()), T.StructField(f"{row_id}_no", T.LongType())])
    side = F.broadcast(local_rows(spark, [(f, i << 33) for i, f in enumerate(files)], fields))
    number = (F.col(f"{row_id}_no") + F.col(f"{row_id}_at")).alias(row_id)
    return placed.join(side, f"{row_id}_file").select(*df.columns, number)


def sieve(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Rows that ``wanted`` may have, by a bitmap of hashed keys of fixed size.

    It spares the shuffle most rows; which of the others pass does not matter,
    as an exact join follows. The more keys are wanted, the less it spares.
    """

    def place(df: DataFrame) -> DataFrame:
        h = F.pmod(F.xxhash64(*keys), F.lit(SIEVE_BITS))
        return df.withColumns({"__word": F.floor(h / 64).cast("int"), "__bit": (h % 64).cast("int")})

    bits = place(wanted.select(*keys)).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    found = place(rows).join(F.broadcast(bits), "__word")  # at most SIEVE_BITS / 64 rows
    return found.filter(F.expr("shiftrightunsigned(__bits, __bit) & 1L") == 1).drop("__word", "__bit", "__bits")


def in_order(df: DataFrame, order: list[str], totals: dict[str, Column], purpose: str) -> DataFrame:
    """Rows with exclusive running totals in a global order.

    A single window over all rows would be one task. Rows are range-split by the
    whole order (a hot leading value is split by what follows it) and staged;
    the totals of each range go to the driver, one row per range, and shift the
    totals inside the range.
    """
    spark = df.sparkSession
    part = staged(
        split_by_range(df, *order).withColumn("__part", F.spark_partition_id()),
        purpose,
    )
    sums = part.groupBy("__part").agg(*(F.sum(c).cast("long").alias(n) for n, c in totals.items())).orderBy("__part").collect()
    base, rows = dict.fromkeys(totals, 0), []
    for r in sums:
        rows.append((r["__part"], *base.values()))
        base = {n: base[n] + (r[n] or 0) for n in totals}
    fields = [T.StructField("__part", T.IntegerType())] + [T.StructField(f"__base_{n}", T.LongType()) for n in totals]
    shift = local_rows(spark, rows, T.StructType(fields))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = part.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long") for n, c in totals.items()})
    joined = running.join(F.broadcast(shift), "__part")
    return joined.withColumns({n: F.col(n) + F.col(f"__base_{n}") for n in totals}).drop("__part", *(f"__base_{n}" for n in totals))
