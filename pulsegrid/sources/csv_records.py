"""CSV files as records of strings, in batch and as a stream.

Any path Hadoop can resolve works: local, shared or object storage. A batch read
splits large files, also where cells hold line breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.readwriter import DataFrameReader

from pulsegrid.errors import InvalidArgument
from pulsegrid.schema import METRIC_COLUMNS
from pulsegrid.session import local_rows
from pulsegrid.sources.csv_splits import split_records

ARRIVAL = "arrival"


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _options(reader: DataFrameReader | DataStreamReader, multi_line: bool) -> DataFrameReader | DataStreamReader:
    # A ragged row fails the read whichever columns the query needs, hence no
    # pruning inside the parser.
    return (
        reader.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
    )


def _text_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """Empty cells as '' (Spark reads NULL), line ends inside cells as \\n."""
    return df.select(
        *[F.coalesce(F.replace(F.col(f"`{n}`"), F.lit("\r\n"), F.lit("\n")), F.lit("")).alias(n) for n in names],
        *([ARRIVAL] if ARRIVAL in df.columns else []),
    )


def csv_header(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> list[str]:
    """The cells of the first row; an empty list for an empty file."""
    raw = spark.read.option("header", False).option("multiLine", multi_line).option("escape", '"').csv(path)
    first = raw.first() if raw.columns else None
    return [] if first is None else ["" if cell is None else cell for cell in first]


def _parsed(spark: SparkSession, path: str | list[str], header: list[str], stored: list[str], arrival: bool) -> DataFrame:
    """Cells of the records that many tasks cut out of the files; each file's header must be ``header``."""
    options = {"escape": '"', "mode": "FAILFAST", "columnPruning": "false"}
    records = split_records(spark, path)
    cells = F.from_csv("record", _strings([f"_{i}" for i in range(len(stored))]).simpleString(), options)
    rows = records.select("number", "header", cells.alias("cells"))
    same = F.array(*(F.coalesce(F.col(f"cells._{i}"), F.lit("")) for i in range(len(stored)))) == F.array(*map(F.lit, header))
    wrong = F.raise_error(F.lit("the header of a file differs from the first")).cast("boolean")
    # Reading every cell makes a ragged row fail whatever the query needs.
    whole = F.coalesce(*(F.col(f"cells._{i}") for i in range(len(stored))), F.lit("")).isNotNull()
    rows = rows.filter(F.when(~F.col("header"), whole).when(same, F.lit(False)).otherwise(wrong))
    named = [F.col(f"cells._{i}").alias(name) for i, name in enumerate(stored)]
    return rows.select(*named, *([F.struct("number").alias(ARRIVAL)] if arrival else []))


def _with_place(df: DataFrame) -> DataFrame:
    """Which file, and which split of it, a row comes from."""
    return df.withColumn(
        ARRIVAL,
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")),
    )


def order_rows(df: DataFrame) -> DataFrame:
    """Complete the arrival order with the row's place inside its split.

    Streams know only the split; their micro-batches are completed here.
    """
    row = F.monotonically_increasing_id().alias("row")
    parts = [F.col(ARRIVAL).alias("source"), row] if ARRIVAL in df.columns else [row]
    return df.withColumn(ARRIVAL, F.struct(*parts))


def read_csv_records(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, arrival: bool = False
) -> DataFrame:
    """Records of a CSV file or folder; the first row names the columns.

    Every cell is a string. A repeated column name keeps its last column. A
    ragged row fails the read, and so does a file whose header differs. Large
    files are split, line breaks in cells or not; ``multi_line=True`` reads a
    file in one task instead, as files need whose lines end with CR alone.
    ``arrival=True`` adds the order: by file, then by place in it.
    """
    header = csv_header(spark, path)
    if not header:
        return spark.range(0).select()
    named = [name or f"_c{i}" for i, name in enumerate(header)]
    if spark.conf.get("spark.sql.caseSensitive") != "true":
        spelling: dict[str, str] = {}
        for name in named:
            if spelling.setdefault(name.lower(), name) != name:
                raise InvalidArgument(
                    f"columns {spelling[name.lower()]!r} and {name!r} differ only in case; set spark.sql.caseSensitive"
                )
    last = {name: i for i, name in enumerate(named)}
    stored = [name if last[name] == i else f"{name}#{i}" for i, name in enumerate(named)]
    if not multi_line:
        return _text_cells(_parsed(spark, path, header, stored, arrival), [name for i, name in enumerate(named) if last[name] == i])
    reader = _options(spark.read.schema(_strings(stored)), multi_line)
    # Spark compares each file's header with the schema unless names were made up.
    df = reader.option("enforceSchema", stored != header).csv(path)
    if arrival:
        df = order_rows(_with_place(df))
    return _text_cells(df, [name for i, name in enumerate(named) if last[name] == i])


def stream_csv_records(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    max_files_per_trigger: int | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """New CSV files of a folder as a stream of records with the place they come from."""
    reader = _options(spark.readStream.schema(_strings(columns)), multi_line).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _text_cells(_with_place(reader.csv(folder)), columns)


def metric_rows(records: DataFrame) -> DataFrame:
    """Long-form metric records with ``value`` and ``timestamp`` typed (NULL where malformed)."""
    return records.select(*METRIC_COLUMNS).withColumns(
        {
            "value": F.col("value").try_cast("double"),
            "timestamp": F.col("timestamp").try_cast("timestamp"),
        }
    )


def read_metric_rows(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """The documented twelve-column metric file."""
    records = read_csv_records(spark, path, multi_line)
    return metric_rows(records if records.columns else local_rows(spark, [], _strings(list(METRIC_COLUMNS))))
