"""Session setup and the shared working folder.

Everything here is a runtime setting, so a session made by somebody else (a
notebook, a cluster launcher, a test driver) can be prepared the same way.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.storagelevel import StorageLevel

RUNTIME_CONF = {
    # RFC3339 instants are compared and bucketed in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object with a repeated key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Streaming averages keep a row per bucket and device: on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

# Target size of a range in a range shuffle.
RANGE_BYTES = 256 << 20

# A side of up to this many (narrow) rows is pinned as a local relation, and of
# up to this many bytes broadcast.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 256 << 20


def build_session(app_name: str = "pulsegrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare_session(builder.getOrCreate())


def prepare_session(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` names it on a cluster. Only a local session may
    run without it; there the folder is a temporary one set for that session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_root(spark)}/pulsegrid/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def partition_folder(spark: SparkSession, column: str, value: object) -> str:
    """``column=value`` as Spark writes it, special characters escaped."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{column}={escape(str(value))}"


def local_rows(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """A handful of driver-side rows as a local relation, which Catalyst can fold."""
    columns = list(zip(*rows)) or [[] for _ in schema.fields]
    return spark.createDataFrame(
        pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))], schema.names),
        schema,
    )


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows.

    ``take`` works through the partitions step by step and stops at the bound;
    only constants travel, never the rows themselves.
    """
    return len(df.select(F.lit(True)).take(rows + 1)) <= rows


def pin_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A frame proven to have at most ``rows`` rows as a local relation.

    Meant for frames with one narrow row per partition, range or topic, which
    are used several times. A frame that turns out larger stays as it is.
    """
    head = df.take(rows + 1)
    return local_rows(df.sparkSession, head, df.schema) if len(head) <= rows else df


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow join side, broadcast when proven small; else the join is left to AQE.

    Beyond ``rows`` the bound is in bytes, as for the shifts of a numbering: a
    narrow row per range is some 20 MB for 100 TB.
    """
    head = df.take(rows + 1)
    if len(head) <= rows:
        return local_rows(df.sparkSession, head, df.schema).hint("broadcast")
    most = BROADCAST_BYTES // row_bytes(df.schema)
    return df.hint("broadcast") if df.limit(most + 1).count() <= most else df


def row_bytes(schema: T.StructType) -> int:
    """A broadcast row in memory: its header, a word per field and room for short strings."""
    return 32 + sum(8 + (40 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 0) for f in schema.fields)


def input_size(df: DataFrame) -> int | None:
    """Bytes of the tables a plan reads, as estimated; None for sources of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return None if size >= 1 << 60 else size


def range_count(df: DataFrame) -> int | None:
    """How many ranges a large input needs, from the sizes of the tables it reads.

    The estimate of a join would be the product of its sides. None leaves
    ``spark.sql.shuffle.partitions`` and AQE in charge: for inputs they suffice
    for, and for sources of unknown size.
    """
    size = input_size(df)
    needed = 0 if size is None else -(-size // RANGE_BYTES)
    return needed if needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def split_by_range(df: DataFrame, *order: str | Column, ranges: int | None = None) -> DataFrame:
    """Range-shuffle and sort; large inputs get as many ranges as they need."""
    ranges = ranges or range_count(df)
    split = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return split.sortWithinPartitions(*order)


BATCH_STORAGE = StorageLevel.DISK_ONLY
