"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows meet it in a
sort-merge anti join that shuffles only the new side, and digests it does not
know are appended to their buckets. Of a batch, the row with the largest id
wins; against the index, what is already there stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import ROW, checkpoint_root, lower_ascii, note_work, row_column, staged, table, text_or_empty, with_row_id

BUCKETS = 64


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text with A-Z in lower case; a null text counts as empty."""
    return F.sha2(lower_ascii(text_or_empty(text)), 256)


class DigestIndex:
    """digest -> row that stays, in ``buckets`` sorted buckets below ``path``.

    The files outlive the session; opening the same path again registers them
    under a new table name. Adding a batch twice changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, keep_row BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (digest, doc_id, row) that are not indexed."""
        best = batch.groupBy("digest").agg(F.max(F.struct("doc_id", ROW)).alias("best"))
        fresh = best.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        rows = fresh.select("digest", F.col("best.doc_id").alias("keep_id"), F.col(f"best.{ROW}").alias("keep_row"))
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", row_id: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null equals empty. Of
    equal texts the row with the largest doc_id stays; of rows that repeat that
    doc_id too, one stays; a null doc_id loses against any other. With an empty
    index the upper half of the ids is indexed first and the lower half then
    meets it as new data, which gives the same answer as one batch. With a
    filled index (of an earlier run) digests it holds drop every row of ``docs``.
    ``row_id`` names a column that numbers the rows, which is returned too. Other
    columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = index is None
    if index is None:
        index = DigestIndex(spark, f"{checkpoint_root(spark)}/pulsegrid/digests-{uuid.uuid4().hex}")
        note_work(index.path)
    rows = staged(with_row_id(docs, F.col("doc_id").cast("long"), text_digest(text).alias("digest"), row_id=row_id), "digests")
    if own:
        middle = rows.approxQuantile("doc_id", [0.5], 0.05)
        upper = F.col("doc_id") >= F.lit(int(middle[0]) if middle else 0)
        for batch in (rows.filter(upper), rows.filter(~upper | F.col("doc_id").isNull())):
            index.add(batch)
    else:
        # Rows of an earlier run have numbers of their own; only their ids say who stays.
        index.add(rows)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = sizes.join(index.read().hint("merge"), "digest")
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col(ROW) == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        *row_column(row_id),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
