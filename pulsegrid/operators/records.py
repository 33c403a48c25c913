"""Records on their way into the log: restamp, key check, JSON message."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import format_rfc3339
from pulsegrid.schema import REJECT

KEY_COLUMN = "gpu_id"

# JSON text escapes written for characters that matter in HTML
# or JavaScript. None of them can occur outside a JSON string.
HTML_ESCAPES = (
    ("<", "\\u003c"),
    (">", "\\u003e"),
    ("&", "\\u0026"),
    ("\u2028", "\\u2028"),
    ("\u2029", "\\u2029"),
)


def restamp(records: DataFrame, at: datetime | Column | None = None) -> DataFrame:
    """Overwrite ``timestamp`` with publish time, UTC, whole seconds.

    ``at`` replaces the clock: a fixed time, or a column when every row has its
    own publish time.
    """
    ts = F.current_timestamp() if at is None else at if isinstance(at, Column) else F.lit(at)
    return records.withColumn("timestamp", format_rfc3339(ts))


def has_key(key: str = KEY_COLUMN) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("")) != ""


def require_key(records: DataFrame, key: str = KEY_COLUMN) -> DataFrame:
    """Only records that name their device."""
    return records.filter(has_key(key))


def record_json(columns: list[str], within: str | None = None) -> Column:
    """The record as a JSON object: keys sorted, every value a string.

    ``within`` names the struct column that holds the fields.
    """
    prefix = f"`{within}`." if within else ""
    text = F.to_json(F.struct(*[F.col(f"{prefix}`{c}`").cast("string").alias(c) for c in sorted(columns)]))
    for raw, escaped in HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def to_message(
    records: DataFrame, key: str = KEY_COLUMN, keep: tuple[str, ...] = (), keyed_only: bool = True
) -> DataFrame:
    """``key, payload`` of every record that has a key; ``keep`` rides along
    outside the payload (arrival order, for instance). With ``keyed_only=False``
    records without a key pass too, for the publish to refuse."""
    body = [c for c in records.columns if c not in keep]
    rows = require_key(records, key) if keyed_only and key in body else records
    named = F.col(key).cast("string") if key in body else F.lit(None).cast("string")
    messages = rows.select(named.alias("key"), record_json(body).alias("payload"), *keep)
    return messages.filter(F.col("key").isNotNull()) if keyed_only else messages


def as_rejects(rows: DataFrame) -> DataFrame:
    """Fit rows to the rejects schema; absent columns become NULL."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in REJECT.fields
        ]
    )
