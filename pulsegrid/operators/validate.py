"""Messages to telemetry rows, with a reason for every message that is not one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import canonical_json, decode_payload, parse_rfc3339, strict_json, with_fence
from pulsegrid.functions.jsonops import is_null_literal, opens_object, string_field
from pulsegrid.operators.records import as_rejects

BAD_BASE64 = "bad_base64"
BAD_JSON = "bad_json"
MISSING_FIELDS = "missing_fields"
BAD_TIMESTAMP = "bad_timestamp"


def decode_json(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``document`` (VARIANT): NULL unless the payload is a JSON object.

    A literal ``null`` decodes to an object without fields, so ``is_record`` is
    true for it as well.
    """
    text = F.col(payload).cast("string")
    parsed = messages.withColumn("document", strict_json(text))
    return parsed.withColumn(
        "is_record",
        F.coalesce(F.col("document").isNotNull() & (opens_object(text) | is_null_literal(text)), F.lit(False)),
    )


def validate_messages(messages: DataFrame, payload: str = "payload", encoding: str = "text") -> DataFrame:
    """Add ``raw, gpu_id, timestamp, data`` and ``reason`` (NULL for a valid message).

    ``encoding='base64'`` decodes the payload first. Both fields must be JSON
    strings and not empty, and the timestamp must be RFC3339.
    """
    raw = F.col(payload).cast("string")
    text = decode_payload(payload) if encoding == "base64" else raw
    decoded = decode_json(messages.withColumns({"raw": raw, "text": text}), "text")
    fields = decoded.withColumns(
        {
            "gpu_id": string_field("document", "gpu_id"),
            "timestamp_text": string_field("document", "timestamp"),
            "data": canonical_json("document"),
        }
    )
    stamped = fields.withColumn("timestamp", parse_rfc3339("timestamp_text"))
    empty = (F.coalesce("gpu_id", F.lit("")) == "") | (F.coalesce("timestamp_text", F.lit("")) == "")
    reason = (
        F.when(F.col("text").isNull(), BAD_BASE64 if encoding == "base64" else BAD_JSON)
        .when(~F.col("is_record"), BAD_JSON)
        .when(empty, MISSING_FIELDS)
        .when(F.col("timestamp").isNull(), BAD_TIMESTAMP)
    )
    checked = stamped.withColumn("reason", reason).drop("text", "document", "is_record", "timestamp_text")
    return with_fence(checked, "gpu_id", "timestamp", "data", "reason")


def to_telemetry(validated: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid rows as ``gpu_id, timestamp, data``; the whole record stays in ``data``."""
    return validated.filter(F.col("reason").isNull()).select("gpu_id", "timestamp", "data", *keep)


def rejects(validated: DataFrame) -> DataFrame:
    """Invalid rows with their reason and, if they came from the log, position."""
    return as_rejects(validated.filter(F.col("reason").isNotNull()))
