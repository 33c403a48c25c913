"""Payload bytes as base64 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_payload(payload: str | Column) -> Column:
    """Base64 of the payload on one line."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    # base64() may break lines every 76 characters, depending on the session.
    return F.replace(F.base64(payload.cast("binary")), F.lit("\r\n"), F.lit(""))


def decode_payload(text: str | Column) -> Column:
    """Payload text of a base64 column; NULL when it is not base64."""
    return F.try_to_binary(text, F.lit("base64")).cast("string")
