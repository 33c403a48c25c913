"""RFC3339 timestamps."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats. PLAIN is what Spark's own cast reads; GENERAL adds what the
# RFC3339 parser of the reference system also lets through: a one-digit hour,
# a comma before the fraction, any number of fraction digits, offsets to 24:60.
PLAIN = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-](0\d|1[0-7]):[0-5]\d)\z"
GENERAL = (
    r"\A(\d{4}-\d{2}-\d{2})T(\d{1,2}:\d{2}:\d{2})(?:[.,](\d{1,6})\d*)?"
    r"(?:Z|([+-])([01]\d|2[0-4]):([0-5]\d|60))\z"
)
RFC3339_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_rfc3339(text: str | Column) -> Column:
    """The instant, or NULL when the text is not an RFC3339 timestamp."""
    text = F.col(text) if isinstance(text, str) else text

    def part(i: int) -> Column:
        return F.regexp_extract(text, GENERAL, i)

    local = F.concat(part(1), F.lit("T"), part(2), F.lit("."), F.rpad(part(3), 6, "0"), F.lit("Z")).try_cast(
        "timestamp"
    )
    minutes = part(5).try_cast("int") * 60 + part(6).try_cast("int")
    east = F.when(part(4) == "", F.lit(0)).when(part(4) == "-", -minutes).otherwise(minutes)
    shifted = F.timestamp_add("MINUTE", -east, local)
    return F.when(text.rlike(PLAIN), text.try_cast("timestamp")).when(text.rlike(GENERAL), shifted)


def format_rfc3339(ts: str | Column) -> Column:
    """UTC text with whole seconds; the session time zone must be UTC."""
    return F.date_format(ts, RFC3339_SECONDS)


def parse_rfc3339_text(text: str) -> datetime:
    """One driver-side timestamp as an aware datetime; ValueError when malformed."""
    found = re.fullmatch(GENERAL[2:-2], text, flags=re.ASCII)
    if found is None:
        raise ValueError(f"not an RFC3339 timestamp: {text!r}")
    day, clock, fraction, sign, hours, minutes = found.groups()
    local = datetime.strptime(f"{day} {clock}", "%Y-%m-%d %H:%M:%S").replace(
        microsecond=int((fraction or "0").ljust(6, "0")), tzinfo=timezone.utc
    )
    offset = timedelta(hours=int(hours or 0), minutes=int(minutes or 0))
    return local + offset if sign == "-" else local - offset
