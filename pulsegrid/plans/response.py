"""The answer to "telemetry of a device": records, fields and span.

The three parts are DataFrames. A device may hold a third of the table, so its
records are never gathered into one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from pulsegrid.errors import InvalidArgument, TelemetryNotFound
from pulsegrid.functions import parse_rfc3339_text
from pulsegrid.operators.telemetry import (
    effective_range,
    expand_data,
    fields_available,
    in_range,
    of_gpu,
)


@dataclass(frozen=True)
class TelemetryResponse:
    """``records``: gpu_id, timestamp, data in time order; ``fields``: one row per
    field name; ``summary``: gpu_id, count, start_time, end_time."""

    records: DataFrame
    fields: DataFrame
    summary: DataFrame

    def write(self, folder: str) -> None:
        """Store the parts as JSON, in parallel."""
        self.records.write.mode("overwrite").json(f"{folder}/records")
        self.fields.write.mode("overwrite").json(f"{folder}/fields_available")
        self.summary.write.mode("overwrite").json(f"{folder}/summary")


def parse_time_bounds(start: str = "", end: str = "") -> tuple[datetime | None, datetime | None]:
    """RFC3339 texts as bounds; an empty text leaves its side open."""
    bounds = []
    for name, text in (("start_time", start), ("end_time", end)):
        try:
            bounds.append(parse_rfc3339_text(text) if text else None)
        except ValueError as cause:
            raise InvalidArgument(f"invalid {name} format: {cause}") from cause
    return bounds[0], bounds[1]


def query_telemetry(
    telemetry: DataFrame, gpu_id: str, start: datetime | None = None, end: datetime | None = None
) -> TelemetryResponse:
    """Telemetry of one device; raises :class:`TelemetryNotFound` when there is none."""
    rows = in_range(of_gpu(telemetry, gpu_id), start, end)
    if not rows.select("gpu_id").take(1):
        raise TelemetryNotFound(gpu_id)
    return _respond(rows, start, end)


def get_gpu_telemetry(telemetry: DataFrame, gpu_id: str, start: str = "", end: str = "") -> TelemetryResponse:
    """The same with the bounds as RFC3339 text."""
    if not gpu_id:
        raise InvalidArgument("gpu_id is required")
    return query_telemetry(telemetry, gpu_id, *parse_time_bounds(start, end))


def telemetry_of_all(
    telemetry: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> TelemetryResponse:
    """The answers for every device at once, keyed by ``gpu_id``."""
    return _respond(in_range(telemetry, start, end), start, end)


def _respond(
    rows: DataFrame, start: datetime | None, end: datetime | None
) -> TelemetryResponse:
    # Sorted as stored: a document is parsed after the sort, once.
    ordered = rows.select("gpu_id", "timestamp", "data").orderBy("gpu_id", "timestamp")
    return TelemetryResponse(
        records=expand_data(ordered),
        fields=fields_available(expand_data(rows), per_gpu=True),
        summary=effective_range(rows, start, end, per_gpu=True),
    )
