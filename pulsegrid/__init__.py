"""Telemetry on Spark: ingest, a message log as tables, and questions about both."""

from pulsegrid.plans.ingest import collect_batch, publish_csv, publish_records
from pulsegrid.plans.response import get_gpu_telemetry, query_telemetry, telemetry_of_all
from pulsegrid.schema import TopicSpec
from pulsegrid.session import build_session, prepare_session
from pulsegrid.sources.csv_records import read_csv_records, read_metric_rows, stream_csv_records
from pulsegrid.sources.message_log import MessageLog
from pulsegrid.sources.telemetry_table import TelemetryTable, read_telemetry, read_telemetry_jdbc
from pulsegrid.streaming.collect import stream_collect
from pulsegrid.streaming.compaction import compact_due_topics
from pulsegrid.streaming.publish import stream_publish
from pulsegrid.streaming.rollup import continuous_average, latest_average

__all__ = [
    "MessageLog",
    "TelemetryTable",
    "TopicSpec",
    "build_session",
    "collect_batch",
    "compact_due_topics",
    "continuous_average",
    "get_gpu_telemetry",
    "latest_average",
    "prepare_session",
    "publish_csv",
    "publish_records",
    "query_telemetry",
    "read_csv_records",
    "read_metric_rows",
    "read_telemetry",
    "read_telemetry_jdbc",
    "stream_collect",
    "stream_csv_records",
    "stream_publish",
    "telemetry_of_all",
]
