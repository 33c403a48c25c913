"""Headline timings, one JSON line.

``BENCH_SF_DIR`` names the input, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pulsegrid.plans.event_queries import QUERIES
from pulsegrid.session import build_session

HEADLINES = (
    "telemetry_range",
    "list_gpus",
    "records_per_gpu",
    "hourly_average",
    "hourly_average_by_gpu",
    "fields_available",
    "response_records",
    "validate_records",
    "dedup_first",
    "insert_if_absent",
    "write_telemetry",
    "to_message",
    "route_modulo",
    "route_ring",
    "append_offsets",
    "consume_batch",
    "partition_stats",
    "compact",
    "publish_log",
    "collect_from_log",
    "stream_collected",
    "continuous_hourly",
)
ROUNDS = 3
# A query that takes longer than this is timed once after its warm-up.
LONG_SECONDS = 3.0


def timed(run, spark, sf_dir: str) -> float:
    began = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in HEADLINES:
        rounds = 1 if timed(QUERIES[name], spark, sf_dir) > LONG_SECONDS else ROUNDS
        seconds[name] = round(statistics.median(timed(QUERIES[name], spark, sf_dir) for _ in range(rounds)), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
                "events_per_sec": {name: round(events / s) for name, s in seconds.items()},
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
