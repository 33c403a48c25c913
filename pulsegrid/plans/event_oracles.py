"""Plain SQL answers to the queries of :mod:`pulsegrid.plans.event_queries`."""

from __future__ import annotations

GPU = "gpu-0001"
MICROS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"

T = """t AS (
  SELECT event_id,
         'gpu-' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(4, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS gpu_id,
         ts, event_type AS metric_name, value, props AS data
  FROM events)"""

HASHED = (
    T
    + """, hashed AS (
  SELECT *, list_reduce(list_transform(string_split(gpu_id, ''), lambda x: ord(x)::BIGINT),
                        lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT) AS hash
  FROM t)"""
)

MESSAGES = (
    HASHED
    + f""", m AS (
  SELECT event_id AS arrival, gpu_id AS "key", hash, metric_name, {MICROS} AS stamp, ts,
         CAST(to_json({{'data': data, 'gpu_id': gpu_id, 'metric_name': metric_name,
                        'timestamp': {MICROS}, 'value': CAST(value AS VARCHAR)}}) AS VARCHAR) AS payload
  FROM hashed)"""
)

LOG = (
    MESSAGES
    + """, routed AS (
  SELECT 'telemetry' AS topic, CAST(hash % 3 AS INTEGER) AS "partition", * FROM m
  UNION ALL
  SELECT 'alerts', CAST(hash % 2 AS INTEGER), * FROM m WHERE metric_name = 'error'),
log AS (
  SELECT *, row_number() OVER (PARTITION BY topic, "partition" ORDER BY arrival) - 1 AS "offset" FROM routed),
ends AS (
  SELECT topic, "partition", count(*) AS n FROM log GROUP BY ALL),
listed AS (
  SELECT * FROM (VALUES ('telemetry', 0), ('telemetry', 1), ('telemetry', 2), ('alerts', 0), ('alerts', 1), ('idle', 0))
    v(topic, "partition")),
extents AS (
  SELECT topic, "partition", coalesce(n, 0) AS end_offset, coalesce(n, 0) // 10 AS base_offset
  FROM listed LEFT JOIN ends USING (topic, "partition")),
commits AS (
  SELECT topic, "partition", g AS "group", n * tenth // 10 AS "offset"
  FROM ends, (VALUES ('fast', 7), ('slow', 3)) v(g, tenth)),
marks AS (
  SELECT topic, "partition", base_offset, end_offset,
         coalesce((SELECT min("offset") FROM commits c
                   WHERE c.topic = e.topic AND c."partition" = e."partition"), base_offset) AS watermark
  FROM extents e)"""
)


def with_t(sql: str) -> str:
    return f"WITH {T} {sql}"


def with_log(sql: str) -> str:
    return f"WITH {LOG} {sql}"


def ring_sql(topic: str, partitions: int, replicas: int = 3) -> str:
    """The points of the ring, hashed in SQL; on a collision the later partition wins."""
    return f"""(SELECT h, max(p) AS p FROM (
        SELECT p, list_reduce(list_transform(string_split('{topic}-' || p || '-' || r, ''), lambda x: ord(x)::BIGINT),
                              lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT) AS h
        FROM range({partitions}) x(p), range({replicas}) y(r)) GROUP BY h) ring"""


HOURLY = T + """, hourly AS (
  SELECT event_id, gpu_id, date_trunc('hour', ts) AS ts, metric_name, value, data FROM t),
firsts AS (
  SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY gpu_id, ts ORDER BY event_id) = 1)"""

MIXED = T + """, mixed AS (
  SELECT event_id, gpu_id, CASE metric_name
           WHEN 'error' THEN CAST(to_json({'raw': 'not json ' || data}) AS VARCHAR)
           WHEN 'view' THEN CAST(to_json({'raw': '[' || data || ']'}) AS VARCHAR)
           WHEN 'signup' THEN NULL
           ELSE CAST(to_json({'k': CAST(json_extract(data, '$.k') AS BIGINT)}) AS VARCHAR) END AS data
  FROM t)"""

FAULTS = MESSAGES + """, faulty AS (
  SELECT arrival, "key", stamp, ts, metric_name, CASE metric_name
           WHEN 'view' THEN '{"gpu_id":' || arrival || ',"timestamp":"' || stamp || '"}'
           WHEN 'error' THEN '{"gpu_id":"' || "key" || '","timestamp":"' || replace(stamp, 'T', ' ') || '"}'
           WHEN 'signup' THEN payload || ' trailing'
           WHEN 'purchase' THEN '{"gpu_id":"' || "key" || '","timestamp":"","n":' || arrival || '}'
         END AS raw
  FROM m)"""

LISTED = 'event_id, gpu_id, ts AS "timestamp", metric_name, value, data'
RECORD = f'event_id AS arrival, gpu_id, {MICROS} AS "timestamp", metric_name, CAST(value AS VARCHAR) AS value, data'
RANGE = "ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'"

ORACLES = {
    "list_gpus": with_t("SELECT DISTINCT gpu_id FROM t ORDER BY gpu_id"),
    "gpu_summary": with_t('SELECT count(DISTINCT gpu_id) AS "count" FROM t'),
    "telemetry_by_gpu": with_t(f"SELECT {LISTED} FROM t WHERE gpu_id = '{GPU}' ORDER BY ts"),
    "telemetry_range": with_t(f"SELECT {LISTED} FROM t WHERE gpu_id = '{GPU}' AND {RANGE} ORDER BY ts"),
    "effective_range": with_t(
        """SELECT gpu_id, count(*) AS "count", TIMESTAMP '2024-01-10' AS start_time, max(ts) AS end_time
           FROM t WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY gpu_id"""
    ),
    "expand_data": f"WITH {MIXED} SELECT event_id, data FROM mixed",
    "fields_available": f"WITH {MIXED} SELECT DISTINCT unnest(json_keys(data)) AS field FROM mixed",
    "fields_per_gpu": f"WITH {MIXED} SELECT DISTINCT gpu_id, unnest(json_keys(data)) AS field FROM mixed",
    "expand_field": with_t("SELECT event_id, CAST(json_extract_string(data, '$.k') AS DOUBLE) AS k FROM t"),
    "response_records": with_t(
        f"""SELECT gpu_id, ts AS "timestamp", '{{"k":' || json_extract_string(data, '$.k') || '}}' AS data
            FROM t WHERE {RANGE}"""
    ),
    "gpu_records": with_t(
        f"""SELECT gpu_id, ts AS "timestamp", '{{"k":' || json_extract_string(data, '$.k') || '}}' AS data
            FROM t WHERE gpu_id = '{GPU}' AND {RANGE}"""
    ),
    "gpu_fields": with_t(f"SELECT DISTINCT gpu_id, 'k' AS field FROM t WHERE gpu_id = '{GPU}' AND {RANGE}"),
    "gpu_range": with_t(
        f"""SELECT gpu_id, count(*) AS "count", TIMESTAMP '2024-01-10' AS start_time, TIMESTAMP '2024-01-20' AS end_time
            FROM t WHERE gpu_id = '{GPU}' AND {RANGE} GROUP BY gpu_id"""
    ),
    "sample_rows": with_t("SELECT least(10, count(*)) AS sampled, 0::BIGINT AS foreign FROM t").replace(
        "AS foreign", 'AS "foreign"'
    ),
    "two_topics_streamed": with_log('SELECT topic, "partition", "offset", "key" FROM log'),
    "two_sources_one_topic": with_log(
        """SELECT topic, "partition", row_number() OVER (PARTITION BY "partition" ORDER BY arrival % 2, arrival) - 1 AS "offset",
                  "key", payload FROM log WHERE topic = 'telemetry'"""
    ),
    "two_collectors_one_table": f"""WITH {MESSAGES} SELECT "key" AS gpu_id, ts AS "timestamp", payload AS data FROM m""",
    "stream_bounded": with_t(
        """SELECT event_id % 2 AS batch_id, count(*) AS polled, 0::BIGINT AS rejected, count(*) AS inserted,
                  0::BIGINT AS duplicates FROM t GROUP BY 1"""
    ),
    "stream_bounded_messages": with_t(
        """SELECT 10::BIGINT AS turns, count(*) AS polled, 0::BIGINT AS rejected, count(*) AS inserted,
                  0::BIGINT AS duplicates, count(*) AS stored FROM t"""
    ),
    "publish_rejects": with_t(
        """SELECT CASE metric_name WHEN 'purchase' THEN 'missing_key' WHEN 'error' THEN 'partition_range' ELSE 'kept' END AS reason,
                  count(*) AS messages FROM t GROUP BY 1"""
    ),
    "own_publisher": with_t("SELECT event_id AS arrival, gpu_id, CAST(value AS VARCHAR) AS value FROM t"),
    "own_sink": f"""WITH {MESSAGES} SELECT "key" AS gpu_id, ts AS "timestamp", payload AS data FROM m WHERE metric_name = 'error'""",
    "multi_group_watermark": with_log(
        """SELECT topic, "partition", CASE topic WHEN 'telemetry' THEN least(coalesce(n, 0), 100) ELSE 0 END AS watermark
           FROM listed LEFT JOIN ends USING (topic, "partition")"""
    ),
    "group_offsets": with_log('SELECT topic, "partition", end_offset + 3 AS "offset" FROM extents'),
    "response_summary": with_t(
        """SELECT gpu_id, count(*) AS "count", min(ts) AS start_time, TIMESTAMP '2024-01-20' AS end_time
           FROM t WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY gpu_id"""
    ),
    "count_records": with_t('SELECT count(*) AS "count" FROM t'),
    "recent_for_gpu": with_t(f"SELECT {LISTED} FROM t WHERE gpu_id = '{GPU}' ORDER BY ts DESC LIMIT 10"),
    "latest_ingested": with_t(
        f"SELECT {LISTED}, date_trunc('day', ts)::TIMESTAMP AS created_at FROM t ORDER BY created_at DESC, event_id DESC LIMIT 10"
    ),
    "hourly_average": with_t(
        """SELECT date_trunc('hour', ts) AS "hour", avg(CAST(json_extract_string(data, '$.k') AS DOUBLE)) AS average
           FROM t GROUP BY 1"""
    ),
    "hourly_average_by_gpu": with_t(
        """SELECT date_trunc('hour', ts) AS bucket, gpu_id, avg(CAST(json_extract_string(data, '$.k') AS DOUBLE)) AS average
           FROM t GROUP BY 1, 2"""
    ),
    "records_per_gpu": with_t('SELECT gpu_id, count(*) AS "count" FROM t GROUP BY 1'),
    "by_metric": with_t(f"SELECT {LISTED} FROM t WHERE metric_name = 'error' AND {RANGE}"),
    "find_duplicates": f"""WITH {HOURLY} SELECT gpu_id, ts AS "timestamp", count(*) AS "count"
        FROM hourly GROUP BY ALL HAVING count(*) > 1""",
    "count_duplicate_keys": f"""WITH {HOURLY} SELECT count(*) AS duplicate_keys
        FROM (SELECT 1 FROM hourly GROUP BY gpu_id, ts HAVING count(*) > 1)""",
    "dedup_first": f"WITH {HOURLY} SELECT {LISTED} FROM firsts",
    "insert_if_absent": f"""WITH {HOURLY} SELECT {LISTED} FROM firsts f WHERE NOT EXISTS (
        SELECT 1 FROM hourly h WHERE h.ts < TIMESTAMP '2024-01-10' AND h.gpu_id = f.gpu_id AND h.ts = f.ts)""",
    "write_telemetry": f"""WITH {HOURLY} SELECT gpu_id, ts AS "timestamp", data,
        CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 0 ELSE 1 END::BIGINT AS batch_id FROM firsts""",
    "assign_row_id": with_t(
        'SELECT event_id, gpu_id, ts AS "timestamp", row_number() OVER (ORDER BY ts, event_id) AS id FROM t'
    ),
    "restamp": with_t(
        """SELECT event_id AS arrival, gpu_id, '2026-04-10T15:00:00Z' AS "timestamp", metric_name,
                  CAST(value AS VARCHAR) AS value, data FROM t"""
    ),
    "require_key": with_t("SELECT event_id AS arrival, gpu_id FROM t WHERE metric_name NOT IN ('view', 'error')"),
    "to_message": f'WITH {MESSAGES} SELECT arrival, "key", payload FROM m',
    "payload_roundtrip": f"WITH {MESSAGES} SELECT arrival, to_base64(encode(payload)) AS wire, payload FROM m",
    "validate_records": f"""WITH {FAULTS} SELECT "key" AS gpu_id, ts AS "timestamp", arrival,
        '{{"gpu_id":"' || "key" || '","n":1,"timestamp":"' || stamp || '"}}' AS data
        FROM faulty WHERE metric_name = 'click'""",
    "rejects": f"""WITH {FAULTS} SELECT arrival, CASE metric_name WHEN 'view' THEN 'missing_fields'
          WHEN 'purchase' THEN 'missing_fields' WHEN 'error' THEN 'bad_timestamp' ELSE 'bad_json' END AS reason, raw
        FROM faulty WHERE metric_name <> 'click'""",
    "decode_base64_payload": f"""WITH {MESSAGES} SELECT arrival,
          CASE WHEN metric_name <> 'view' THEN "key" END AS gpu_id,
          CASE WHEN metric_name <> 'view' THEN ts END AS "timestamp",
          CASE WHEN metric_name = 'view' THEN 'bad_base64' END AS reason FROM m""",
    "parse_timestamps": with_t(
        """SELECT event_id, CASE metric_name WHEN 'click' THEN date_trunc('second', ts)
             WHEN 'view' THEN ts - INTERVAL 330 MINUTE WHEN 'error' THEN ts + INTERVAL 20 HOUR END AS parsed FROM t"""
    ),
    "canonical_documents": with_t("""SELECT event_id, '{"a":[1,2.5,null],"z":' || event_id || '}' AS document FROM t"""),
    "hash_keys": f"WITH {HASHED} SELECT event_id, hash FROM hashed",
    "route_modulo": f'WITH {HASHED} SELECT event_id, CAST(hash % 3 AS INTEGER) AS "partition" FROM hashed',
    "route_ring": f"""WITH {HASHED} SELECT event_id, CAST(coalesce(
          (SELECT arg_min(p, h) FROM {ring_sql("telemetry", 3)} WHERE h >= hash),
          (SELECT arg_min(p, h) FROM {ring_sql("telemetry", 3)})) AS INTEGER) AS "partition" FROM hashed""",
    "route_custom": with_t(
        """SELECT event_id AS arrival, 'telemetry' AS topic, CAST(right(gpu_id, 1) AS INTEGER) % 4 AS "partition" FROM t"""
    ),
    "append_offsets": with_log('SELECT topic, "partition", "offset", "key", arrival FROM log'),
    "append_after_tail": with_log(
        'SELECT topic, "partition", "offset" + n AS "offset", arrival FROM log JOIN ends USING (topic, "partition")'
    ),
    "apply_capacity": with_log(
        """SELECT topic, "partition", "offset", arrival FROM log JOIN ends USING (topic, "partition")
           WHERE "offset" < n * 4 // 10 OR n * 4 // 10 = 0"""
    ),
    "partition_full": with_log(
        """SELECT 'partition_full' AS reason, topic, "partition", n - n * 4 // 10 AS refused FROM ends
           WHERE n * 4 // 10 > 0"""
    ),
    "topic_summary": with_log(
        """SELECT topic, count(*) AS partitions, CAST(sum(end_offset) AS BIGINT) AS messages FROM extents GROUP BY topic"""
    ),
    "read_from": with_log(
        """SELECT "partition", "offset", "key", arrival FROM log JOIN extents USING (topic, "partition")
           WHERE topic = 'telemetry' AND "partition" = 1
             AND "offset" >= base_offset + 100 AND "offset" < base_offset + 600"""
    ),
    "get_message": with_log(
        """SELECT "partition", "offset", "key", arrival FROM log JOIN extents USING (topic, "partition")
           WHERE topic = 'telemetry' AND "partition" = 2 AND "offset" = base_offset"""
    ),
    "consume_batch": with_log(
        """SELECT "partition", l."offset", "key", arrival, least(n * 7 // 10 + 50, n) AS next_offset
           FROM log l JOIN ends USING (topic, "partition")
           WHERE topic = 'telemetry' AND l."offset" >= n * 7 // 10 AND l."offset" < n * 7 // 10 + 50"""
    ),
    "consume_positions": with_log(
        """SELECT topic, "partition", 'newcomer' AS "group", base_offset AS start_offset,
                  least(base_offset + 10, end_offset) AS next_offset, end_offset
           FROM extents WHERE topic = 'telemetry'"""
    ),
    "commit_validity": with_log(
        """SELECT topic, "partition", g AS "group",
             CASE g WHEN 'tail' THEN end_offset WHEN 'past' THEN end_offset + 1
                    WHEN 'below' THEN base_offset - 1 ELSE base_offset END AS "offset",
             CASE g WHEN '' THEN 'empty group' WHEN 'past' THEN 'offset out of range'
                    WHEN 'below' THEN 'offset out of range' END AS error
           FROM extents, (VALUES ('tail'), ('past'), ('base'), ('below'), ('')) v(g)"""
    ),
    "committed_offsets": with_log('SELECT topic, "partition", "group", "offset" FROM commits'),
    "offset_watermark": with_log('SELECT topic, "partition", watermark FROM marks'),
    "registered_watermark": with_log(
        """SELECT topic, "partition", CASE topic WHEN 'telemetry' THEN base_offset ELSE watermark END AS watermark FROM marks"""
    ),
    "partition_stats": with_log(
        """SELECT topic || '-' || "partition" AS id, topic, "partition", end_offset - base_offset AS message_count,
                  end_offset - base_offset AS tail_offset, watermark - base_offset AS min_consumer_offset,
                  watermark - base_offset AS compactable_count FROM marks"""
    ),
    "consumer_lag": with_log(
        'SELECT topic, "partition", "group", n - "offset" AS lag FROM commits JOIN ends USING (topic, "partition")'
    ),
    "retained_bytes": with_log(
        """, sizes AS (
             SELECT topic, sum(CASE WHEN "offset" >= watermark THEN octet_length(encode(payload)) ELSE 0 END) AS held,
                    sum(octet_length(encode(payload))) AS total, count(*) AS messages
             FROM log JOIN marks USING (topic, "partition") WHERE "offset" >= base_offset GROUP BY topic),
           lags AS (
             SELECT topic, max(end_offset - watermark) AS lag, count(*) AS parts FROM marks GROUP BY topic)
           SELECT topic, CAST(coalesce(held, 0) AS BIGINT) AS retained_bytes,
                  coalesce(CAST(lag * parts AS DOUBLE) * (CAST(total AS DOUBLE) / CAST(messages AS DOUBLE)), 0) AS bound_bytes
           FROM lags LEFT JOIN sizes USING (topic)"""
    ),
    "stalled_watermark": f"""WITH {HASHED}, daily AS (
          SELECT 'telemetry' AS topic, CAST(hash % 3 AS INTEGER) AS "partition",
                 date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS "day", count(*) AS n
          FROM hashed GROUP BY ALL),
        tails AS (
          SELECT a.topic, a."partition", a."day" AS snapshot_id, CAST(sum(b.n) AS BIGINT) AS tail_offset,
                 CAST(sum(CASE WHEN b."day" <= a."day" - a."day" % 3 THEN b.n ELSE 0 END) AS BIGINT) AS watermark
          FROM daily a JOIN daily b ON a."partition" = b."partition" AND b."day" <= a."day" GROUP BY ALL)
        SELECT now.topic, now."partition", now.snapshot_id, now.watermark,
               now.tail_offset - before.tail_offset AS grown_by
        FROM tails now JOIN tails before
          ON now."partition" = before."partition" AND now.snapshot_id = before.snapshot_id + 1
        WHERE now.tail_offset > before.tail_offset AND now.watermark = before.watermark""",
    "compact": with_log(
        """SELECT topic, "partition", "offset", arrival FROM log JOIN marks USING (topic, "partition")
           WHERE "offset" >= watermark"""
    ),
    "compaction_plan": with_log(
        """SELECT topic || '-' || "partition" AS id, topic, "partition", watermark AS base_offset,
                  watermark - base_offset AS removed FROM marks"""
    ),
    "rebase_offsets": with_log(
        """SELECT topic, "partition", "offset" - base_offset AS "offset", arrival
           FROM log JOIN extents USING (topic, "partition") WHERE "offset" >= base_offset"""
    ),
    "rebase_commits": with_log(
        """SELECT topic, "partition", "group", greatest("offset" - base_offset, 0) AS "offset"
           FROM commits JOIN extents USING (topic, "partition")"""
    ),
    "compaction_triggers": with_log(
        """SELECT topic, bool_or(end_offset - base_offset > 1000 OR watermark - base_offset > 500) AS due
           FROM marks GROUP BY topic"""
    ),
    "compaction_summary": with_log(
        """SELECT topic, CAST(sum(watermark - base_offset) AS BIGINT) AS messages_removed,
                  count(*) AS partitions_compacted FROM marks GROUP BY topic"""
    ),
    "compact_due": with_log(
        """, due AS (SELECT topic FROM marks GROUP BY topic
             HAVING bool_or(end_offset - base_offset > 1000 OR watermark - base_offset > 500))
           SELECT topic || '-' || "partition" AS id, topic, "partition", watermark AS base_offset,
                  watermark - base_offset AS removed FROM marks WHERE topic IN (SELECT topic FROM due)"""
    ),
    "read_csv": with_t(f"SELECT {RECORD}, CAST(event_id AS VARCHAR) AS arrival_no FROM t").replace(
        "event_id AS arrival, ", ""
    ),
    "read_metrics": with_t(
        """SELECT ts AS "timestamp", metric_name, gpu_id, '' AS device, '' AS uuid, '' AS "modelName", '' AS "Hostname",
                  '' AS container, '' AS pod, '' AS "namespace", value, data AS labels_raw FROM t"""
    ),
    "publish_from_csv": with_log(
        """SELECT topic, "partition", count(*) AS messages, 0::BIGINT AS first_offset, count(*) - 1 AS last_offset,
                  count(*) AS offsets, count(DISTINCT "key") AS gpus, 0::BIGINT AS out_of_order
           FROM log WHERE topic = 'telemetry' GROUP BY ALL"""
    ),
    "publish_log": with_log('SELECT topic, "partition", "offset", "key", payload FROM log'),
    "collect_from_log": f"""WITH {MESSAGES} SELECT "key" AS gpu_id, ts AS "timestamp", payload AS data,
        0::BIGINT AS batch_id FROM m""",
    "stored_compaction": with_log(
        """, due AS (SELECT topic FROM ends GROUP BY topic HAVING bool_or(n > 1000 OR n * 3 // 10 > 500))
           SELECT topic, "partition", "offset" FROM log JOIN ends USING (topic, "partition")
           WHERE topic NOT IN (SELECT topic FROM due) OR "offset" >= n * 3 // 10"""
    ),
    "stream_publish_csv": with_log(
        """SELECT "key", "partition", count(*) AS messages, 0::BIGINT AS gaps, n AS offsets
           FROM log JOIN ends USING (topic, "partition") WHERE topic = 'telemetry' GROUP BY ALL"""
    ),
    "stream_collected": f"""WITH {HOURLY} SELECT gpu_id, ts AS "timestamp",
        '{{"gpu_id":"' || gpu_id || '","k":"' || json_extract_string(data, '$.k') || '","timestamp":"'
          || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}}' AS data FROM firsts""",
    "stream_metrics": f"""WITH {HOURLY}, n AS (
          SELECT (SELECT count(*) FROM hourly) AS polled, (SELECT count(*) FROM firsts) AS inserted)
        SELECT 'db' AS query, polled, 0::BIGINT AS rejected, inserted, polled - inserted AS duplicates,
               0.0::DOUBLE AS reject_share, (polled - inserted)::DOUBLE / polled::DOUBLE AS duplicate_share FROM n""",
    "continuous_hourly": with_t(
        """SELECT date_trunc('hour', ts) AS bucket, gpu_id, avg(CAST(json_extract_string(data, '$.k') AS DOUBLE)) AS average
           FROM t GROUP BY 1, 2"""
    ),
}
