"""The entity views of ``strata.plans.entities`` as common table expressions."""

from __future__ import annotations

VIEWS = {
    "app_events": """
        SELECT e.event_id, e.user_id,
               CASE e.event_type WHEN 'purchase' THEN 'booking' WHEN 'view' THEN 'search'
                    ELSE e.event_type END AS event_type,
               e.ts AS "timestamp", e.value AS amount, r.r_name AS region, n.n_name AS country,
               c.c_mktsegment AS source, strftime(e.ts, '%Y-%m-%d') AS processing_date
        FROM events e JOIN customer c ON e.user_id = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "dirty_events": """
        SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS user_id,
               CASE WHEN event_id % 5 = 0 THEN '  ' || upper(event_type) || ' ' ELSE event_type END AS event_type,
               "timestamp", CASE WHEN event_id % 29 = 0 THEN -amount ELSE amount END AS amount,
               lower(region) AS region
        FROM (SELECT *, unnest(CASE WHEN event_id % 23 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM app_events)""",
    "tours": """
        SELECT p_partkey AS tour_id, p_name AS name, r_name AS region, p_retailprice AS price,
               CAST(3.5 + (p_partkey % 16) / 10.0 AS DOUBLE) AS rating, string_split(p_name, ' ') AS tags,
               p_type AS category, p_brand AS brand
        FROM part JOIN region ON r_regionkey = p_partkey % 5""",
    "tour_events": """
        SELECT o_custkey AS user_id, l_partkey AS tour_id,
               CASE l_returnflag WHEN 'N' THEN 'booking' WHEN 'A' THEN 'click' WHEN 'R' THEN 'view' END AS event_type,
               l_extendedprice AS amount, l_shipdate AS "timestamp", r_name AS region,
               strftime(l_shipdate, '%Y-%m-%d') AS processing_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN region ON r_regionkey = l_partkey % 5""",
    "bookings": """
        SELECT o_orderkey AS booking_id, o_custkey AS user_id, o_totalprice AS amount,
               o_orderdate AS created_at, o_orderstatus AS status FROM orders""",
    "data_sources": """
        SELECT 'src_' || n_nationkey AS source_id, n_name AS source_name,
               CASE WHEN n_regionkey < 2 THEN 'api' ELSE 'jdbc' END AS source_type,
               n_nationkey % 7 <> 0 AS is_enabled FROM nation""",
    "source_executions": """
        SELECT o_orderkey AS execution_id, 'src_' || (o_custkey % 20) AS source_id,
               CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' WHEN 'P' THEN 'PARTIAL' END AS status,
               o_orderdate AS started_at, CAST(o_orderkey % 101 AS DOUBLE) AS quality_score,
               o_orderkey % 1000 AS extracted_record_count,
               o_orderkey % 1000 - o_orderkey % 10 AS validated_record_count,
               o_orderkey * 7 % 600 AS duration_seconds FROM orders""",
    "pipeline_runs": """
        SELECT o_orderkey AS run_id, o_orderpriority AS dag_id, o_orderdate AS started_at,
               o_orderkey * 7 % 600 AS duration_seconds,
               CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' WHEN 'P' THEN 'RUNNING' END AS status
        FROM orders""",
    "lineage_nodes": """
        SELECT CAST(1000 + r_regionkey AS BIGINT) AS id, r_name AS name, 'source' AS type,
               CAST(NULL AS BIGINT) AS parent_id FROM region
        UNION ALL SELECT CAST(2000 + n_nationkey AS BIGINT), n_name, 'bronze', CAST(1000 + n_regionkey AS BIGINT) FROM nation
        UNION ALL SELECT 3000 + s_suppkey, s_name, 'silver', CAST(2000 + s_nationkey AS BIGINT) FROM supplier""",
    "logs": """
        SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
               WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level, 'svc-' || (user_id % 5) AS service,
               event_type || ' ' || props AS message, value * 20 AS response_time FROM events""",
    "clicks": """
        SELECT event_id, user_id, ts AS "timestamp", user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
               '/' || event_type || '/' || json_extract_string(props, '$.k') AS page_url, event_type AS category,
               ['mobile', 'tablet', 'desktop'][user_id % 3 + 1] AS device_type FROM events""",
    "changes": """
        SELECT user_id AS key, CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'purchase' THEN 'u'
               WHEN 'click' THEN 'u' WHEN 'error' THEN 'd' END AS op, epoch_us(ts) // 1000 AS ts_ms,
               event_id AS "offset", value AS balance FROM events""",
    "positions": """
        SELECT event_id, user_id, ts AS "timestamp", CAST(event_id * 7919 % 18000 AS DOUBLE) / 100 - 90 AS latitude,
               CAST(event_id * 104729 % 36000 AS DOUBLE) / 100 - 180 AS longitude FROM events""",
    "offsets": """
        SELECT topic, instance, ts, CAST(sum(n) OVER (PARTITION BY topic, instance, ts >= '2024-01-15' ORDER BY ts) AS DOUBLE) AS value
        FROM (SELECT CASE event_type WHEN 'error' THEN 'dlq_processing_errors' WHEN 'signup' THEN 'dlq_schema_validation_errors'
                     ELSE 'topic_' || event_type END AS topic, 'broker-' || (user_id % 3) AS instance,
                     date_trunc('minute', ts) AS ts, count(*) AS n FROM events GROUP BY ALL)""",
    "request_counters": """
        SELECT service, status, ts, metric, CAST(sum(v) OVER (PARTITION BY service, status, metric, ts >= '2024-01-15' ORDER BY ts) AS DOUBLE) AS value
        FROM (SELECT service, status, ts, unnest(['request_duration_count', 'request_duration_sum']) AS metric, unnest([n, ms]) AS v
              FROM (SELECT 'svc-' || (user_id % 5) AS service, CASE WHEN event_type = 'error' THEN '5xx' ELSE '2xx' END AS status,
                           date_trunc('minute', ts) AS ts, count(*) AS n, CAST(sum(CAST(round(value * 20) AS BIGINT)) AS BIGINT) AS ms
                    FROM events GROUP BY ALL))""",
    "gauges": """
        SELECT instance, ts, unnest(['memory_available', 'memory_total']) AS metric, unnest([a, t]) AS value
        FROM (SELECT 'node-' || (user_id % 5) AS instance, date_trunc('hour', ts) AS ts, min(value) AS a, max(value) + 1 AS t
              FROM events GROUP BY ALL)""",
    "up": """
        SELECT ['kafka-1', 'kafka-2', 'postgres-1', 'minio', 'api'][user_id % 5 + 1] AS job, 'host-' || (user_id % 7) AS instance, ts,
               event_id AS sample_id, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM events""",
    "latency_buckets": """
        SELECT service, b AS le, CAST(count(*) FILTER (WHERE response_time <= b) AS DOUBLE) AS count
        FROM logs, (SELECT unnest([250.0, 500.0, 1000.0, 2500.0, 5000.0, 'inf'::DOUBLE]) AS b) GROUP BY ALL""",
    "searches": """
        SELECT user_id, event_type || ' ' || json_extract_string(props, '$.k') AS query,
               (user_id + CAST(json_extract_string(props, '$.k') AS BIGINT)) % 7 AS results_count FROM events""",
}
NEEDS = {"dirty_events": ["app_events"], "latency_buckets": ["logs"]}



def using(*names: str, **extra: str) -> str:
    """A WITH clause defining the named views, then ``extra`` ones in order."""
    ordered: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ordered] + [f"{n} AS ({s})" for n, s in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"
