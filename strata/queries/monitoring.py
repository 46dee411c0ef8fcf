"""Counters, gauges, buckets and alerts derived from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.columns import ts_text
from strata.operators import timeseries as ts
from strata.queries import query
from strata.queries.entity_sql import using

_FMT = "'%Y-%m-%d %H:%M:%S.%f'"


def _deltas(view: str, series: str) -> str:
    return f"""
        SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta,
               (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000 AS elapsed
        FROM {view} WINDOW w AS (PARTITION BY {series} ORDER BY ts)"""


def _win(seconds: int) -> str:
    return f"strftime(time_bucket(INTERVAL {seconds} SECOND, ts, TIMESTAMP '1970-01-01'), {_FMT}) AS window_start"


_OFFSETS = using("offsets", d=_deltas("offsets", "topic, instance"))
SERIES = ["topic", "instance"]


def _started(df):
    return df.withColumn("window_start", ts_text("window_start"))


@query("V1 ST8", _OFFSETS + f"SELECT topic, {_win(300)}, coalesce(sum(delta), 0) / 300 AS rate FROM d GROUP BY ALL")
def topic_rate(e):
    return _started(ts.rate(e.offsets(), SERIES, ["topic"], 300))


@query("V2", _OFFSETS + f"SELECT topic, {_win(86400)}, coalesce(sum(delta), 0) AS increase FROM d GROUP BY ALL")
def topic_increase(e):
    return _started(ts.increase(e.offsets(), SERIES, ["topic"]))


@query("V3", _OFFSETS[:-1] + f""", l AS (
        SELECT topic, instance, {_win(3600)}, arg_max(delta / elapsed, ts) AS r FROM d WHERE delta IS NOT NULL GROUP BY ALL)
    SELECT instance, window_start, round(avg(r), 9) AS irate FROM l GROUP BY ALL""")
def broker_instant_rate(e):
    rates = ts.instant_rate(e.offsets(), SERIES, ["instance"], 3600)
    return _started(rates).withColumn("irate", F.round("irate", 9))


@query("V4", using("gauges") + f"""
    SELECT a.instance, strftime(a.ts, {_FMT}) AS ts, (1 - a.value / b.value) * 100 AS used FROM gauges a
    JOIN gauges b ON a.instance = b.instance AND a.ts = b.ts
    WHERE a.metric = 'memory_available' AND b.metric = 'memory_total' AND (1 - a.value / b.value) * 100 > 85""")
def high_memory(e):
    ratio = ts.gauge_ratio(e.gauges(), "memory_available", "memory_total", ["instance"])
    used = ratio.select("instance", ts_text("ts").alias("ts"), ((1 - F.col("ratio")) * 100).alias("used"))
    return used.where("used > 85")


@query("V5", using("latency_buckets", w="""
        SELECT *, coalesce(lag(le) OVER (PARTITION BY service ORDER BY le), 0) AS low,
               coalesce(lag(count) OVER (PARTITION BY service ORDER BY le), 0) AS below,
               max(count) OVER (PARTITION BY service) * 0.95 AS rank FROM latency_buckets""") + """
    SELECT service, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * ((rank - below) / (count - below)) END AS quantile
    FROM w WHERE count >= rank AND below < rank""")
def latency_quantile(e):
    return ts.bucket_quantile(e.latency_buckets(), ["service"], 0.95)


_LAST = "SELECT topic, instance, max(ts) AS ts, arg_max(value, ts) AS value FROM offsets GROUP BY ALL"


@query("V6", using("offsets", l=_LAST) + """
    SELECT topic, instance, value FROM l ORDER BY value DESC, topic, instance LIMIT 10""")
def top_series(e):
    return ts.top_series(e.offsets(), SERIES, 10).drop("ts")


@query("V13", using("offsets", l=_LAST) + "SELECT topic, sum(value) AS value FROM l GROUP BY ALL")
def topic_totals(e):
    return ts.sum_latest(e.offsets(), SERIES, ["topic"])


@query("V13", using("up") + f"""
    SELECT job, instance, strftime(max(ts), {_FMT}) AS ts, arg_max(value, sample_id) AS value,
           CASE WHEN arg_max(value, sample_id) = 1 THEN 'UP' ELSE 'DOWN' END AS status FROM up GROUP BY ALL""")
def up_status(e):
    return ts.up_status(e.up(), ["job", "instance"], ["ts", "sample_id"]).withColumn("ts", ts_text("ts"))


_REQUESTS = using("request_counters", d=_deltas("request_counters", "service, status, metric"))


@query("V7", _REQUESTS[:-1] + f""", c AS (
        SELECT service, {_win(3600)}, coalesce(sum(delta) FILTER (WHERE status = '5xx'), 0) AS p, coalesce(sum(delta), 0) AS w
        FROM d WHERE metric = 'request_duration_count' GROUP BY ALL)
    SELECT service, window_start, CASE WHEN w > 0 THEN p / w ELSE 0 END AS error_ratio FROM c""")
def error_ratio(e):
    counters = e.request_counters().where("metric = 'request_duration_count'")
    return _started(
        ts.error_ratio(counters, ["service", "status"], ["service"], F.col("status") == "5xx", 3600)
    )


@query("V7", _REQUESTS[:-1] + f""", c AS (
        SELECT service, {_win(3600)}, coalesce(sum(delta) FILTER (WHERE metric = 'request_duration_sum'), 0) AS s,
               coalesce(sum(delta) FILTER (WHERE metric = 'request_duration_count'), 0) AS n FROM d GROUP BY ALL)
    SELECT service, window_start, s / n AS mean_latency FROM c WHERE n > 0""")
def mean_latency(e):
    return _started(ts.mean_latency(e.request_counters(), ["service", "status"], ["service"], 3600))


@query("V8", using("up", l="SELECT job, instance, arg_max(value, sample_id) AS value FROM up GROUP BY ALL", g="""
        SELECT avg(value) FILTER (WHERE job LIKE 'kafka%') AS kafka, avg(value) FILTER (WHERE job LIKE 'postgres%') AS postgres,
               avg(value) FILTER (WHERE job = 'minio') AS minio FROM l""") + """
    SELECT kafka, postgres, minio, (kafka + postgres + minio) / 3 * 100 AS health FROM g""")
def platform_health(e):
    groups = {"kafka": "kafka.*", "postgres": "postgres.*", "minio": "minio"}
    return ts.health_score(e.up(), ["job", "instance"], groups, ["ts", "sample_id"])


@query("V8", _OFFSETS + f"""
    SELECT {_win(3600)}, 100 - coalesce(sum(delta), 0) / 3600 * 10 AS health FROM d WHERE topic LIKE 'dlq%' GROUP BY ALL""")
def dead_letter_health(e):
    return _started(ts.dead_letter_health(e.offsets(), SERIES, 3600))


@query("V9", _OFFSETS[:-1] + f""", c AS (
        SELECT {_win(3600)}, coalesce(sum(delta) FILTER (WHERE topic LIKE 'dlq%'), 0) AS p, coalesce(sum(delta), 0) AS w FROM d GROUP BY ALL)
    SELECT window_start, (1 - (p / 3600) / (w / 3600 + 0.001::DOUBLE)) * 100 AS quality_score FROM c""")
def queue_quality(e):
    return _started(ts.quality_rate(e.offsets(), SERIES, 3600))


@query("V10", using("up", m="""
        SELECT *, max(CASE WHEN value <> 0 THEN sample_id END) OVER (PARTITION BY job, instance ORDER BY ts, sample_id
                      ROWS UNBOUNDED PRECEDING) AS since FROM up""", i="""
        SELECT job, instance, since, min(ts) AS a, max(ts) AS b, count(*) AS samples FROM m WHERE value = 0 GROUP BY ALL""") + f"""
    SELECT job, instance, strftime(a, {_FMT}) AS started_at, strftime(b, {_FMT}) AS last_seen, samples,
           epoch_us(b) - epoch_us(a) >= 120000000 AS firing FROM i""")
def down_alerts(e):
    found = ts.alerts(e.up(), ["job", "instance"], F.col("value") == 0, 120, ["sample_id"])
    return found.withColumns({c: ts_text(c) for c in ("started_at", "last_seen")})


_LAG = """
    WITH e AS (SELECT 'topic_' || event_type AS topic, user_id % 3 AS p, max(event_id) AS e, max(ts) AS t FROM events GROUP BY ALL),
    c AS (SELECT 'loader' AS grp, 'topic_' || event_type AS topic, user_id % 3 AS p, max(event_id) AS c, max(ts) AS t FROM events
          WHERE ts < '2024-01-20' GROUP BY ALL) """


@query("V11", _LAG + """
    SELECT grp AS "group", e.topic, max(e.e - coalesce(c.c, 0)) AS lag_messages, CAST(sum(e.e - coalesce(c.c, 0)) AS BIGINT) AS total_lag,
           max(greatest((epoch_us(e.t) / 1000000 - epoch_us(c.t) / 1000000), 0)) AS lag_seconds
    FROM e JOIN c ON e.topic = c.topic AND e.p = c.p GROUP BY ALL""")
def consumer_lag(e):
    rows = e.table("events").select(
        F.concat(F.lit("topic_"), "event_type").alias("topic"), (F.col("user_id") % 3).alias("partition"), "event_id", "ts"
    )
    ends = lambda df: df.groupBy("topic", "partition").agg(F.max("event_id").alias("offset"), F.max("ts").alias("ts"))
    done = ends(rows.where("ts < timestamp_ntz'2024-01-20'")).withColumn("group", F.lit("loader"))
    return ts.consumer_lag(ends(rows), done)


@query("V12", using("app_events", m="""
        SELECT processing_date AS day, 'data_quality_null_percentage' AS metric, count(*) FILTER (WHERE event_id % 7 = 0) / count(*) * 100 AS value FROM app_events GROUP BY ALL
        UNION ALL SELECT processing_date, 'api_success_rate', 100 - count(*) FILTER (WHERE event_type = 'error') / count(*) * 100 FROM app_events GROUP BY ALL
        UNION ALL SELECT processing_date, 'data_quality_check_status', CAST(min(CASE WHEN amount < 400 THEN 1 ELSE 0 END) AS DOUBLE) FROM app_events GROUP BY ALL""") + """
    SELECT day, metric, value, alert, severity FROM m JOIN (VALUES ('data_quality_null_percentage', 'high_null_rate'),
        ('api_success_rate', 'external_api_down'), ('data_quality_check_status', 'data_quality_check_failed')) r(rm, alert) ON metric = rm,
        (SELECT 'warning' AS severity)
    WHERE (rm = 'data_quality_null_percentage' AND value > 10) OR (rm = 'api_success_rate' AND value < 95)
       OR (rm = 'data_quality_check_status' AND value = 0)""")
def rule_alerts(e):
    days = e.app_events().groupBy(F.col("processing_date").alias("day")).agg(
        (F.count(F.when(F.col("event_id") % 7 == 0, 1)) / F.count("*") * 100).alias("nulls"),
        (100 - F.count(F.when(F.col("event_type") == "error", 1)) / F.count("*") * 100).alias("ok"),
        F.min(F.when(F.col("amount") < 400, 1.0).otherwise(0.0)).alias("status"),
    )
    metrics = days.select("day", F.expr(
        "stack(3, 'data_quality_null_percentage', nulls, 'api_success_rate', ok, 'data_quality_check_status', status) AS (metric, value)"
    ))
    found = ts.apply_rules(metrics, ts.rule_table(e.spark, ts.RULES))
    return found.select("day", "metric", "value", "alert", "severity")


_HELD = [
    ("memory_high", "memory_used_percent", ">", 85, 300),
    ("memory_high_for_hours", "memory_used_percent", ">", 85, 3 * 3600),
    ("memory_free_low", "memory_free_percent", "<", 5, 300),
]


@query("V10 V12", using("gauges", memory="""
        SELECT a.instance, a.ts, (1 - a.value / b.value) * 100 AS used FROM gauges a
        JOIN gauges b ON a.instance = b.instance AND a.ts = b.ts
        WHERE a.metric = 'memory_available' AND b.metric = 'memory_total'""")[:-1] + f""",
    judged AS (SELECT *, CASE WHEN op = '>' THEN used > threshold ELSE 100 - used < threshold END AS met
               FROM memory, (VALUES {", ".join(map(str, _HELD))}) r(alert, metric, op, threshold, hold)),
    named AS (SELECT *, max(CASE WHEN NOT met THEN ts END) OVER (PARTITION BY instance, alert ORDER BY ts) AS since FROM judged)
    SELECT instance, alert, strftime(min(ts), {_FMT}) AS started_at, strftime(max(ts), {_FMT}) AS last_seen, count(*) AS samples,
           epoch(max(ts)) - epoch(min(ts)) >= hold AS firing FROM named WHERE met GROUP BY instance, alert, since, hold""")
def held_rule_alerts(e):
    """Rules over two metrics, two of them apart by their hold time only."""
    used = (1 - F.col("ratio")) * 100
    metrics = ts.gauge_ratio(e.gauges(), "memory_available", "memory_total", ["instance"]).withColumn("used", used).select(
        "instance", "ts", F.expr("stack(2, 'memory_used_percent', used, 'memory_free_percent', 100 - used) AS (metric, value)")
    )
    rules = [(alert, metric, op, float(limit), hold, "warning") for alert, metric, op, limit, hold in _HELD]
    found = ts.held_alerts(metrics, ts.rule_table(e.spark, rules), ["instance"])
    times = {c: ts_text(c) for c in ("started_at", "last_seen")}
    return found.withColumns(times).select("instance", "alert", "started_at", "last_seen", "samples", "firing")
