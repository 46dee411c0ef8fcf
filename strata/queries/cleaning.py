"""Cleaning, reading, routing, duplicate removal, joins and change data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.functions import envelope
from strata.functions.columns import day_text, ts_text
from strata.operators import cdc, clean, dedup, enrich
from strata.plans.entities import recode
from strata.queries import query
from strata.queries.entity_sql import using
from strata.session import shared_dir
from strata.sources.tables import catalog_table
from strata.sources import incremental
from strata.sources.tables import bronze_partition

_TS = "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f') AS \"timestamp\""
DAY = "2024-01-25"


def _text_ts(df, *columns):
    return df.withColumns({c: ts_text(c) for c in columns or ("timestamp",)})


# --- cleaning ----------------------------------------------------------------------------------


@query("P1", using("dirty_events") + f"""
    SELECT event_id, user_id, event_type, amount, region, {_TS} FROM dirty_events
    WHERE user_id IS NOT NULL AND "timestamp" IS NOT NULL""")
def drop_incomplete(e):
    return _text_ts(clean.require(e.dirty_events(), "user_id", "timestamp"))


@query("P2", using("dirty_events") + """
    SELECT event_id, lower(trim(event_type)) AS event_type, upper(trim(region)) AS region FROM dirty_events""")
def standardise_text(e):
    return clean.standardise(e.dirty_events()).select("event_id", "event_type", "region")


@query("P3", using("dirty_events") + "SELECT event_id, amount FROM dirty_events WHERE amount >= 0")
def non_negative_amounts(e):
    return clean.non_negative(e.dirty_events()).select("event_id", "amount")


_CLEAN = """
        SELECT event_id, user_id, lower(trim(event_type)) AS event_type, "timestamp", amount,
               upper(trim(region)) AS region
        FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp") AS rn FROM dirty_events)
        WHERE rn = 1 AND user_id IS NOT NULL AND "timestamp" IS NOT NULL AND amount >= 0"""


@query("P4 D1 P1 P2 P3 P6", using("dirty_events", c=_CLEAN) + f"""
    SELECT event_id, user_id, event_type, amount, region, {_TS}, '{DAY}' AS processing_date FROM c""")
def clean_app_events(e):
    return _text_ts(clean.clean_app_events(e.dirty_events(), DAY)).drop("processed_at")


@query("P6", using("app_events") + f"""
    SELECT event_id, '{DAY}' AS processing_date, 100.0::DOUBLE AS data_quality_score FROM app_events""")
def processing_metadata(e):
    stamped = clean.with_processing(e.app_events().drop("processing_date"), DAY, 100.0)
    return stamped.where(F.col("processed_at").isNotNull()).select("event_id", "processing_date", "data_quality_score")


@query("P5", using("changes") + """
    SELECT op, count(*) AS changes, count(DISTINCT key) AS keys FROM changes WHERE op IN ('c', 'u', 'd') GROUP BY op""")
def kept_changes(e):
    return clean.keep_changes(e.changes()).groupBy("op").agg(
        F.count("*").alias("changes"), F.countDistinct("key").alias("keys")
    )


@query("P7", """
    SELECT event_id, CAST(year(ts) AS INT) AS "year", CAST(month(ts) AS INT) AS "month",
           CAST(day(ts) AS INT) AS "day", CAST(hour(ts) AS INT) AS "hour" FROM events""")
def date_parts(e):
    return clean.with_date_parts(e.table("events"), "ts").select("event_id", "year", "month", "day", "hour")


def queue_records(e):
    """Events as they would arrive on the message queue, one topic per event type."""
    ev = e.table("events")
    topic = F.concat(F.lit("topic_"), F.col("event_type"), F.lit("_events"))
    row = F.struct(
        F.when(F.col("event_id") % 19 != 0, F.concat(F.lit("src_"), F.col("user_id") % 20)).alias("source_id"),
        F.lit("App events").alias("source_name"),
        ts_text("ts").alias("ingestion_timestamp"),
        F.when(
            F.col("event_id") % 31 != 0,
            F.struct("event_id", "user_id", "event_type", F.col("value").alias("amount")),
        ).alias("data"),
    )
    return ev.select(
        topic.alias("topic"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.to_json(row).cast("binary").alias("value"),
    )


@query("P8 ST2", """
    SELECT 'topic_' || event_type || '_events' AS kafka_topic, CAST(user_id % 3 AS INT) AS "partition",
           event_id AS "offset", CASE WHEN event_id % 19 <> 0 THEN 'src_' || (user_id % 20) END AS source_id,
           'App events' AS source_name, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ingestion_timestamp,
           CASE WHEN event_id % 31 <> 0 THEN event_id ELSE -1 END AS event_id,
           CASE WHEN event_id % 31 <> 0 THEN user_id ELSE -1 END AS user_id,
           CASE WHEN event_id % 31 <> 0 THEN value ELSE -1 END AS amount FROM events""")
def envelope_decode(e):
    decoded = envelope.typed(
        envelope.decode(queue_records(e)), {"event_id": "bigint", "user_id": "bigint", "amount": "double"}
    )
    return decoded.drop("raw_data", "kafka_timestamp", "message").na.fill(-1)


@query("Q12", """
    SELECT event_type || '_events' AS source_type, count(*) AS events,
           count(*) FILTER (WHERE event_id % 19 <> 0 AND event_id % 31 <> 0) AS valid,
           CAST(sum(CASE WHEN event_id % 19 <> 0 AND event_id % 31 <> 0 THEN 100 ELSE 0 END) AS BIGINT) AS score_sum
    FROM events GROUP BY event_type""")
def envelope_validity(e):
    rows = envelope.with_validity(envelope.decode(queue_records(e)))
    return rows.groupBy(envelope.source_type(F.col("kafka_topic")).alias("source_type")).agg(
        F.count("*").alias("events"),
        F.count(F.when(F.col("is_valid"), 1)).alias("valid"),
        F.sum("quality_score").alias("score_sum"),
    )


@query("P9", """
    SELECT event_type || '_events' AS source_type, strftime(ts, '%Y-%m-%d') AS ingestion_date,
           CAST(hour(ts) AS INT) AS ingestion_hour, count(*) AS events FROM events GROUP BY ALL""")
def bronze_partitions(e):
    rows = e.table("events").select(
        F.concat(F.lit("topic_"), F.col("event_type"), F.lit("_events")).alias("kafka_topic"), "ts"
    )
    parts = envelope.with_partitions(rows, "ts").withColumn("ingestion_date", day_text("ingestion_date"))
    return parts.groupBy("source_type", "ingestion_date", "ingestion_hour").agg(F.count("*").alias("events"))


SPECS = [
    {"type": "timestamp", "column": "timestamp", "target_column": "ingestion_date"},
    {"type": "lower", "column": "region"},
    {"type": "filter", "condition": "amount >= 10"},
    {"type": "round", "column": "amount", "places": 1},
]


@query("P10", using("app_events") + """
    SELECT event_id, lower(region) AS region, round(amount, 1) AS amount,
           strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS ingestion_date FROM app_events WHERE amount >= 10""")
def declared_transforms(e):
    out = clean.transform_by_spec(e.app_events(), SPECS)
    return out.select("event_id", "region", "amount", ts_text("ingestion_date").alias("ingestion_date"))


@query("P11", using("logs") + """
    SELECT level, service, count(*) AS count FROM logs WHERE level IN ('ERROR', 'WARN', 'INFO') GROUP BY ALL""")
def kept_log_levels(e):
    return clean.keep_log_levels(e.logs()).groupBy("level", "service").agg(F.count("*").alias("count"))


@query("P12", """
    SELECT c_custkey AS user_id, sha256('s1' || c_name) AS user_email, sha256('s1' || c_mktsegment) AS payment_info
    FROM customer""")
def masked_users(e):
    users = e.table("customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("user_email"),
        F.col("c_mktsegment").alias("payment_info"),
    )
    return clean.mask(users, ["user_email", "phone_number", "payment_info"], "s1")


@query("P13", using("positions") + """
    SELECT event_id, CAST(round(latitude / (100 / 111320)) AS BIGINT) AS lat_cell, round(round(longitude / w) * w, 6) AS longitude
    FROM (SELECT *, (100 / 111320) / greatest(cos(radians(round(latitude / (100 / 111320)) * (100 / 111320))), 0.001) AS w
          FROM positions)""")
def anonymous_positions(e):
    step = 100 / clean.METRES_PER_DEGREE
    snapped = clean.anonymise_position(e.positions())
    cell = F.round(F.col("latitude") / step).cast("bigint")
    return snapped.select("event_id", cell.alias("lat_cell"), F.round("longitude", 6).alias("longitude"))


@query("P14", using("clicks") + """
    SELECT event_id, session_id FROM clicks WHERE ('0x' || substr(md5(session_id), 1, 8))::BIGINT < 1073741824""")
def sampled_clicks(e):
    return clean.sample_by_key(e.clicks(), "session_id", 0.25).select("event_id", "session_id")


@query("P15", f"""
    SELECT CASE WHEN date_diff('day', o_orderdate::DATE, DATE '2001-01-01') > 730 THEN 'expired'
                WHEN date_diff('day', o_orderdate::DATE, DATE '2001-01-01') > 90 THEN 'archive' ELSE 'active' END AS state,
           count(*) AS bookings FROM orders GROUP BY ALL""")
def retention_states(e):
    state = clean.retention_state(F.col("created_at"), "2001-01-01", 90, 730)
    return e.bookings().groupBy(state.alias("state")).agg(F.count("*").alias("bookings"))


@query("P16", """
    SELECT c_custkey AS user_id, upper(trim(c_name)) AS name FROM customer
    WHERE c_custkey IS NOT NULL AND c_name IS NOT NULL""")
def users_cleaned(e):
    users = e.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return clean.clean_users(users, "user_id", "name")


@query("P17", using("bookings") + """
    SELECT booking_id, concat_ws(',',
               CASE WHEN amount IS NULL OR amount NOT BETWEEN 0 AND 400000 THEN 'amount_range' END,
               CASE WHEN status NOT IN ('F', 'O') THEN 'status' END,
               CASE WHEN created_at > TIMESTAMP '2001-01-01' THEN 'future' END,
               CASE WHEN u.user_id IS NULL THEN 'unknown_user' END) AS errors
    FROM bookings b LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON b.user_id = u.user_id""")
def bookings_validated(e):
    checked = clean.booking_errors(e.bookings(), e.table("events"), "2001-01-01", 400_000)
    return checked.select("booking_id", F.array_join("errors", ",").alias("errors"))


def click_documents(e):
    """Nested clickstream rows over the pages table."""
    null = lambda t: F.lit(None).cast(t)
    return e.table("pages").select(
        F.concat(F.lit("anon_"), F.lpad(F.col("page_id").cast("string"), 10, "0")).alias("anonymous_id"),
        F.when(F.col("page_id") % 3 != 0, F.col("page_id")).alias("user_id"),
        F.lit("Page Viewed").alias("event"),
        F.struct(
            F.col("url").alias("url"), null("string").alias("path"), null("string").alias("search"),
            F.length("html").cast("double").alias("duration"),
        ).alias("properties"),
        F.struct(
            F.lit("10.0.0.1").alias("ip"), F.lit("agent").alias("user_agent"),
            F.struct(F.lit(1280).alias("width"), F.lit(720).alias("height")).alias("screen"),
            F.struct(F.lit("feed").alias("source"), F.lit("spring").alias("name")).alias("campaign"),
        ).alias("context"),
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
    )


@query("P18", """
    SELECT coalesce(CASE WHEN page_id % 3 <> 0 THEN CAST(page_id AS VARCHAR) END,
                    'anon_' || lpad(CAST(page_id AS VARCHAR), 10, '0')) AS visitor,
           page_id % 3 = 0 AS is_anonymous, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
           regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
           nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS search, CAST(length(html) AS DOUBLE) AS duration,
           'feed' AS campaign_source FROM pages""")
def clicks_enriched(e):
    return clean.enrich_clicks(click_documents(e)).select(
        "visitor", "is_anonymous", "url", "host", "path", "search", "duration", "campaign_source"
    )


def external_records(e):
    """Events as external records: one JSON payload form per data type."""
    v = F.col("value")
    day = lambda n: F.struct(
        F.date_format(F.date_add("ts", n), "yyyy-MM-dd").alias("date"),
        (v - n).alias("temp_min"), (v + n).alias("temp_max"), F.lit(0.5).alias("precipitation"),
    )
    payload = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct(
            F.struct(v.alias("temp"), (F.col("user_id") % 100).alias("humidity")).alias("current"),
            F.array(day(1), day(2)).alias("forecast"))))
        .when(F.col("event_type") == "click", F.to_json(F.struct(
            F.concat(F.lit("p"), F.col("user_id")).alias("place_id"), (F.col("user_id") % 6).cast("double").alias("rating"))))
        .otherwise(F.to_json(F.struct(
            F.col("event_id").cast("string").alias("post_id"), F.lit("neutral").alias("sentiment"),
            F.struct((F.col("user_id") * 2).alias("likes")).alias("engagement"))))
    )
    return e.table("events").select(
        F.lit("feed").alias("source"),
        recode(F.col("event_type"), {"view": "weather", "click": "maps"}, F.lit("social")).alias("data_type"),
        F.struct(F.concat(F.lit("city-"), F.col("user_id") % 7).alias("city"), F.lit("VN").alias("country")).alias("location"),
        F.col("event_id").cast("string").alias("timestamp"),
        payload.alias("data"),
    )


@query("P19 P20", """
    SELECT "timestamp", 'city-' || (user_id % 7) AS city, value AS temp, CAST(user_id % 100 AS INT) AS humidity,
           strftime(ts + to_days(n), '%Y-%m-%d') AS forecast_date, value - n AS temp_min, value + n AS temp_max
    FROM (SELECT *, CAST(event_id AS VARCHAR) AS "timestamp", unnest([1, 2]) AS n FROM events WHERE event_type = 'view')""")
def weather_normalised(e):
    return clean.weather(external_records(e)).select(
        "timestamp", "city", "temp", "humidity", "forecast_date", "temp_min", "temp_max"
    )


@query("P20", """
    SELECT 'p' || user_id AS place_id, CAST(user_id % 6 AS DOUBLE) AS rating, count(*) AS sightings
    FROM events WHERE event_type = 'click' GROUP BY ALL""")
def places(e):
    rows = clean.external(external_records(e), "maps")
    return rows.groupBy("data.place_id", "data.rating").agg(F.count("*").alias("sightings"))


@query("P20", """
    SELECT CAST(event_id AS VARCHAR) AS post_id, 'neutral' AS sentiment, user_id * 2 AS likes FROM events
    WHERE event_type NOT IN ('view', 'click')""")
def social_posts(e):
    rows = clean.external(external_records(e), "social")
    return rows.select("data.post_id", "data.sentiment", "data.engagement.likes")


# --- searches and listings ---------------------------------------------------------------------


@query("P23 L1", using("logs") + """
    SELECT id, level, service, message, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM logs
    WHERE level = 'ERROR' AND service = 'svc-2' AND ts >= '2024-01-10' ORDER BY ts DESC LIMIT 100""")
def log_search(e):
    hits = clean.search_logs(e.logs(), "ERROR", "svc-2", "2024-01-10", 100)
    return _text_ts(hits.drop("response_time"), "ts")


@query("P24 L1", using("logs") + """
    SELECT id, level, message, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM logs WHERE service = 'svc-3'
    ORDER BY ts DESC""")
def newest_logs_of_service(e):
    return _text_ts(clean.newest_first(e.logs(), "ts", "id", service="svc-3"), "ts").select("id", "level", "message", "ts")


@query("P24", using("gauges") + f"""
    SELECT instance, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM gauges WHERE metric = 'memory_total'
    ORDER BY ts DESC""")
def newest_metric_samples(e):
    rows = clean.newest_first(e.gauges(), "ts", "instance", metric="memory_total")
    return _text_ts(rows, "ts").select("instance", "value", "ts")


@query("P24", """
    SELECT c_custkey AS id, c_name AS username, c_mktsegment AS role FROM customer
    WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 ORDER BY c_custkey""")
def active_users_of_role(e):
    users = e.table("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )
    return users.where((F.col("role") == "BUILDING") & F.col("is_active")).orderBy("id").drop("is_active")


@query("P24", using("lineage_nodes") + "SELECT id, name, type, parent_id FROM lineage_nodes WHERE type = 'silver' ORDER BY id")
def lineage_nodes_of_type(e):
    return e.lineage_nodes().where("type = 'silver'").orderBy("id")


@query("P25", using("logs") + """
    SELECT count(*) FILTER (WHERE service = 'svc-1' AND level = 'ERROR') AS service_errors,
           count(*) FILTER (WHERE response_time > 1000) AS slow,
           count(*) FILTER (WHERE message LIKE '%error%' AND service LIKE 'svc%') AS message_in_service FROM logs""")
def saved_search_counts(e):
    names = ["service_errors", "slow", "message_in_service"]
    return e.logs().agg(*[F.count(F.when(F.expr(clean.SAVED_SEARCHES[n]), 1)).alias(n) for n in names])


@query("P25", using("logs") + "SELECT id, response_time FROM logs WHERE response_time > 1000")
def slow_requests(e):
    return clean.saved_search(e.logs(), "slow").select("id", "response_time")


@query("P25", using("clicks") + f"""
    SELECT event_id, page_url FROM clicks WHERE device_type = 'mobile'
    AND "timestamp" >= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY AND "timestamp" < TIMESTAMP '2024-01-20'""")
def mobile_last_day(e):
    from strata.operators.serving import last_days

    recent = last_days(e.clicks(), "timestamp", "2024-01-20", 1)
    return recent.where("device_type = 'mobile'").select("event_id", "page_url")


# --- reads, routing, stacking ------------------------------------------------------------------


@query("S2 S4", """
    SELECT event_type, count(*) AS events FROM events WHERE ts >= '2024-01-12' AND ts < '2024-01-13' GROUP BY ALL""")
def one_day_of_events(e):
    from strata import schemas

    day = (F.col("ts") >= F.lit("2024-01-12").cast("timestamp_ntz")) & (
        F.col("ts") < F.lit("2024-01-13").cast("timestamp_ntz")
    )
    rows = bronze_partition(e.spark, f"{e.root}/events.parquet", schemas.TABLES["events"], day)
    return rows.groupBy("event_type").agg(F.count("*").alias("events"))


@query("S3", using("app_events") + """
    SELECT event_id, event_type, region FROM app_events WHERE processing_date = '2024-01-12'""")
def catalog_read(e):
    """A partitioned table is saved in the session catalog, then one of its days is read."""
    name = f"strata_events_{uuid.uuid4().hex}"
    rows = e.app_events().select("event_id", "event_type", "region", "processing_date")
    rows.write.partitionBy("processing_date").option("path", f"{shared_dir(e.spark)}/{name}").saveAsTable(name)
    return catalog_table(e.spark, name, "2024-01-12").drop("processing_date")


@query("S7", """
    SELECT o_orderstatus AS source, count(*) AS new_rows, strftime(max(o_orderdate), '%Y-%m-%d') AS watermark
    FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01' GROUP BY ALL""")
def incremental_orders(e):
    new = incremental.newer_than(e.table("orders"), "o_orderdate", "2000-01-01")
    marks = incremental.high_water_mark(new, "o_orderdate", F.col("o_orderstatus").alias("source"))
    return marks.withColumn("watermark", day_text("watermark"))


@query("K6", using("app_events") + """
    SELECT CASE WHEN event_type = 'booking' THEN 'topic_booking_events' ELSE 'topic_user_events' END AS topic,
           event_type, count(*) AS events FROM app_events GROUP BY ALL""")
def event_routing(e):
    topic = envelope.event_topic(F.col("event_type")).alias("topic")
    return e.app_events().groupBy(topic, "event_type").agg(F.count("*").alias("events"))


@query("K8", using("app_events") + """
    SELECT 'analytics:' || region || ':' || processing_date AS key,
           '{"events":' || count(*) || ',"users":' || count(DISTINCT user_id) || '}' AS value,
           '2024-02-01 01:00:00' AS expires_at FROM app_events GROUP BY region, processing_date""")
def cache_rows(e):
    from strata.sinks.files import cache_entries

    totals = e.app_events().groupBy("region", "processing_date").agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("users")
    )
    rows = cache_entries(totals, "region", "processing_date", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return rows.withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"))


@query("U1", using("app_events", "tour_events", "clicks") + """
    SELECT origin, count(*) AS rows, count(amount) AS with_amount, count(tour_id) AS with_tour, count(page_url) AS with_page
    FROM (SELECT 'app' AS origin, amount, NULL AS tour_id, NULL AS page_url FROM app_events
          UNION ALL SELECT 'tour', amount, tour_id, NULL FROM tour_events
          UNION ALL SELECT 'click', NULL, NULL, page_url FROM clicks) GROUP BY origin""")
def stacked_sources(e):
    name = lambda df, origin: df.withColumn("origin", F.lit(origin))
    rows = enrich.stack(
        name(e.app_events(), "app"), name(e.tour_events(), "tour"), name(e.clicks(), "click")
    )
    return rows.groupBy("origin").agg(
        F.count("*").alias("rows"), F.count("amount").alias("with_amount"),
        F.count("tour_id").alias("with_tour"), F.count("page_url").alias("with_page"),
    )


# --- duplicates --------------------------------------------------------------------------------


@query("D1", using("dirty_events") + f"""
    SELECT event_id, coalesce(user_id, -1) AS user_id, event_type, amount, region, {_TS} FROM
      (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp") AS rn FROM dirty_events) WHERE rn = 1""")
def dedup_by_key(e):
    return _text_ts(dedup.keep_first(e.dirty_events(), ["event_id"], ["timestamp"])).na.fill(-1)


@query("D2", using("dirty_events") + f"SELECT DISTINCT event_id, coalesce(user_id, -1) AS user_id, event_type, amount, region, {_TS} FROM dirty_events")
def dedup_whole_rows(e):
    return _text_ts(dedup.distinct_rows(e.dirty_events())).na.fill(-1)


@query("D2", "SELECT lang, count(DISTINCT text) AS texts, count(*) AS documents FROM documents GROUP BY lang")
def distinct_texts(e):
    docs = e.table("documents")
    # a digest stands for the whole text, so 64 characters per row are shuffled instead of it
    copies = docs.groupBy("lang", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"))
    return copies.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("copies").alias("documents"))


@query("D3", using("clicks") + """
    SELECT session_id, page_url, count(DISTINCT "timestamp") AS kept FROM clicks GROUP BY session_id, page_url""")
def dedup_by_source(e):
    kept = dedup.by_source(e.clicks(), "clickstream", ["event_id"])
    return kept.groupBy("session_id", "page_url").agg(F.count("*").alias("kept"))


def _dedup_window_sql(seconds: int) -> str:
    return f"""
    SELECT event_id, user_id, event_type FROM (
      SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > {seconds}000000"""


@query("D4", _dedup_window_sql(3600))
def dedup_within_hour(e):
    kept = dedup.outside_window(e.table("events"), ["user_id"], "ts", 3600, "event_id")
    return kept.select("event_id", "user_id", "event_type")


@query("D4", _dedup_window_sql(60))
def dedup_within_minute(e):
    kept = dedup.outside_window(e.table("events"), ["user_id"], "ts", 60, "event_id")
    return kept.select("event_id", "user_id", "event_type")


@query("D5", using("tours") + """
    SELECT name AS id, price BETWEEN 0 AND 1000 AND rating BETWEEN 0 AND 4.5 AS accepted,
           concat_ws(',', CASE WHEN price NOT BETWEEN 0 AND 1000 THEN 'price' END,
               CASE WHEN rating NOT BETWEEN 0 AND 4.5 THEN 'rating' END) AS rejected_for
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tour_id) AS rn FROM tours) WHERE rn = 1""")
def first_valid_tours(e):
    rules = {"price": F.col("price").between(0, 1000), "rating": F.col("rating").between(0, 4.5)}
    rows = dedup.keep_valid(e.tours(), "name", ["tour_id"], rules)
    return rows.select(
        F.col("name").alias("id"), (F.size("rejected_for") == 0).alias("accepted"),
        F.array_join("rejected_for", ",").alias("rejected_for"),
    )


# --- joins and change data ---------------------------------------------------------------------


@query("J3", """
    SELECT event_id, user_id, c_name AS user_name, c_mktsegment AS segment, n_name AS country FROM events
    LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def events_with_profile(e):
    profile = enrich.with_dimension(
        e.table("events"), e.table("customer"), "user_id", "c_custkey"
    )
    return enrich.with_dimension(profile, e.table("nation"), "c_nationkey", "n_nationkey").select(
        "event_id", "user_id", F.col("c_name").alias("user_name"), F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("country"),
    )


_BOOKED = """SELECT DISTINCT user_id, region FROM tour_events WHERE event_type = 'booking'"""


@query("J4", using("tour_events", r=_BOOKED) + """
    SELECT DISTINCT user_id, tour_id, region FROM tour_events t WHERE event_type = 'click'
    AND EXISTS (SELECT 1 FROM r WHERE r.user_id = t.user_id AND r.region = t.region)""")
def clicked_in_booked_regions(e):
    clicked = e.tour_events("click").select("user_id", "tour_id", "region").distinct()
    return enrich.in_user_regions(clicked, e.tour_events("booking"))


@query("J5 Q13", using("data_sources", "source_executions") + """
    SELECT e.source_id, count(*) AS orphans FROM source_executions e
    WHERE NOT EXISTS (SELECT 1 FROM data_sources d WHERE d.is_enabled AND d.source_id = e.source_id) GROUP BY ALL""")
def orphan_executions(e):
    sources = e.data_sources().where("is_enabled")
    lost = enrich.orphans(e.source_executions(), "source_id", sources, "source_id")
    return lost.groupBy("source_id").agg(F.count("*").alias("orphans"))


@query("J5", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def documents_without_label(e):
    return enrich.orphans(e.table("documents").select("doc_id"), "doc_id", e.table("labels"), "doc_id")


@query("J6", using("dirty_events") + """
    SELECT 'invalid' AS part, count(*) AS rows FROM dirty_events WHERE user_id IS NULL
    UNION ALL SELECT 'valid', count(*) FROM dirty_events WHERE user_id IS NOT NULL""")
def valid_invalid_split(e):
    valid, invalid = clean.split(e.dirty_events(), F.col("user_id").isNotNull())
    size = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
    return size(valid, "valid").unionByName(size(invalid, "invalid"))


_LATEST = """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, "offset" DESC) AS rn
                       FROM changes WHERE op IN ('c', 'u', 'd')) WHERE rn = 1"""


@query("J7", using("changes", l=_LATEST) + """
    SELECT coalesce(c_custkey, l.key) AS key, CASE WHEN l.op IS NULL THEN c_acctbal ELSE l.balance END AS balance
    FROM customer FULL JOIN l ON c_custkey = l.key WHERE l.op IS NULL OR l.op <> 'd'""")
def apply_changes(e):
    base = e.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return cdc.apply_changes(base, e.changes(), "key", ["balance"])


@query("W7", using("changes", l=_LATEST.replace("WHERE op IN ('c', 'u', 'd')", "")) + """
    SELECT key, op, ts_ms, "offset", balance FROM l""")
def latest_changes(e):
    return cdc.latest(e.changes(), ["key"])
