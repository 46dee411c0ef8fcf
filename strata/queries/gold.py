"""Gold tables over app events (users keep one region) and tour events (users roam)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.columns import day_text, ts_text
from strata.operators import gold
from strata.queries import query
from strata.queries.entity_sql import using

AS_OF = "2024-01-25"
TOUR_AS_OF = "2000-06-30"
EVENT_TYPES = ["booking", "click", "error", "search", "signup"]


def _user_360_sql(view: str, as_of: str) -> str:
    return using(view, v=f"""
        SELECT user_id, string_agg(region || '=' || n, ',' ORDER BY region) AS visited_regions
        FROM (SELECT user_id, region, count(*) AS n FROM {view} WHERE processing_date <= '{as_of}' GROUP BY ALL)
        GROUP BY user_id""") + f"""
    SELECT e.user_id, count(*) AS total_events,
           count(*) FILTER (WHERE event_type = 'click') AS total_clicks,
           count(*) FILTER (WHERE event_type = 'booking') AS total_bookings,
           count(*) FILTER (WHERE event_type = 'search') AS total_searches,
           round(sum(coalesce(amount, 0)), 2) AS total_spent,
           round(sum(coalesce(amount, 0)), 2) / count(*) AS avg_transaction_value, any_value(visited_regions) AS visited_regions,
           strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS last_activity_date,
           strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS first_activity_date,
           '{as_of}' AS processing_date
    FROM {view} e JOIN v ON e.user_id = v.user_id WHERE e.processing_date <= '{as_of}' GROUP BY e.user_id"""


def _before_end(events, as_of):
    """Up to the day by the event's own time, a filter that reaches the scan."""
    return events.where(F.col("timestamp") < F.lit(as_of).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))


def _user_360(events, as_of):
    text = F.transform("visited_regions", lambda v: F.concat(v.region, F.lit("="), v.visits))
    return gold.user_360(gold.each_event(_before_end(events, as_of)), as_of).select(
        "user_id", "total_events", "total_clicks", "total_bookings", "total_searches",
        "total_spent", "avg_transaction_value",
        F.array_join(text, ",").alias("visited_regions"),
        ts_text("last_activity_date").alias("last_activity_date"),
        ts_text("first_activity_date").alias("first_activity_date"),
        "processing_date",
    )


@query("A1", _user_360_sql("app_events", AS_OF))
def user_360(e):
    return _user_360(e.app_events(), AS_OF)


@query("A1", _user_360_sql("tour_events", TOUR_AS_OF))
def user_360_travellers(e):
    return _user_360(e.tour_events(), TOUR_AS_OF)


def _to_date(sql: str, view: str, as_of: str) -> str:
    """The SQL with the last day of the view for the fixed one."""
    last = f"(SELECT max(processing_date) FROM {view})"
    return sql.replace(f"DATE '{as_of}'", f"CAST({last} AS DATE)").replace(f"'{as_of}'", last)


def _last_day(events):
    return events.agg(F.max("processing_date").cast("string")).first()[0]


@query("A1", _to_date(_user_360_sql("app_events", AS_OF), "app_events", AS_OF))
def user_360_to_date(e):
    return _user_360(e.app_events(), _last_day(e.app_events()))


@query("A1", _to_date(_user_360_sql("tour_events", TOUR_AS_OF), "tour_events", TOUR_AS_OF))
def user_360_travellers_to_date(e):
    return _user_360(e.tour_events(), _last_day(e.tour_events()))


@query("A2", using("app_events") + """
    SELECT region, processing_date, count(*) AS total_bookings, round(sum(coalesce(amount, 0)), 2) AS total_revenue,
           round(sum(coalesce(amount, 0)), 2) / count(*) AS avg_booking_value, max(amount) AS max_booking_value,
           min(amount) AS min_booking_value, count(DISTINCT user_id) AS unique_users, count(user_id) AS user_events
    FROM app_events WHERE event_type = 'booking' GROUP BY region, processing_date""")
def booking_metrics(e):
    return gold.booking_metrics(gold.activity(e.app_events())).select(
        "region", "processing_date", "total_bookings", "total_revenue", "avg_booking_value", "max_booking_value", "min_booking_value",
        "unique_users", "user_events",
    )


@query("A3", using("app_events") + """
    SELECT region, event_type, processing_date, count(*) AS event_count, count(DISTINCT user_id) AS unique_users,
           count(user_id) AS user_events
    FROM app_events GROUP BY region, event_type, processing_date""")
def tourism_analytics(e):
    return gold.tourism_analytics(gold.activity(e.app_events()))


PIVOTED = [t for t in EVENT_TYPES if t != "signup"]


@query("A4", using("app_events") + "SELECT region, processing_date, " + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in PIVOTED
) + f", count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN {tuple(PIVOTED)}) AS other FROM app_events GROUP BY region, processing_date")
def tourism_pivot(e):
    return gold.tourism_pivot(gold.activity(e.app_events()), PIVOTED)


_FEATURES_SQL = using("tour_events") + f"""
    SELECT user_id, count(*) AS total_interactions,
           count(*) FILTER (WHERE event_type = 'click') AS clicks,
           count(*) FILTER (WHERE event_type = 'booking') AS bookings,
           count(*) FILTER (WHERE event_type = 'search') AS searches,
           round(sum(coalesce(amount, 0)), 2) AS total_spend, round(sum(coalesce(amount, 0)), 2) / count(*) AS avg_spend,
           count(DISTINCT region) AS region_diversity, count(region) AS region_events,
           date_diff('day', max("timestamp")::DATE, DATE '{TOUR_AS_OF}') AS days_since_last_activity,
           round(count(*) FILTER (WHERE event_type = 'booking') / count(*), 6) AS conversion_rate,
           '{TOUR_AS_OF}' AS processing_date
    FROM tour_events WHERE processing_date <= '{TOUR_AS_OF}' GROUP BY user_id"""


def _features(events, as_of):
    f = gold.recommendation_features(gold.each_event(_before_end(events, as_of)), as_of)
    return f.select(
        "user_id", "total_interactions", "clicks", "bookings", "searches",
        "total_spend", "avg_spend",
        "region_diversity", "region_events",
        F.col("days_since_last_activity").cast("bigint").alias("days_since_last_activity"),
        F.round("conversion_rate", 6).alias("conversion_rate"), "processing_date",
    )


@query("A5", _FEATURES_SQL)
def recommendation_features(e):
    return _features(e.tour_events(), TOUR_AS_OF)


@query("A5", _to_date(_FEATURES_SQL, "tour_events", TOUR_AS_OF))
def recommendation_features_to_date(e):
    return _features(e.tour_events(), _last_day(e.tour_events()))


@query("A6", using("app_events") + """
    SELECT processing_date, count(*) AS total_events, count(DISTINCT user_id) AS unique_users,
           count(*) FILTER (WHERE event_type = 'booking') AS bookings, round(sum(coalesce(amount, 0)), 2) AS revenue,
           count(DISTINCT region) AS regions_active
    FROM app_events GROUP BY processing_date""")
def daily_summary(e):
    return gold.daily_summary(gold.activity(e.app_events()))


@query("A7", using("app_events") + """
    SELECT strftime("timestamp", '%Y-%m-%d') AS event_date, region, event_type, count(*) AS event_count,
           round(sum(amount), 2) AS total_amount, round(sum(amount), 2) / count(amount) AS avg_amount, max(amount) AS max_amount
    FROM app_events GROUP BY ALL""")
def daily_event_summary(e):
    return gold.daily_event_summary(e.app_events()).select(
        day_text("event_date").alias("event_date"), "region", "event_type", "event_count",
        "total_amount", "avg_amount", "max_amount",
    )


@query("A15", using("app_events", m="""
        SELECT processing_date AS metric_date, region, count(*) AS total_bookings, round(sum(amount), 2) AS total_revenue,
               round(sum(amount), 2) / count(*) AS avg_booking_value, count(DISTINCT user_id) AS unique_users
        FROM app_events WHERE event_type = 'booking' GROUP BY ALL""") + """
    SELECT metric_date, region, total_bookings, total_revenue, avg_booking_value, unique_users,
           CASE WHEN count(total_revenue) OVER w >= 3
                 AND abs(total_revenue - avg(total_revenue) OVER w) > 2 * stddev_samp(total_revenue) OVER w
                THEN 1 ELSE 0 END AS anomaly_flag
    FROM m WINDOW w AS (PARTITION BY region ORDER BY metric_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def regional_metrics(e):
    return gold.regional_metrics(gold.activity(e.app_events()))


@query("A31", using("dirty_events", c="""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp") AS rn FROM dirty_events)
        WHERE rn = 1 AND user_id IS NOT NULL AND "timestamp" IS NOT NULL AND amount >= 0""") + """
    SELECT b AS records_before, a AS records_after, b - a AS records_filtered, round(a * 100.0 / b, 4) AS quality_rate
    FROM (SELECT (SELECT count(*) FROM dirty_events) AS b, (SELECT count(*) FROM c) AS a)""")
def layer_reconciliation(e):
    valid = F.col("user_id").isNotNull() & F.col("timestamp").isNotNull() & (F.col("amount") >= 0)
    return gold.reconcile(e.dirty_events(), "event_id", valid).withColumn(
        "quality_rate", F.round("quality_rate", 4)
    )
