"""Serving statistics, dashboards and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.columns import day_text
from strata.operators import serving
from strata.queries import query
from strata.queries.entity_sql import using

AS_OF = "2000-01-01"


@query("A8", using("app_events", s="""
        SELECT region, count(*) FILTER (WHERE event_type = 'booking') AS total_bookings,
               coalesce(round(sum(amount) FILTER (WHERE event_type = 'booking'), 2), 0) AS total_revenue,
               count(DISTINCT user_id) AS unique_users, count(*) AS n
        FROM app_events WHERE "timestamp" >= '2024-01-05' AND "timestamp" < '2024-01-21' GROUP BY region""") + """
    SELECT region, total_bookings, total_revenue, unique_users,
           CASE WHEN total_bookings > 0 THEN total_revenue / total_bookings ELSE 0 END AS avg_booking_value,
           CASE WHEN n > 0 THEN total_bookings / n * 100 ELSE 0 END AS conversion_rate FROM s""")
def regional_stats(e):
    return serving.regional_stats(e.app_events(), date_from="2024-01-05", date_to="2024-01-20")


@query("A9 J2", using("tours", "tour_events", t="""
        SELECT tour_id, count(*) AS views, count(*) FILTER (WHERE event_type = 'view') AS view_events,
               count(*) FILTER (WHERE event_type = 'booking') AS bookings,
               coalesce(round(sum(amount) FILTER (WHERE event_type = 'booking'), 2), 0) AS revenue
        FROM tour_events GROUP BY tour_id""") + """
    SELECT tours.tour_id, name, region, coalesce(views, 0) AS views, coalesce(view_events, 0) AS view_events,
           coalesce(bookings, 0) AS bookings, coalesce(revenue, 0) AS revenue,
           CASE WHEN views > 0 THEN bookings / views * 100 ELSE 0 END AS conversion_rate, rating AS avg_rating
    FROM tours LEFT JOIN t ON tours.tour_id = t.tour_id""")
def tour_performance(e):
    return serving.tour_performance(e.tours(), e.tour_events())


@query("A10", using("tours", "tour_events") + """
    SELECT (SELECT count(*) FROM tours) AS total_tours, (SELECT count(*) FROM tour_events) AS total_events,
           (SELECT string_agg(region, ',' ORDER BY region) FROM (SELECT DISTINCT region FROM tours)) AS regions,
           (SELECT count(DISTINCT region) FROM tours) AS regions_count,
           (SELECT round(sum(price), 2) / count(*) FROM tours) AS avg_tour_price,
           (SELECT round(sum(rating), 4) / count(*) FROM tours) AS avg_tour_rating""")
def platform_metrics(e):
    return serving.platform_metrics(e.tours(), e.tour_events()).withColumn(
        "regions", F.array_join("regions", ",")
    )


@query("P21 L2", using("tours") + """
    SELECT tour_id, name, region, price, rating, array_to_string(tags, ',') AS tags
    FROM tours WHERE region = 'ASIA' AND price BETWEEN 900 AND 1500 ORDER BY tour_id LIMIT 100 OFFSET 20""")
def tour_page(e):
    page = serving.list_tours(e.tours(), "asia", 900, 1500, limit=100, skip=20)
    return page.select("tour_id", "name", "region", "price", "rating", F.array_join("tags", ",").alias("tags"))


@query("P21", using("tours") + "SELECT tour_id, name, region, price, rating FROM tours WHERE tour_id = 42")
def tour_by_id(e):
    return serving.tour_by_id(e.tours(), 42).select("tour_id", "name", "region", "price", "rating")


_RECENT = f"\"timestamp\" >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND \"timestamp\" < TIMESTAMP '{AS_OF}'"


@query("A16", using("tour_events") + f"""
    SELECT region, count(*) AS booking_count, round(sum(amount), 2) / count(*) AS avg_price
    FROM tour_events WHERE event_type = 'booking' AND {_RECENT} GROUP BY region ORDER BY booking_count DESC, region""")
def bookings_by_region(e):
    return serving.bookings_by_region(e.tour_events("booking"), AS_OF)


@query("A17", using("tour_events") + f"""
    SELECT round(sum(amount), 2) AS revenue FROM tour_events WHERE event_type = 'booking' AND {_RECENT}""")
def revenue_last_month(e):
    return serving.revenue(e.tour_events("booking"), AS_OF)


@query("A18", using("tours", "tour_events") + """
    SELECT name AS destination, count(*) AS bookings, round(sum(rating), 4) / count(*) AS avg_rating
    FROM tour_events JOIN tours ON tour_events.tour_id = tours.tour_id WHERE event_type = 'booking'
    GROUP BY name ORDER BY bookings DESC, destination LIMIT 10""")
def top_destinations(e):
    return serving.top_destinations(e.tours(), e.tour_events())


_MONTHS = dict(m="""
        SELECT user_id, strftime("timestamp", '%Y-%m') AS "month",
               max(CASE WHEN event_type = 'booking' THEN 1 ELSE 0 END) AS booked
        FROM tour_events GROUP BY ALL""",
    u="""SELECT *, min("month") OVER (PARTITION BY user_id) AS cohort_month FROM m""")
_OFFSET = """((CAST(substr("month", 1, 4) AS INT) * 12 + CAST(substr("month", 6, 2) AS INT))
             - (CAST(substr(cohort_month, 1, 4) AS INT) * 12 + CAST(substr(cohort_month, 6, 2) AS INT)))"""


@query("A19", using("tour_events", **_MONTHS, c=f"""
        SELECT cohort_month, {_OFFSET} AS month_offset, count(*) AS active_users FROM u GROUP BY ALL""") + """
    SELECT *, max(CASE WHEN month_offset = 0 THEN active_users END) OVER (PARTITION BY cohort_month) AS cohort_size,
           active_users / max(CASE WHEN month_offset = 0 THEN active_users END) OVER (PARTITION BY cohort_month) * 100
               AS retention_rate FROM c""")
def cohort_retention(e):
    return serving.cohort_retention(e.tour_events())


@query("A27", using("tour_events", **_MONTHS, g="""
        SELECT "month", count(*) AS active_users, count(*) FILTER (WHERE "month" = cohort_month) AS new_users,
               sum(booked) AS engaged FROM u GROUP BY ALL""") + """
    SELECT "month", active_users, new_users,
           CAST(sum(new_users) OVER (ORDER BY "month" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_users,
           engaged / active_users * 100 AS engagement_rate FROM g""")
def user_growth(e):
    return serving.user_growth(e.tour_events())


@query("A20", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS events FROM events
    GROUP BY ALL ORDER BY day DESC LIMIT 10""")
def events_per_day(e):
    return serving.daily_counts(e.table("events"), "ts", 10).select(day_text("day").alias("day"), "events")


@query("A28", using("tour_events") + """
    SELECT strftime("timestamp", '%Y-%m-%d') AS day, round(sum(amount), 2) AS revenue
    FROM tour_events WHERE event_type = 'booking' GROUP BY ALL""")
def revenue_trend(e):
    return serving.revenue_trend(e.tour_events("booking")).withColumn("day", day_text("day"))


@query("A21 W2", using("clicks") + """
    SELECT page_url, count(*) AS count FROM clicks GROUP BY ALL ORDER BY count DESC, page_url LIMIT 10""")
def popular_pages(e):
    return serving.terms(e.clicks(), "page_url", size=10)


@query("A22", using("clicks", h="""
        SELECT date_trunc('hour', "timestamp") AS hour, count(*) AS n FROM clicks GROUP BY ALL""") + """
    SELECT strftime(s.hour, '%Y-%m-%d %H:00') AS hour, coalesce(n, 0) AS events
    FROM (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour) s
    LEFT JOIN h ON s.hour = h.hour""")
def events_over_time(e):
    filled = serving.zero_filled_hours(serving.hourly_counts(e.clicks(), "timestamp"))
    return filled.select(F.date_format("hour", "yyyy-MM-dd HH:00").alias("hour"), "events")


@query("A23", using("logs") + """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*) AS events,
           count(*) FILTER (WHERE level = 'ERROR') AS error_count FROM logs GROUP BY ALL""")
def hourly_errors(e):
    hours = serving.hourly_counts(e.logs(), "ts", error_count=F.col("level") == "ERROR")
    return hours.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:00"))


@query("A24", using("logs") + "SELECT service, level, count(*) AS count FROM logs GROUP BY ALL")
def log_levels_by_service(e):
    return serving.terms(e.logs(), "service", "level")


@query("A24", using("logs") + """
    SELECT message, count(*) AS count FROM logs WHERE level = 'ERROR' GROUP BY ALL ORDER BY count DESC, message LIMIT 10""")
def top_error_messages(e):
    return serving.terms(e.logs().where("level = 'ERROR'"), "message", size=10)


@query("A25", using("logs") + """
    SELECT floor(response_time / 250) * 250 AS bucket, count(*) AS count FROM logs GROUP BY ALL""")
def response_time_histogram(e):
    return serving.histogram(e.logs(), F.col("response_time"), 250).withColumn("bucket", F.col("bucket").cast("double"))


@query("A25", using("tours") + "SELECT floor(rating / 0.5) * 0.5 AS bucket, count(*) AS count FROM tours GROUP BY ALL")
def rating_histogram(e):
    return serving.histogram(e.tours(), F.col("rating"), 0.5)


@query("A26", using("tours", c="SELECT category, count(*) AS count FROM tours GROUP BY ALL") + """
    SELECT category, count, count / sum(count) OVER () * 100 AS share FROM c""")
def category_share(e):
    return serving.share(e.tours(), "category")


@query("A26", using("clicks", c="SELECT device_type, count(*) AS count FROM clicks GROUP BY ALL") + """
    SELECT device_type, count, count / sum(count) OVER () * 100 AS share FROM c""")
def device_share(e):
    return serving.share(e.clicks(), "device_type")


@query("A32", using("app_events") + "SELECT country, region, count(*) AS count FROM app_events GROUP BY ALL")
def events_by_country(e):
    return serving.terms(e.app_events(), "country", "region")


@query("A32", using("positions") + """
    SELECT CAST(round(latitude / 7.5) AS BIGINT) AS lat_cell, CAST(round(longitude / 7.5) AS BIGINT) AS lon_cell,
           count(*) AS count FROM positions GROUP BY ALL""")
def events_by_cell(e):
    cell = lambda c: F.round(F.col(c) / 7.5).cast("bigint")
    cells = e.positions().select(cell("latitude").alias("lat_cell"), cell("longitude").alias("lon_cell"))
    return serving.terms(cells, "lat_cell", "lon_cell")


@query("A33", using("pipeline_runs") + """
    SELECT (SELECT count(*) FROM events) AS total_events, count(DISTINCT dag_id) AS active_pipelines,
           count(*) FILTER (WHERE status = 'FAILED') AS processing_errors,
           100 - count(*) FILTER (WHERE status = 'FAILED') / count(*) * 100 AS health FROM pipeline_runs""")
def kpi_tiles(e):
    return serving.kpi_tiles(e.table("events"), e.pipeline_runs())


@query("W6", using("tour_events", r="""
        SELECT strftime("timestamp", '%Y-%m') AS "month", round(sum(amount), 2) AS revenue
        FROM tour_events WHERE event_type = 'booking' GROUP BY ALL""") + """
    SELECT "month", revenue, coalesce(lag(revenue) OVER (ORDER BY "month"), 0) AS previous,
           coalesce((revenue - lag(revenue) OVER (ORDER BY "month")) / lag(revenue) OVER (ORDER BY "month") * 100, 0) AS change_percent
    FROM r""")
def revenue_change(e):
    booked = e.tour_events("booking")
    monthly = booked.groupBy(F.trunc("timestamp", "month").alias("m")).agg(
        F.round(F.sum("amount"), 2).alias("revenue")
    )
    monthly = monthly.select(F.date_format("m", "yyyy-MM").alias("month"), "revenue")
    return serving.change_over_period(monthly, "month", "revenue").na.fill(0.0)
