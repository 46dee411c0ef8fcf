"""Rankings, sessions and journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.columns import ts_text
from strata.operators import serving, windows
from strata.queries import query
from strata.queries.entity_sql import using


@query("W1", """
    SELECT event_type, rank, event_id FROM (SELECT event_type, event_id,
        CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events)
    WHERE rank <= 1000""")
def recent_events_per_type(e):
    top = windows.top_per_key(e.table("events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 1000)
    return top.select("event_type", "rank", "event_id")


@query("W1", """
    SELECT event_type, rank, event_id FROM (SELECT event_type, event_id,
        CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events)
    WHERE rank <= 1500""")
def recent_events_per_type_long(e):
    top = windows.top_per_key(e.table("events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 1500)
    return top.select("event_type", "rank", "event_id")


@query("W2", using("tour_events", s="""
        SELECT user_id, round(sum(amount), 2) AS score FROM tour_events GROUP BY user_id ORDER BY score DESC, user_id LIMIT 10""") + """
    SELECT user_id, score, CAST(row_number() OVER (ORDER BY score DESC, user_id) AS INT) AS rank FROM s""")
def leaderboard(e):
    return windows.leaderboard(e.tour_events(), "user_id", F.round(F.sum("amount"), 2))


@query("W4", using("clicks") + """
    SELECT page_url AS landing_page, count(*) AS sessions FROM (SELECT *, row_number() OVER (
        PARTITION BY session_id ORDER BY "timestamp", event_id) AS rn FROM clicks) WHERE rn = 1 GROUP BY ALL""")
def landing_pages(e):
    return windows.landing_pages(e.clicks())


@query("W5", using("clicks") + """
    SELECT from_step, to_step, count(*) AS count FROM (SELECT category AS from_step,
        lead(category) OVER (PARTITION BY session_id ORDER BY "timestamp", event_id) AS to_step FROM clicks)
    WHERE to_step IS NOT NULL GROUP BY ALL""")
def journey_edges(e):
    return windows.journey_edges(e.clicks())


_SESSIONS = """
    WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 OR lag(ts) OVER w IS NULL
                         THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM f),
    s AS (SELECT user_id, session_no, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM n GROUP BY ALL)"""


@query("W8", _SESSIONS + """
    SELECT user_id, session_no, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
           strftime(ended_at, '%Y-%m-%d %H:%M:%S.%f') AS ended_at, events FROM s""")
def sessions(e):
    found = windows.sessions(e.table("events"), "user_id", "ts")
    return found.withColumns({c: ts_text(c) for c in ("started_at", "ended_at")}).drop("duration_seconds")


@query("W8", _SESSIONS + "SELECT event_id, user_id, session_no FROM n")
def events_with_session(e):
    return windows.with_session(e.table("events"), "user_id", "ts").select("event_id", "user_id", "session_no")


@query("A25", _SESSIONS + """
    SELECT floor((epoch_us(ended_at) - epoch_us(started_at)) / 1000000 / 600) * 600 AS bucket, count(*) AS count FROM s GROUP BY ALL""")
def session_duration_histogram(e):
    found = windows.sessions(e.table("events"), "user_id", "ts")
    return serving.histogram(found, F.col("duration_seconds"), 600).withColumn("bucket", F.col("bucket").cast("double"))
