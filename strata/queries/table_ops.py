"""Update and delete as new versions of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import tableops
from strata.queries import query
from strata.queries.entity_sql import using


@query("T2", using("tours") + """
    SELECT tour_id, region, CASE WHEN region = 'ASIA' THEN price + 100 ELSE price END AS price FROM tours""")
def update_rows(e):
    raised = tableops.update(e.tours(), F.col("region") == "ASIA", {"price": F.col("price") + 100})
    return raised.select("tour_id", "region", "price")


@query("T3", using("dirty_events") + "SELECT event_id, coalesce(user_id, -1) AS user_id, amount FROM dirty_events WHERE NOT (user_id < 75) OR user_id IS NULL")
def delete_rows(e):
    return tableops.delete(e.dirty_events(), F.col("user_id") < 75).select("event_id", "user_id", "amount").na.fill(-1)
