"""Gold tables.

All five tables come from one roll-up of silver, ``activity``, at the grain (processing_date,
user, region, event type).  Raw events are shuffled once, after map-side partial aggregation, so
a hot user or region never lands in one task as raw rows; everything later works on the much
smaller roll-up, which can be kept per day and re-used for the tables that span all days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import count_of, money, ratio, sum_of
from strata.operators.dedup import order_value


def activity(silver: DataFrame) -> DataFrame:
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    return silver.groupBy("processing_date", "user_id", "region", "event_type").agg(
        F.count("*").alias("events"),
        F.sum(amount).alias("amount_sum"),
        F.max(amount).alias("amount_max"),
        F.min(amount).alias("amount_min"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def each_event(silver: DataFrame) -> DataFrame:
    """Silver rows in the roll-up's columns without any aggregation, for a per-user table that is
    built once from raw rows and needs no shuffle by day."""
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    return silver.select(
        "processing_date",
        "user_id",
        "region",
        "event_type",
        F.lit(1).cast("bigint").alias("events"),
        amount.alias("amount_sum"),
        F.col("timestamp").alias("first_ts"),
        F.col("timestamp").alias("last_ts"),
    )


def _events_of(event_type: str):
    return sum_of(F.col("event_type") == event_type, "events")


def carried(total: DataFrame, days: DataFrame) -> DataFrame:
    """A total over all days, one row per (user, region, event type), with further days of the roll-up added.  Every
    measure adds up or is a minimum or maximum, so the history is never read again."""
    columns = [c for c in total.columns if c != "processing_date"]
    both = total.select(*columns).unionByName(days.select(*columns))
    return both.groupBy("user_id", "region", "event_type").agg(
        F.sum("events").alias("events"),
        F.sum("amount_sum").alias("amount_sum"),
        F.max("amount_max").alias("amount_max"),
        F.min("amount_min").alias("amount_min"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def until(rollup: DataFrame, as_of: str) -> DataFrame:
    """All days up to ``as_of``: the scope of the per-user tables."""
    return rollup.where(F.col("processing_date") <= as_of)


def user_360(rollup: DataFrame, as_of: str) -> DataFrame:
    """One profile per user over all days up to ``as_of``.

    ``visited_regions`` is the list of visited regions in run-length form, sorted by region: it
    holds the same multiset as one entry per event, but its size depends on the number of
    regions and not on how often a user was active.
    """
    by_region = (
        until(rollup, as_of)
        .groupBy("user_id", "region")
        .agg(
            F.sum("events").alias("events"),
            _events_of("click").alias("clicks"),
            _events_of("booking").alias("bookings"),
            _events_of("search").alias("searches"),
            F.sum("amount_sum").alias("spent"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
    )
    visit = F.struct("region", F.col("events").alias("visits"))
    return (
        by_region.groupBy("user_id")
        .agg(
            F.sum("events").alias("total_events"),
            F.sum("clicks").alias("total_clicks"),
            F.sum("bookings").alias("total_bookings"),
            F.sum("searches").alias("total_searches"),
            money("spent").alias("total_spent"),
            (money("spent") / F.sum("events")).alias("avg_transaction_value"),
            F.sort_array(F.collect_list(F.when(F.col("region").isNotNull(), visit))).alias(
                "visited_regions"
            ),
            F.max("last_ts").alias("last_activity_date"),
            F.min("first_ts").alias("first_activity_date"),
        )
        .withColumn("processing_date", F.lit(as_of))
    )


def booking_metrics(rollup: DataFrame) -> DataFrame:
    """Per region and day.  The roll-up has one row per user here, so the count of users is exact
    without a distinct aggregate."""
    return (
        rollup.where(F.col("event_type") == "booking")
        .groupBy("region", "processing_date")
        .agg(
            F.sum("events").alias("total_bookings"),
            money("amount_sum").alias("total_revenue"),
            (money("amount_sum") / F.sum("events")).alias("avg_booking_value"),
            F.max("amount_max").alias("max_booking_value"),
            F.min("amount_min").alias("min_booking_value"),
            F.count("user_id").alias("unique_users"),
            sum_of(F.col("user_id").isNotNull(), "events").alias("user_events"),
        )
    )


def tourism_analytics(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("region", "event_type", "processing_date").agg(
        F.sum("events").alias("event_count"),
        F.count("user_id").alias("unique_users"),
        sum_of(F.col("user_id").isNotNull(), "events").alias("user_events"),
    )


def tourism_pivot(rollup: DataFrame, event_types: list[str]) -> DataFrame:
    """One column per stated event type, and ``other`` for all types beside them: the columns of a row add up to its
    events.  The stated list spares the extra job that finds the values."""
    known = F.when(F.col("event_type").isin(event_types), F.col("event_type")).otherwise("other")
    return (
        rollup.withColumn("event_type", known)
        .groupBy("region", "processing_date")
        .pivot("event_type", [*event_types, "other"])
        .agg(F.sum("events"))
        .na.fill(0)
    )


def recommendation_features(rollup: DataFrame, as_of: str) -> DataFrame:
    total, bookings = F.col("total_interactions"), F.col("bookings")
    return (
        until(rollup, as_of)
        .groupBy("user_id")
        .agg(
            F.sum("events").alias("total_interactions"),
            _events_of("click").alias("clicks"),
            _events_of("booking").alias("bookings"),
            _events_of("search").alias("searches"),
            money("amount_sum").alias("total_spend"),
            (money("amount_sum") / F.sum("events")).alias("avg_spend"),
            F.countDistinct("region").alias("region_diversity"),
            sum_of(F.col("region").isNotNull(), "events").alias("region_events"),
            F.datediff(F.lit(as_of).cast("date"), F.max("last_ts")).alias("days_since_last_activity"),
        )
        .withColumn("conversion_rate", ratio(bookings, total))
        .withColumn("processing_date", F.lit(as_of))
    )


def daily_summary(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("processing_date").agg(
        F.sum("events").alias("total_events"),
        F.countDistinct("user_id").alias("unique_users"),
        _events_of("booking").alias("bookings"),
        money("amount_sum").alias("revenue"),
        F.countDistinct("region").alias("regions_active"),
    )


def regional_metrics(rollup: DataFrame, days: int = 7, sigmas: float = 2.0, warmup: int = 3) -> DataFrame:
    """Booking metrics with an anomaly flag: revenue further than ``sigmas`` deviations from the
    mean of the region's ``days`` previous rows.  The window runs over one row per region and day."""
    trailing = Window.partitionBy("region").orderBy("processing_date").rowsBetween(-days, -1)
    mean, deviation = F.avg("total_revenue").over(trailing), F.stddev_samp("total_revenue").over(trailing)
    odd = (F.count("total_revenue").over(trailing) >= warmup) & (
        F.abs(F.col("total_revenue") - mean) > sigmas * deviation
    )
    return booking_metrics(rollup).select(
        F.col("processing_date").alias("metric_date"),
        "region",
        "total_bookings",
        "total_revenue",
        "avg_booking_value",
        "unique_users",
        F.when(odd, 1).otherwise(0).alias("anomaly_flag"),
    )


def daily_event_summary(events: DataFrame) -> DataFrame:
    """Day, region and type totals straight from events: every measure is additive."""
    return events.groupBy(F.to_date("timestamp").alias("event_date"), "region", "event_type").agg(
        F.count("*").alias("event_count"),
        money("amount").alias("total_amount"),
        (money("amount") / F.count("amount")).alias("avg_amount"),
        F.max("amount").alias("max_amount"),
    )


def reconcile(raw: DataFrame, key: str, valid) -> DataFrame:
    """Rows before and after cleaning in one pass: copies fold into their key map-side, and a key
    survives when its first copy, in the order of the cleaner, is valid."""
    first = order_value(raw.drop(key), "timestamp", "user_id")
    per_key = raw.groupBy(key).agg(F.count("*").alias("copies"), F.min_by(valid, first).alias("ok"))
    return per_key.agg(
        F.sum("copies").alias("records_before"), count_of(F.col("ok")).alias("records_after")
    ).select(
        "records_before",
        "records_after",
        (F.col("records_before") - F.col("records_after")).alias("records_filtered"),
        (ratio("records_after", "records_before") * 100).alias("quality_rate"),
    )
