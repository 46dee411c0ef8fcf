"""Serving analytics: tour and region statistics, dashboards, KPI tiles and paged listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import bucket, count_of, money, percent, ratio

# Page sizes the listing calls accept at most.
MAX_TOURS = 100
MAX_RECOMMENDATIONS = 20


# --- regions and tours -------------------------------------------------------------------------


def regional_stats(
    events: DataFrame,
    region: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Bookings, revenue, users and conversion % per region, both date bounds included."""
    if region is not None:
        events = events.where(F.col("region") == region)
    if date_from is not None:
        events = events.where(F.col("timestamp") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        end = F.lit(date_to).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
        events = events.where(F.col("timestamp") < end)
    booked = F.col("event_type") == "booking"
    per_region = events.groupBy("region").agg(
        count_of(booked).alias("total_bookings"),
        F.coalesce(money(F.when(booked, F.col("amount"))), F.lit(0.0)).alias("total_revenue"),
        F.countDistinct("user_id").alias("unique_users"),
        F.count("*").alias("events"),
    )
    return per_region.select(
        "region",
        "total_bookings",
        "total_revenue",
        "unique_users",
        ratio("total_revenue", "total_bookings").alias("avg_booking_value"),
        percent("total_bookings", "events").alias("conversion_rate"),
    )


def tour_totals(events: DataFrame) -> DataFrame:
    """One row per tour; aggregated before any join, so a hot tour joins as a single row."""
    booked = F.col("event_type") == "booking"
    return events.groupBy("tour_id").agg(
        F.count("*").alias("views"),
        count_of(F.col("event_type") == "view").alias("view_events"),
        count_of(booked).alias("bookings"),
        F.coalesce(money(F.when(booked, F.col("amount"))), F.lit(0.0)).alias("revenue"),
    )


def tour_performance(tours: DataFrame, events: DataFrame) -> DataFrame:
    """Every tour, also those without events.  ``views`` counts all events of the tour."""
    return (
        tours.select("tour_id", "name", "region", "rating")
        .join(tour_totals(events), "tour_id", "left")
        .na.fill(0, ["views", "view_events", "bookings"])
        .na.fill(0.0, ["revenue"])
        .select(
            "tour_id",
            "name",
            "region",
            "views",
            "view_events",
            "bookings",
            "revenue",
            percent("bookings", "views").alias("conversion_rate"),
            F.col("rating").alias("avg_rating"),
        )
    )


def platform_metrics(tours: DataFrame, events: DataFrame) -> DataFrame:
    """Platform totals in one aggregate over both tables stacked, so nothing is cross-joined; regions are those of
    tours."""
    stacked = tours.select("region", "price", "rating", F.lit(1).alias("tour"), F.lit(0).alias("event")).unionByName(
        events.select(F.lit(0).alias("tour"), F.lit(1).alias("event")), allowMissingColumns=True,
    )
    return stacked.agg(
        F.sum("tour").alias("total_tours"),
        F.sum("event").alias("total_events"),
        F.sort_array(F.collect_set("region")).alias("regions"),
        F.countDistinct("region").alias("regions_count"),
        (money("price") / F.count("price")).alias("avg_tour_price"),
        (F.round(F.sum("rating"), 4) / F.count("rating")).alias("avg_tour_rating"),
    )


def list_tours(
    tours: DataFrame,
    region: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    limit: int = 10,
    skip: int = 0,
) -> DataFrame:
    """One page of tours in key order; a page of more than ``MAX_TOURS`` rows is refused."""
    if not 0 < limit <= MAX_TOURS or skip < 0:
        raise ValueError(f"limit must be 1 to {MAX_TOURS} and skip not negative")
    if region is not None:
        tours = tours.where(F.col("region") == region.upper())
    if min_price is not None:
        tours = tours.where(F.col("price") >= min_price)
    if max_price is not None:
        tours = tours.where(F.col("price") <= max_price)
    return tours.orderBy("tour_id").offset(skip).limit(limit)


def tour_by_id(tours: DataFrame, tour_id) -> DataFrame:
    return tours.where(F.col("tour_id") == tour_id)


# --- time-bounded summaries --------------------------------------------------------------------


def last_days(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the ``days`` days before ``as_of`` (excluded); both bounds are literals, so the
    filter reaches the scan."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.where((F.col(ts) >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) < end))


def bookings_by_region(bookings: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return (
        last_days(bookings, "timestamp", as_of, days)
        .groupBy("region")
        .agg(F.count("*").alias("booking_count"), (money("amount") / F.count("amount")).alias("avg_price"))
        .orderBy(F.desc("booking_count"), "region")
    )


def revenue(bookings: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return last_days(bookings, "timestamp", as_of, days).agg(money("amount").alias("revenue"))


def top_destinations(tours: DataFrame, events: DataFrame, n: int = 10) -> DataFrame:
    """Destinations by bookings with the mean rating over those bookings."""
    booked = events.where(F.col("event_type") == "booking").groupBy("tour_id").agg(F.count("*").alias("n"))
    return (
        booked.join(tours.select("tour_id", "name", "rating"), "tour_id")
        .groupBy(F.col("name").alias("destination"))
        .agg(
            F.sum("n").alias("bookings"),
            (F.round(F.sum(F.col("n") * F.col("rating")), 4) / F.sum("n")).alias("avg_rating"),
        )
        .orderBy(F.desc("bookings"), "destination")
        .limit(n)
    )


def daily_counts(events: DataFrame, ts: str, newest: int | None = None) -> DataFrame:
    days = events.groupBy(F.date_trunc("day", F.col(ts)).alias("day")).agg(F.count("*").alias("events"))
    days = days.orderBy(F.desc("day"))
    return days if newest is None else days.limit(newest)


def hourly_counts(events: DataFrame, ts: str, **filters: Column) -> DataFrame:
    """Events per hour with one sub-count per named filter."""
    return events.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        F.count("*").alias("events"), *[count_of(f).alias(name) for name, f in filters.items()]
    )


def zero_filled_hours(hourly: DataFrame) -> DataFrame:
    """Hours without events get a zero row: each hour opens the run of hours up to the next one."""
    step = F.expr("INTERVAL 1 HOUR")
    spans = hourly.withColumn(
        "until", F.coalesce(F.lead("hour").over(Window.orderBy("hour")) - step, F.col("hour"))
    )
    slots = spans.withColumn("slot", F.explode(F.sequence("hour", "until", step)))
    return slots.select(
        F.col("slot").alias("hour"),
        F.when(F.col("slot") == F.col("hour"), F.col("events")).otherwise(0).alias("events"),
    )


def revenue_trend(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy(F.to_date("timestamp").alias("day")).agg(money("amount").alias("revenue"))


def terms(df: DataFrame, *keys: str, size: int | None = None) -> DataFrame:
    """Most frequent key values."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("count"))
    if size is None:
        return counted
    return counted.orderBy(F.desc("count"), *keys).limit(size)


def share(df: DataFrame, *keys: str) -> DataFrame:
    """Counts per key value and their share of all rows in %."""
    total = df.agg(F.count("*")).scalar()
    return terms(df, *keys).withColumn("share", F.col("count") / total * 100)


def histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    return df.groupBy(bucket(value, width).alias("bucket")).agg(F.count("*").alias("count"))


# --- user growth -------------------------------------------------------------------------------


def user_months(events: DataFrame) -> DataFrame:
    """One row per user and active month, with the user's first month."""
    month = F.trunc("timestamp", "month")
    active = events.groupBy("user_id", month.alias("month")).agg(
        F.max(F.when(F.col("event_type") == "booking", 1).otherwise(0)).alias("booked")
    )
    return active.withColumn("cohort_month", F.min("month").over(Window.partitionBy("user_id")))


def _month_number(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def _month_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM").alias(c)


def cohort_retention(events: DataFrame) -> DataFrame:
    """Share of each first-month cohort that is active again k months later."""
    offset = _month_number(F.col("month")) - _month_number(F.col("cohort_month"))
    cells = (
        user_months(events)
        .groupBy("cohort_month", offset.alias("month_offset"))
        .agg(F.count("*").alias("active_users"))
    )
    size = F.max(F.when(F.col("month_offset") == 0, F.col("active_users"))).over(
        Window.partitionBy("cohort_month")
    )
    return cells.withColumn("cohort_size", size).select(
        _month_text("cohort_month"),
        "month_offset",
        "active_users",
        "cohort_size",
        (F.col("active_users") / F.col("cohort_size") * 100).alias("retention_rate"),
    )


def user_growth(events: DataFrame) -> DataFrame:
    """Active, new and cumulative users and engagement % per month; the running sum covers one
    row per month."""
    months = user_months(events).groupBy("month").agg(
        F.count("*").alias("active_users"),
        count_of(F.col("month") == F.col("cohort_month")).alias("new_users"),
        F.sum("booked").alias("engaged_users"),
    )
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.select(
        _month_text("month"),
        "active_users",
        "new_users",
        F.sum("new_users").over(so_far).alias("total_users"),
        percent("engaged_users", "active_users").alias("engagement_rate"),
    )


# --- tiles -------------------------------------------------------------------------------------


def kpi_tiles(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Dashboard tiles in one aggregate: events, active pipelines, failed runs, health %."""
    one = F.lit(1)
    stacked = events.select(one.alias("event")).unionByName(
        runs.select("dag_id", "status"), allowMissingColumns=True
    )
    tiles = stacked.agg(
        F.count("event").alias("total_events"),
        F.countDistinct("dag_id").alias("active_pipelines"),
        count_of(F.col("status") == "FAILED").alias("processing_errors"),
        F.count("status").alias("runs"),
    )
    return tiles.select(
        "total_events",
        "active_pipelines",
        "processing_errors",
        (100 - percent("processing_errors", "runs")).alias("health"),
    )


def change_over_period(df: DataFrame, period: str, value: str) -> DataFrame:
    """Value, previous period's value and change in %; one row per period enters the window."""
    before = F.lag(value).over(Window.orderBy(period))
    return df.select(
        period,
        value,
        before.alias("previous"),
        F.when(before > 0, (F.col(value) - before) / before * 100).alias("change_percent"),
    )


