"""Row-level cleaning, masking, retention and typed projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata import schemas
from strata.functions.columns import code_list, grid
from strata.operators.dedup import keep_first, row_order

# Log levels that are kept; change operations that are kept.
LOG_LEVELS = ["ERROR", "WARN", "INFO"]
CHANGE_OPS = ["c", "u", "d"]
METRES_PER_DEGREE = 111_320
# At the poles themselves a degree of longitude has no length.
LEAST_SHRINK = 1e-3


def require(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def standardise(df: DataFrame) -> DataFrame:
    return df.withColumn("event_type", F.lower(F.trim("event_type"))).withColumn(
        "region", F.upper(F.trim("region"))
    )


def non_negative(df: DataFrame, column: str = "amount", null_amount: str = "drop") -> DataFrame:
    """Rows with ``column >= 0``; tables without the column pass.  Null amounts go unless kept."""
    if column not in df.columns:
        return df
    ok = F.col(column) >= 0
    return df.where(ok if null_amount == "drop" else ok | F.col(column).isNull())


def with_processing(df: DataFrame, processing_date: str, score: float | Column | None = None) -> DataFrame:
    df = df.withColumn("processed_at", F.current_timestamp()).withColumn(
        "processing_date", F.lit(processing_date)
    )
    if score is None:
        return df
    return df.withColumn("data_quality_score", score if isinstance(score, Column) else F.lit(score))


def with_date_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return (
        df.withColumn("year", F.year(ts))
        .withColumn("month", F.month(ts))
        .withColumn("day", F.dayofmonth(ts))
        .withColumn("hour", F.hour(ts))
    )


def clean_app_events(df: DataFrame, processing_date: str, null_amount: str = "drop") -> DataFrame:
    """One row per event id, users and times present, text standardised, no negative amount.

    Of copies the earliest stays; one without time or user loses to one with, and equal times are decided by the rest
    of the row, so the result is the same on every run.
    """
    return (
        df.transform(keep_first, ["event_id"], row_order(df, "timestamp", "user_id"))
        .transform(require, "user_id", "timestamp")
        .transform(standardise)
        .transform(non_negative, "amount", null_amount)
        .transform(with_processing, processing_date)
    )


def keep_changes(df: DataFrame, include_snapshot: bool = False) -> DataFrame:
    return df.where(F.col("op").isin(CHANGE_OPS + (["r"] if include_snapshot else [])))


def transform_by_spec(df: DataFrame, specs: list[dict]) -> DataFrame:
    """Declared per-source steps: ``timestamp``, ``lower``, ``filter`` and ``round``."""
    for spec in specs:
        kind = spec["type"]
        if kind == "timestamp":
            source = F.col(spec["column"]) if "column" in spec else F.current_timestamp()
            df = df.withColumn(spec["target_column"], source.cast("timestamp"))
        elif kind == "lower":
            df = df.withColumn(spec["column"], F.lower(spec["column"]))
        elif kind == "filter":
            df = df.where(F.expr(spec["condition"]))
        elif kind == "round":
            df = df.withColumn(spec["column"], F.round(spec["column"], spec["places"]))
        else:
            raise ValueError(f"unknown transformation type: {kind}")
    return df


def keep_log_levels(df: DataFrame, levels: list[str] = LOG_LEVELS) -> DataFrame:
    return df.where(F.col("level").isin(levels))


def mask(df: DataFrame, fields: list[str], salt: str) -> DataFrame:
    """Personal fields become salted digests: equal values stay equal, the value is gone."""
    return df.withColumns(
        {f: F.sha2(F.concat(F.lit(salt), F.col(f).cast("string")), 256) for f in fields if f in df.columns}
    )


def anonymise_position(df: DataFrame, metres: float = 100) -> DataFrame:
    """Positions snapped to a grid of the given size.  Degrees of longitude shrink towards the poles, so cells there
    are as many degrees wider; the width follows from the snapped latitude alone."""
    step = metres / METRES_PER_DEGREE
    shrink = F.greatest(F.cos(F.radians("latitude")), F.lit(LEAST_SHRINK))
    snapped = df.withColumn("latitude", grid("latitude", step)).withColumn("_step", step / shrink)
    return snapped.withColumn("longitude", F.round(F.col("longitude") / F.col("_step")) * F.col("_step")).drop("_step")


def sample_by_key(df: DataFrame, key: str, rate: float) -> DataFrame:
    """A stable sample: a key is in or out for good, whatever the run, partitioning or engine."""
    if rate >= 1:
        return df
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.where(digest < int(rate * 2**32))


def retention_state(ts: Column, as_of: str, archive_after_days: int, retention_days: int) -> Column:
    age = F.datediff(F.lit(as_of).cast("date"), ts)
    return (
        F.when(age > retention_days, "expired").when(age > archive_after_days, "archive").otherwise("active")
    )


def clean_users(users: DataFrame, key: str, name: str) -> DataFrame:
    return (
        users.transform(keep_first, [key], row_order(users, name))
        .transform(require, key, name)
        .withColumn(name, F.upper(F.trim(name)))
    )


def booking_errors(bookings: DataFrame, users: DataFrame, as_of: str, max_amount: float) -> DataFrame:
    """Bookings with the list of broken rules: amount range, status, future date, unknown user."""
    known = users.select(F.col("user_id").alias("known_user")).distinct()
    rules = {
        "amount_range": ~F.col("amount").between(0, max_amount) | F.col("amount").isNull(),
        "status": ~F.col("status").isin("F", "O"),
        "future": F.col("created_at") > F.lit(as_of).cast("timestamp_ntz"),
        "unknown_user": F.col("known_user").isNull(),
    }
    joined = bookings.join(known, bookings.user_id == known.known_user, "left")
    codes = code_list(*[F.when(bad, code) for code, bad in rules.items()])
    return joined.withColumn("errors", codes).drop("known_user")


def split(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid rows of one input: a flag and two filters, no join and no set difference."""
    flagged = df.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    return flagged.where("_ok").drop("_ok"), flagged.where(~F.col("_ok")).drop("_ok")


def enrich_clicks(clicks: DataFrame) -> DataFrame:
    """Nested clickstream rows flattened, addresses taken apart, missing users marked anonymous."""
    url = F.col("properties.url")
    return clicks.select(
        "anonymous_id",
        "user_id",
        F.col("user_id").isNull().alias("is_anonymous"),
        F.coalesce(F.col("user_id").cast("string"), "anonymous_id").alias("visitor"),
        "event",
        url.alias("url"),
        F.try_parse_url(url, F.lit("HOST")).alias("host"),
        F.coalesce("properties.path", F.try_parse_url(url, F.lit("PATH"))).alias("path"),
        F.coalesce("properties.search", F.try_parse_url(url, F.lit("QUERY"))).alias("search"),
        F.col("properties.duration").alias("duration"),
        F.col("context.ip").alias("ip"),
        F.col("context.user_agent").alias("user_agent"),
        F.col("context.screen.width").alias("screen_width"),
        F.col("context.screen.height").alias("screen_height"),
        F.col("context.campaign.source").alias("campaign_source"),
        F.col("context.campaign.name").alias("campaign_name"),
        F.try_to_timestamp("timestamp").alias("timestamp"),
    )


def external(records: DataFrame, data_type: str) -> DataFrame:
    """External rows of one data type with their payload parsed by that type's schema."""
    schema = {"weather": schemas.WEATHER, "maps": schemas.PLACE, "social": schemas.SOCIAL}[data_type]
    return records.where(F.col("data_type") == data_type).withColumn("data", F.from_json("data", schema))


def weather(records: DataFrame) -> DataFrame:
    """One row per forecast day beside the current reading; no forecast still gives one row."""
    rows = external(records, "weather").withColumn("day", F.explode_outer("data.forecast"))
    return rows.select(
        "source",
        F.col("location.city").alias("city"),
        F.col("location.country").alias("country"),
        "timestamp",
        F.col("data.current.temp").alias("temp"),
        F.col("data.current.humidity").alias("humidity"),
        F.col("day.date").alias("forecast_date"),
        F.col("day.temp_min").alias("temp_min"),
        F.col("day.temp_max").alias("temp_max"),
        F.col("day.precipitation").alias("precipitation"),
    )


# --- listings and saved searches ---------------------------------------------------------------


def search_logs(
    logs: DataFrame,
    level: str | None = None,
    service: str | None = None,
    since: str | None = None,
    size: int | None = None,
) -> DataFrame:
    """Newest first.  The id breaks ties, so equal times can still be spread over range partitions."""
    if level is not None:
        logs = logs.where(F.col("level") == level)
    if service is not None:
        logs = logs.where(F.col("service") == service)
    if since is not None:
        logs = logs.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    logs = logs.orderBy(F.desc("ts"), F.desc("id"))
    return logs if size is None else logs.limit(size)


def newest_first(df: DataFrame, ts: str, tie: str, **equals) -> DataFrame:
    """A filtered listing in descending time order."""
    for column, value in equals.items():
        df = df.where(F.col(column) == value)
    return df.orderBy(F.desc(ts), F.desc(tie))


SAVED_SEARCHES = {
    "service_errors": "service = 'svc-1' AND level = 'ERROR'",
    "slow": "response_time > 1000",
    "message_in_service": "message LIKE '%error%' AND service LIKE 'svc%'",
    "zero_results": "results_count = 0 AND query <> ''",
}


def saved_search(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.expr(SAVED_SEARCHES[name]))
