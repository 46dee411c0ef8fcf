"""The daily plan: bronze -> silver -> gold, plain and governed."""

from __future__ import annotations

import time
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata import schemas
from strata.functions import envelope
from strata.operators import clean, dlq, gold, metadata, quality
from strata.operators.dedup import distinct_rows
from strata.session import cut_lineage
from strata.sinks.layers import replace_day
from strata.sources.tables import bronze_partition, path_exists, written_days

# Payload fields of an app event and their types in silver.
EVENT_FIELDS = {
    "event_id": "string",
    "user_id": "bigint",
    "event_type": "string",
    "timestamp": "timestamp",
    "amount": "double",
    "region": "string",
    "source": "string",
}
EVENT_TYPES = ["click", "view", "search", "booking", "rating", "navigation"]
ACTIVITY = (
    "user_id bigint, region string, event_type string, events bigint, amount_sum double, amount_max double, "
    "amount_min double, first_ts timestamp, last_ts timestamp, processing_date string"
)
SILVER = "app_events_cleaned"
# Bronze source types that carry app events, directly or routed by event type.
EVENT_SOURCES = ["app_events", "booking_events", "user_events"]
CHANGE_FIELDS = {
    "op": "string",
    "ts_ms": "bigint",
    "source": "struct<db:string,table:string>",
    "before": "map<string,string>",
    "after": "map<string,string>",
}
USER_FIELDS = {"user_id": "bigint", "name": "string", "email": "string", "country": "string"}
BOOKING_FIELDS = {
    "booking_id": "bigint", "user_id": "bigint", "amount": "double", "created_at": "timestamp_ntz", "status": "string",
}
MAX_BOOKING = 400_000.0


def bronze_rows(spark: SparkSession, bronze: str, date: str, source_type: str, fields: dict[str, str]) -> DataFrame:
    """One day's valid bronze rows of a source with typed payload fields; only that day's folder is listed."""
    rows = bronze_partition(
        spark,
        bronze,
        schemas.BRONZE,
        (F.col("source_type") == source_type) & (F.col("ingestion_date") == F.lit(date).cast("date")),
        (f"source_type={source_type}", f"ingestion_date={date}"),
    )
    return envelope.typed(rows.where("is_valid"), fields).select("offset", *fields)


def bronze_events(spark: SparkSession, bronze: str, date: str, source_types: list[str] = EVENT_SOURCES) -> DataFrame:
    """One day's app events of all sources that carry them."""
    parts = [bronze_rows(spark, bronze, date, s, EVENT_FIELDS).select(*EVENT_FIELDS) for s in source_types]
    return reduce(DataFrame.unionByName, parts)


def _fields(schema: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}


def other_silver(spark: SparkSession, bronze: str, silver: str, dead: str, date: str) -> dict[str, int]:
    """The day's silver tables beside the app events: processed change data, users, validated bookings, enriched
    clicks and weather.  Each replaces its day; bookings that break a rule become dead letters.  Returns the rows
    written by table."""
    read = lambda source, fields: bronze_rows(spark, bronze, date, source, fields)
    users = clean.clean_users(read("users", USER_FIELDS).drop("offset"), "user_id", "name")
    checked = clean.booking_errors(
        read("bookings", BOOKING_FIELDS).drop("offset"),
        users.select("user_id"),
        date + " 23:59:59",
        MAX_BOOKING,
    )
    accepted, refused = clean.split(checked, F.size("errors") == 0)
    tables = {
        "cdc_changes_processed": clean.keep_changes(read("cdc_changes", CHANGE_FIELDS)),
        "users_cleaned": users,
        "bookings_validated": accepted.drop("errors"),
        "clicks_enriched": clean.enrich_clicks(read("clickstream", _fields(schemas.CLICKSTREAM))),
        "weather_normalised": clean.weather(read("external_data", _fields(schemas.EXTERNAL))),
    }
    written = {}
    for name, rows in tables.items():
        stamped = clean.with_processing(rows, date)
        replace_day(stamped, f"{silver}/{name}", "processing_date", date)
        written[name] = written_rows(spark, f"{silver}/{name}", date, stamped.schema)
    message = refused.withColumn("_message", F.to_json(F.struct(*BOOKING_FIELDS)))
    letters = dlq.letters(message, "_message", "bookings", F.current_timestamp(), errors="errors")
    replace_day(letters.withColumn("processing_date", F.lit(date)), f"{dead}/bookings", "processing_date", date, ["queue"])
    return written


def written_rows(spark: SparkSession, path: str, date: str, schema: StructType) -> int:
    """Rows of a written day, from the file footers of its partition."""
    return spark.read.schema(schema).parquet(f"{path}/processing_date={date}").count()


def bronze_to_silver(events: DataFrame, silver: str, date: str) -> dict[str, float]:
    """Cleans and writes the day.  Rows are counted in the input and in the written files: counters
    taken along the way would count rows of repeated tasks again."""
    out = clean.with_date_parts(clean.clean_app_events(events, date))
    path = f"{silver}/{SILVER}"
    replace_day(out, path, "processing_date", date, order_by=["timestamp", "user_id"])
    n, kept = events.count(), written_rows(events.sparkSession, path, date, out.schema)
    return {
        "records_before": n,
        "records_after": kept,
        "records_filtered": n - kept,
        "quality_rate": kept / n * 100 if n else 0.0,
    }


def governed_bronze_to_silver(
    spark: SparkSession, events: DataFrame, silver: str, dead: str, audit: str, date: str, expected: list[str]
) -> DataFrame:
    """Checks, diverts, cleans, writes, and records results, lineage and metrics under ``audit``.

    Fails the run when expected columns are missing, after all rows went to the dead letters.
    Returns the check results.
    """
    started = time.time()

    def divert(rows: DataFrame, **why) -> None:
        message = rows.withColumn("_message", F.to_json(F.struct(*events.columns)))
        letters = dlq.letters(message, "_message", "app_events", F.current_timestamp(), **why)
        replace_day(letters.withColumn("processing_date", F.lit(date)), dead, "processing_date", date, ["queue"])

    columns = quality.expected_columns(events, expected, "app_events")
    missing = sorted(set(expected) - set(events.columns))
    if missing:
        codes = F.array(*[F.lit(f"missing:{c}") for c in missing])
        divert(events.withColumn("_errors", codes), errors="_errors")
        quality.gate(columns)
    # a handful of rows, used three times below
    results = cut_lineage(
        columns.unionByName(
            quality.table_checks(
                events, "app_events", {"user_id_not_null": {"type": "range", "column": "user_id", "min": 1}}
            )
        )
    )
    scored = quality.score(results).first()
    # full rows are shuffled once for both outputs
    valid, invalid = clean.split(cut_lineage(distinct_rows(events)), F.col("user_id").isNotNull())
    out = clean.with_processing(valid, date, scored.quality_score)
    path = f"{silver}/{SILVER}"
    replace_day(out, path, "processing_date", date, order_by=["timestamp", "user_id"])
    divert(invalid, step="null_user_id")
    n_in, n_out = events.count(), written_rows(spark, path, date, out.schema)
    now = datetime.now()
    lineage = metadata.lineage_event(
        spark, "job_start", datetime.fromtimestamp(started), job_name="bronze_to_silver", status="running"
    ).unionByName(
        metadata.lineage_event(
            spark, "ingestion", now, job_name="bronze_to_silver", source={"layer": "source", "tables": EVENT_SOURCES},
            destination={"layer": "bronze", "table": "app_events"}, row_count_in=n_in, row_count_out=n_in,
        )
    ).unionByName(metadata.lineage_event(
        spark, "transformation", now, job_name="bronze_to_silver",
        source={"layer": "bronze", "tables": ["app_events"]}, destination={"layer": "silver", "table": SILVER},
        transformation_type="cleaning", row_count_in=n_in, row_count_out=n_out,
    )).unionByName(
        metadata.lineage_event(
            spark, "job_end", now, job_name="bronze_to_silver", status="success", duration_seconds=time.time() - started
        )
    )
    run = spark.createDataFrame(
        [("bronze_to_silver", "SUCCESS", datetime.fromtimestamp(started), now, n_in, n_in - n_out)],
        "source_id string, status string, started_at timestamp, ended_at timestamp, "
        "extracted_record_count bigint, failed_record_count bigint",
    )
    samples = metadata.job_metrics(run).unionByName(
        metadata.quality_metrics(
            spark.createDataFrame([scored]), "silver", "bronze_to_silver", F.lit(now).cast("timestamp")
        )
    )
    for name, rows in {"lineage": lineage, "runs": run, "metrics": samples, "checks": results}.items():
        rows.coalesce(1).write.mode("append").parquet(f"{audit}/{name}")
    return results


def _carry(spark: SparkSession, gold_root: str, rollup: DataFrame, date: str) -> DataFrame:
    """Writes the running total of a day, the last one before it with the roll-ups since then added, and reads it."""
    path = f"{gold_root}/activity_totals"
    totals = spark.read.schema(ACTIVITY).parquet(path) if path_exists(spark, path) else rollup.limit(0)
    last = totals.where(F.col("processing_date") < date).agg(F.max("processing_date")).first()[0] or ""
    since = rollup.where((F.col("processing_date") > last) & (F.col("processing_date") <= date))
    carried = gold.carried(totals.where(F.col("processing_date") == last), since)
    replace_day(carried.withColumn("processing_date", F.lit(date)), path, "processing_date", date)
    return spark.read.schema(ACTIVITY).parquet(path).where(F.col("processing_date") == date)


def silver_to_gold(spark: SparkSession, silver: DataFrame, gold_root: str, date: str) -> dict[str, DataFrame]:
    """Writes the day's roll-up once and builds the five tables from it.

    Silver is read for one day only.  The per-user tables come from a running total per user, region and event type,
    yesterday's with the day's roll-up added, so no earlier day is aggregated again; days without a total are taken
    from their roll-ups.  Every table replaces its day.  If later days were written before, by a rerun or out of order,
    their totals and per-user tables are built again, day by day.
    """
    rollup_path = f"{gold_root}/activity"
    day = silver.where(F.col("processing_date") == date)
    replace_day(gold.activity(day), rollup_path, "processing_date", date)
    rollup = spark.read.schema(ACTIVITY).parquet(rollup_path)
    today = rollup.where(F.col("processing_date") == date)
    later = [d for d in written_days(spark, f"{gold_root}/activity_totals", "processing_date") if d > date]
    types = {}

    def write(name: str, df: DataFrame, of_day: str) -> None:
        stamped = df.withColumn("processed_at", F.current_timestamp())
        replace_day(stamped, f"{gold_root}/{name}", "processing_date", of_day)
        types[name] = [f for f in stamped.schema if f.name != "processing_date"]

    for of_day in [date, *later]:
        total = _carry(spark, gold_root, rollup, of_day)
        write("user_360_view", gold.user_360(total, of_day), of_day)
        write("recommendation_features", gold.recommendation_features(total, of_day), of_day)
    write("booking_metrics", gold.booking_metrics(today), date)
    write("tourism_analytics", gold.tourism_pivot(today, EVENT_TYPES), date)
    write("daily_summary", gold.daily_summary(today), date)
    return {
        name: spark.read.schema(StructType(fields).add("processing_date", "string")).parquet(f"{gold_root}/{name}")
        for name, fields in types.items()
    }
