"""Queue records and their JSON envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import computed_once


# Keys that only an enveloped message carries.
ENVELOPE_KEYS = ["source_id", "source_name", "ingestion_timestamp", "data"]


def wrap(df: DataFrame, source_id: str | Column, source_name: str | Column, ingested_at: Column) -> DataFrame:
    """Rows as ``value`` JSON: source id and name, ingestion time and the row itself."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    body = F.struct(
        as_column(source_id).alias("source_id"),
        as_column(source_name).alias("source_name"),
        ingested_at.cast("string").alias("ingestion_timestamp"),
        F.struct(*df.columns).alias("data"),
    )
    return df.select(F.to_json(body).alias("value"))


def decode(records: DataFrame) -> DataFrame:
    """Queue records -> flat columns with the payload as a string map.

    A flat event without an envelope is accepted too: its own fields become the payload and its
    ``source`` and ``timestamp`` fields take the place of the envelope's.  ``message`` is the text as received.
    """
    parsed = computed_once(records, fields=F.from_json(F.col("value").cast("string"), "map<string,string>"))
    field = lambda name: F.try_element_at("fields", F.lit(name))
    enveloped = F.arrays_overlap(F.map_keys("fields"), F.array(*[F.lit(k) for k in ENVELOPE_KEYS]))
    flat = F.when(F.size("fields") > 0, F.col("fields"))
    return parsed.select(
        F.col("topic").alias("kafka_topic"),
        "partition",
        "offset",
        F.col("timestamp").alias("kafka_timestamp"),
        F.col("value").cast("string").alias("message"),
        F.coalesce(field("source_id"), field("source")).alias("source_id"),
        F.coalesce(field("source_name"), field("source")).alias("source_name"),
        F.when(enveloped, field("ingestion_timestamp")).otherwise(field("timestamp")).alias("ingestion_timestamp"),
        F.when(enveloped, F.from_json(field("data"), "map<string,string>")).otherwise(flat).alias("raw_data"),
    )


def with_validity(df: DataFrame) -> DataFrame:
    """A row is valid, score 100, when source id, payload and ingestion time are all present."""
    complete = (
        F.col("source_id").isNotNull()
        & F.col("raw_data").isNotNull()
        & F.col("ingestion_timestamp").isNotNull()
    )
    return df.withColumn("is_valid", complete).withColumn(
        "quality_score", F.when(complete, 100).otherwise(0)
    )


def source_type(topic: Column) -> Column:
    return F.regexp_replace(topic, "^topic_", "")


def with_partitions(df: DataFrame, ts: str = "processed_timestamp") -> DataFrame:
    return (
        df.withColumn("source_type", source_type(F.col("kafka_topic")))
        .withColumn("ingestion_date", F.to_date(ts))
        .withColumn("ingestion_hour", F.hour(ts))
    )


def typed(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Payload map -> typed columns; nested types are read from their JSON text; a value that does not convert becomes
    null."""

    def value(name: str, kind: str) -> Column:
        text = F.try_element_at("raw_data", F.lit(name))
        return F.from_json(text, kind) if kind.startswith(("struct", "map", "array")) else text.try_cast(kind)

    return df.select("*", *[value(n, t).alias(n) for n, t in fields.items()])


def event_topic(event_type: Column) -> Column:
    return F.when(event_type == "booking", "topic_booking_events").otherwise("topic_user_events")
