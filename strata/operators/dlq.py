"""Dead letters: failed rows with their error, queue and retry count; replay and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Queue names and the retry limit.
FAILED = "dlq_failed_messages"
SCHEMA = "dlq_schema_validation_errors"
PROCESSING = "dlq_processing_errors"
QUEUES = [FAILED, SCHEMA, PROCESSING]
MAX_RETRIES = 3


def letters(
    df: DataFrame,
    message: str,
    source: str | Column,
    at: Column,
    errors: str | None = None,
    step: str | None = None,
    error_type: str = "ValueError",
    error_message: str | Column = "",
    retry_count: Column | None = None,
) -> DataFrame:
    """Rows as dead letters.  ``errors`` names an array of contract errors, ``step`` the
    processing step that failed; with neither the letter goes to the general queue."""
    text = F.lit(error_message) if isinstance(error_message, str) else error_message
    if errors is not None:
        queue, joined = SCHEMA, F.array_join(errors, "; ")
        text = F.concat(F.lit("Schema validation failed: "), joined)
        metadata = F.create_map(F.lit("schema_errors"), joined)
    elif step is not None:
        queue, metadata = PROCESSING, F.create_map(F.lit("processing_step"), F.lit(step))
    else:
        queue, metadata = FAILED, F.create_map().cast("map<string,string>")
    previous = F.lit(0) if retry_count is None else F.coalesce(retry_count, F.lit(0))
    return df.select(
        F.col(message).cast("string").alias("original_message"),
        F.struct(
            F.lit(error_type).alias("type"),
            text.alias("message"),
            F.lit(None).cast("string").alias("traceback"),
        ).alias("error"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        at.alias("timestamp"),
        (previous + 1).cast("int").alias("retry_count"),
        metadata.alias("metadata"),
        F.lit(queue).alias("queue"),
    )


def producer_failures(df: DataFrame, message: str, topic: str, error: str | Column, at: Column) -> DataFrame:
    """Records a producer could not deliver, in the same form."""
    text = F.lit(error) if isinstance(error, str) else error
    return letters(df, message, topic, at, error_type="DeliveryError", error_message=text)


def write(dead: DataFrame, path: str, mode: str = "append") -> None:
    dead.write.mode(mode).partitionBy("queue").parquet(path)


def replay(dead: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Outcome per letter: skipped at the retry limit, failed when the message is no JSON object,
    else retried with ``value`` carrying the next retry count; all other values keep their types."""
    original = F.from_json("original_message", "map<string,variant>")
    broken = original.isNull() | (F.size(F.map_keys(original)) == 0)
    outcome = (
        F.when(F.col("retry_count") >= max_retries, "skipped").when(broken, "failed").otherwise("retried")
    )
    others = F.map_filter(original, lambda key, _: key != "retry_count")
    count = F.create_map(F.lit("retry_count"), F.parse_json((F.col("retry_count") + 1).cast("string")))
    value = F.to_json(F.map_concat(others, count))
    return dead.withColumn("outcome", outcome).withColumn("value", F.when(F.col("outcome") == "retried", value))


def resend(replayed: DataFrame, topic: str) -> DataFrame:
    return replayed.where(F.col("outcome") == "retried").select(F.lit(topic).alias("topic"), "value")


def replay_stats(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("outcome").agg(F.count("*").alias("messages"))


def stats(dead: DataFrame) -> DataFrame:
    return dead.groupBy("queue").agg(F.count("*").alias("message_count"))
