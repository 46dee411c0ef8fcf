"""Message-queue records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata import schemas

# Topic pattern, intake bound per trigger and trigger interval.
TOPIC_PATTERN = "topic_.*"
MAX_OFFSETS_PER_TRIGGER = 10_000
TRIGGER = "10 seconds"


def kafka_options(
    servers: str, pattern: str = TOPIC_PATTERN, limit: int = MAX_OFFSETS_PER_TRIGGER, fail_on_loss: bool = False
) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribePattern": pattern,
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": str(limit),
        "failOnDataLoss": str(fail_on_loss).lower(),
    }


def kafka_stream(spark: SparkSession, servers: str, **options) -> DataFrame:
    """Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, **options)).load()


def file_stream(spark: SparkSession, path: str, topics: str = TOPIC_PATTERN, files_per_trigger: int = 1) -> DataFrame:
    """The same seven columns from Parquet files, with the same topic pattern and a bounded intake."""
    records = (
        spark.readStream.schema(schemas.QUEUE_RECORD).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )
    return records.where(records.topic.rlike(f"^{topics}$"))
