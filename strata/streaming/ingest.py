"""Stream intake: queue records -> bronze and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.functions import envelope
from strata.operators import dlq
from strata.sinks.layers import write_path
from strata.sources.queue import TRIGGER

PARTITIONS = ["source_type", "ingestion_date", "ingestion_hour", "query_id", "batch_id"]
LETTER_PARTITIONS = ["queue", "ingestion_date", "query_id", "batch_id"]


def decoded(records: DataFrame) -> DataFrame:
    """Flat, validated and partitioned rows.  ``current_timestamp`` is the micro-batch time from
    the query's offset log, so a repeated batch gets the same time and the same partitions."""
    rows = envelope.decode(records).withColumn("processed_timestamp", F.current_timestamp())
    return envelope.with_partitions(envelope.with_validity(rows))


def write_batch(batch: DataFrame, batch_id: int, bronze: str, dead: str) -> None:
    """One micro-batch to both sinks.

    The ids of query and batch are partitions, replaced when the batch is repeated; a query that starts anew, with a
    checkpoint of its own, counts its batches from zero again and so writes beside what others wrote.
    """
    query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
    # kept for the emptiness check and both writes, so the queue is read once per batch
    rows = batch.withColumns({"query_id": F.lit(query_id), "batch_id": F.lit(batch_id)}).persist()
    try:
        if rows.isEmpty():
            return
        write_path(rows.drop("message"), bronze, PARTITIONS)
        letters = dlq.letters(
            rows.where(~F.col("is_valid")), "message", F.col("kafka_topic"), F.col("processed_timestamp"), step="bronze_validation"
        )
        keyed = letters.withColumns(
            {"ingestion_date": F.to_date("timestamp"), "query_id": F.lit(query_id), "batch_id": F.lit(batch_id)}
        )
        write_path(keyed, dead, LETTER_PARTITIONS)
    finally:
        rows.unpersist()


def start(records: DataFrame, bronze: str, dead: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs the intake every trigger interval, or until the present input is used up."""
    writer = (
        decoded(records)
        .writeStream.outputMode("append")
        .queryName("bronze_intake")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, bronze, dead))
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()
