"""Progress of running queries as metric samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from strata import schemas


class ProgressSamples(StreamingQueryListener):
    """Appends the samples of every batch of all queries of the session to a metrics table.

    One batch adds four numbers; nothing is kept in the driver, and row data never passes here.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        labels = {"query": p.name or str(p.id), "batch": str(p.batchId)}
        numbers = {
            "stream_input_rows": p.numInputRows,
            "stream_input_rows_per_second": p.inputRowsPerSecond,
            "stream_processed_rows_per_second": p.processedRowsPerSecond,
            "stream_batch_duration_ms": p.batchDuration,
            "stream_rows_dropped_by_watermark": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
        }
        rows = [(n, "gauge", float(v or 0), labels, n.replace("_", " "), p.batchId) for n, v in numbers.items()]
        self.spark.createDataFrame(rows, schemas.METRIC_SAMPLE).coalesce(1).write.mode("append").parquet(self.path)

    def samples(self) -> DataFrame:
        return self.spark.read.schema(schemas.METRIC_SAMPLE).parquet(self.path)
