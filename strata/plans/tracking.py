"""Run records around a job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import SparkSession

from strata.operators import metadata


class Run:
    """A run in progress; sources report their counts to it."""

    def __init__(self, spark: SparkSession, audit: str, run_id: str):
        self.spark, self.audit, self.run_id = spark, audit, run_id
        self.started = datetime.now()

    def source(self, source_id: str, extracted: int, validated: int) -> None:
        row = metadata.execution_row(
            self.spark, self.run_id, source_id, self.started, datetime.now(), extracted, validated
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.audit}/source_executions")


@contextmanager
def tracked(spark: SparkSession, audit: str, dag_id: str, pipeline: str, run_id: str | None = None) -> Iterator[Run]:
    """Appends one row to ``pipeline_runs`` under ``audit``, also when the job fails."""
    run = Run(spark, audit, run_id or uuid.uuid4().hex)
    error = None
    try:
        yield run
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
        raise
    finally:
        row = metadata.run_row(spark, run.run_id, dag_id, pipeline, run.started, datetime.now(), error)
        row.coalesce(1).write.mode("append").parquet(f"{audit}/pipeline_runs")
