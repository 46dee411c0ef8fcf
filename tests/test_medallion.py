"""Queue to gold over real folders."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strata import schemas
from strata.operators import quality
from strata.plans import medallion
from strata.sources import queue
from strata.streaming import ingest


def event(i, day, **change):
    data = {
        "event_id": f"e{i}", "user_id": i % 4 + 1, "event_type": " Booking" if i % 2 else "click",
        "timestamp": f"{day}T0{i % 9}:00:00", "amount": i * 10.0, "region": " vn ", "source": "app",
    } | change
    return {"source_id": "s", "source_name": "S", "ingestion_timestamp": f"{day}T10:00:00", "data": data}


def frame(spark, rows):
    schema = ", ".join(f"{n} {t}" for n, t in medallion.EVENT_FIELDS.items())
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def test_stream_to_gold(spark, root):
    messages = [event(i, "2024-01-01") for i in range(10)]
    messages += [event(3, "2024-01-01"), event(20, "2024-01-01", user_id=None), event(21, "2024-01-01", amount=-5)]
    rows = [(None, json.dumps(m).encode(), "topic_app_events", 0, i, datetime(2024, 1, 1), 0) for i, m in enumerate(messages)]
    spark.createDataFrame(rows, schemas.QUEUE_RECORD).write.parquet(f"{root}/in")
    ingest.start(queue.file_stream(spark, f"{root}/in"), f"{root}/bronze", f"{root}/dead", f"{root}/cp", once=True).awaitTermination()
    today = str(spark.read.schema(schemas.BRONZE).parquet(f"{root}/bronze").first().ingestion_date)
    events = medallion.bronze_events(spark, f"{root}/bronze", today)
    counts = medallion.bronze_to_silver(events, f"{root}/silver", today)
    assert counts["records_before"] == 13 and counts["records_after"] == 10
    silver = spark.read.parquet(f"{root}/silver/{medallion.SILVER}")
    assert {r.region for r in silver.collect()} == {"VN"} and {r.event_type for r in silver.collect()} == {"booking", "click"}
    silver = silver.withColumn("processing_date", F.lit(today))
    gold = medallion.silver_to_gold(spark, silver, f"{root}/gold", today)
    metrics = gold["booking_metrics"].first()
    assert (metrics.total_bookings, metrics.total_revenue, metrics.unique_users) == (5, 250.0, 2)
    assert gold["daily_summary"].first().total_events == 10
    assert gold["tourism_analytics"].first().booking == 5 and gold["tourism_analytics"].first().rating == 0


def test_rerun_and_next_day_keep_other_days(spark, root):
    def day(date, n):
        rows = [(f"{date}-{i}", i, "booking", datetime.fromisoformat(date), 10.0, "vn", "app") for i in range(n)]
        medallion.bronze_to_silver(frame(spark, rows), f"{root}/silver", date)
        silver = spark.read.schema(frame(spark, []).withColumn("processing_date", F.lit("")).schema).parquet(f"{root}/silver/{medallion.SILVER}")
        return medallion.silver_to_gold(spark, silver, f"{root}/gold", date)

    day("2024-01-01", 3)
    day("2024-01-02", 5)
    gold = day("2024-01-01", 4)
    totals = {str(r.processing_date): r.total_events for r in gold["daily_summary"].collect()}
    assert totals == {"2024-01-01": 4, "2024-01-02": 5}
    gold = day("2024-01-02", 5)
    of_day = gold["user_360_view"].where("processing_date = '2024-01-02' AND user_id = 0").first()
    assert of_day.total_events == 2 and of_day.visited_regions[0].visits == 2


def test_backfill_reaches_the_totals_of_later_days(spark, root):
    def day(n, rows):
        date = f"2024-01-0{n}"
        rows = [(f"{n}-{i}", 1, "booking", datetime.fromisoformat(date), 10.0, "vn", "app") for i in range(rows)]
        silver = frame(spark, rows).withColumn("processing_date", F.lit(date))
        gold = medallion.silver_to_gold(spark, silver, f"{root}/gold", date)
        views = (gold["user_360_view"], gold["recommendation_features"])
        seen = [{str(r.processing_date): r[c] for r in v.collect()} for v, c in zip(views, ("total_events", "total_interactions"))]
        assert seen[0] == seen[1]
        return {int(d[-1]): events for d, events in seen[0].items()}

    day(1, 1)
    day(2, 1)
    assert day(4, 1) == {1: 1, 2: 2, 4: 3}
    assert day(2, 3) == {1: 1, 2: 4, 4: 5}
    assert day(3, 2) == {1: 1, 2: 4, 3: 6, 4: 7}
    assert day(5, 1) == {1: 1, 2: 4, 3: 6, 4: 7, 5: 8}


def test_governed_run(spark, root):
    rows = [("e1", 1, "click", datetime(2024, 1, 1), 1.0, "vn", "app")] * 2 + [
        ("e2", None, "click", datetime(2024, 1, 1), 1.0, "vn", "app"),
        ("e3", 3, "click", datetime(2024, 1, 1), 1.0, "vn", "app"),
    ]
    args = (f"{root}/silver", f"{root}/dead", f"{root}/audit", "2024-01-01")
    results = medallion.governed_bronze_to_silver(spark, frame(spark, rows), *args, list(medallion.EVENT_FIELDS))
    assert {r.check: r.status for r in results.collect()}["duplicate_rows"] == "FAILED"
    silver = spark.read.parquet(f"{root}/silver/{medallion.SILVER}")
    assert sorted(r.event_id for r in silver.collect()) == ["e1", "e3"]
    assert silver.first().data_quality_score == 60.0
    dead = spark.read.parquet(f"{root}/dead").first()
    assert json.loads(dead.original_message)["event_id"] == "e2" and dead.metadata == {"processing_step": "null_user_id"}
    lineage = spark.read.parquet(f"{root}/audit/lineage").where("event_type = 'transformation'").first()
    assert (lineage.row_count_in, lineage.row_count_out, lineage.data_loss_percentage) == (4, 2, 50.0)
    metrics = {r.name: r.value for r in spark.read.parquet(f"{root}/audit/metrics").collect()}
    assert metrics["job_success_rate_percent"] == 50.0 and metrics["data_quality_score"] == 60.0


def test_governed_run_fails_after_diverting(spark, root):
    df = frame(spark, [("e1", 1, "click", datetime(2024, 1, 1), 1.0, "vn", "app")])
    with pytest.raises(quality.QualityGateError):
        medallion.governed_bronze_to_silver(
            spark, df, f"{root}/silver", f"{root}/dead", f"{root}/audit", "2024-01-01", ["event_id", "ingestion_time"]
        )
    dead = spark.read.parquet(f"{root}/dead").first()
    assert dead.queue == "dlq_schema_validation_errors" and "missing:ingestion_time" in dead.error.message


def test_runs_and_executions_are_recorded(spark, root):
    from strata.operators import metadata
    from strata.plans.tracking import tracked

    with tracked(spark, f"{root}/audit", "medallion", "good") as run:
        run.source("app_events", 10, 8)
    with pytest.raises(RuntimeError):
        with tracked(spark, f"{root}/audit", "medallion", "bad"):
            raise RuntimeError("lost")
    runs = spark.read.schema(schemas.PIPELINE_RUN).parquet(f"{root}/audit/pipeline_runs")
    assert {r.pipeline_name: (r.status, r.error_message) for r in runs.collect()} == {
        "good": ("SUCCESS", None), "bad": ("FAILED", "RuntimeError: lost"),
    }
    done = spark.read.schema(schemas.SOURCE_EXECUTION).parquet(f"{root}/audit/source_executions")
    row = done.first()
    assert (row.status, row.failed_record_count, row.quality_score) == ("PARTIAL", 2, 80.0)
    sources = spark.createDataFrame([("app_events",), ("idle",)], "source_id string")
    status = {r.source_id: r.total_executions for r in metadata.source_status(sources, done).collect()}
    assert status == {"app_events": 1, "idle": 0}
    samples = {r.name: r.value for r in metadata.job_metrics(done).collect()}
    assert samples["records_failed_total"] == 2.0 and samples["job_success_rate_percent"] == 80.0
