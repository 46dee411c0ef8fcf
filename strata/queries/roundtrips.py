"""Sources, sinks and streams over the given tables: what was written is read back and compared."""

from __future__ import annotations

import uuid
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strata import schemas
from strata.functions.columns import ts_text
from strata.operators import dlq, metadata, quality
from strata.queries import query
from strata.queries.cleaning import queue_records
from strata.queries.entity_sql import using
from strata.session import fresh_path
from strata.sinks import files as file_sinks
from strata.plans.tracking import tracked
from strata.sinks import layers, publish, retention
from strata.sources import extract, queue
from strata.streaming import counters, ingest, keyed, ledger, stateful
from strata.streaming.monitor import ProgressSamples


def _fresh(e, name: str) -> str:
    return fresh_path(e.spark, name)


# --- extracts and sinks --------------------------------------------------------------------------

_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"


@query("S8", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, fmt FROM orders, (SELECT unnest(['parquet', 'json', 'csv', 'orc']) AS fmt)")
def extracts_by_format(e):
    """The orders written in every format and read by the configured extract."""
    rows = e.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    parts = []
    for fmt in ("parquet", "json", "csv", "orc"):
        path = _fresh(e, fmt)
        writer = rows.write.format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(path)
        source = {"source_type": "s3", "location": path, "schema": _ORDERS, "format": fmt}
        parts.append(extract.extract(e.spark, source).withColumn("fmt", F.lit(fmt)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("S5", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def landed_pages(e):
    """Orders landed as API pages of a bounded number of records, each one JSON object in a file, and unwrapped."""
    record = F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    page = F.expr("o_orderkey div 4096").alias("page")
    pages = e.table("orders").groupBy(page).agg(F.collect_list(record).alias("data"))
    path = _fresh(e, "pages")
    pages.select("page", F.to_json(F.struct("data")).alias("value")).write.partitionBy("page").text(path)
    return extract.json_records(e.spark, f"{path}/*", _ORDERS)


@query("K2 K3", using("app_events") + """
    SELECT event_id, event_type, region, processing_date FROM app_events
    WHERE processing_date <> '2024-01-10' OR event_type = 'click'""")
def replaced_day(e):
    """Events written by day; one day is then written again with its clicks only."""
    rows = e.app_events().select("event_id", "event_type", "region", "processing_date")
    path = _fresh(e, "events")
    layers.write_path(rows, path, ["processing_date"], ["event_id"])
    again = rows.where("processing_date = '2024-01-10' AND event_type = 'click'")
    layers.replace_day(again, path, "processing_date", "2024-01-10", order_by=["event_id"])
    return e.spark.read.schema(rows.schema).parquet(path)


@query("K7", using("tours") + """
    SELECT '{"index":{"_index":"tours","_id":"' || tour_id || '"}}' AS line FROM tours
    UNION ALL SELECT '{"tour_id":' || tour_id || ',"region":"' || region || '"}' FROM tours""")
def bulk_documents(e):
    path = _fresh(e, "bulk")
    file_sinks.write_bulk(e.tours().select("tour_id", "region"), "tours", "tour_id", path)
    return e.spark.read.text(path).select(F.col("value").alias("line"))


@query("K9", using("tours") + """
    SELECT tour_id, name, region, price, fmt FROM tours, (SELECT unnest(['csv', 'json']) AS fmt)""")
def exported_results(e):
    rows = e.tours().select("tour_id", "name", "region", "price")
    schema = "tour_id bigint, name string, region string, price double"
    parts = []
    for fmt in ("csv", "json"):
        path = _fresh(e, fmt)
        file_sinks.export(rows, path, fmt)
        parts.append(extract.files(e.spark, path, schema, fmt).withColumn("fmt", F.lit(fmt)))
    return parts[0].unionByName(parts[1])


@query("K10 M6", using("source_executions") + """
    SELECT 'records_processed_total{job="' || source_id || '",status="' || lower(status) || '"}' AS series,
           count(*) AS samples, CAST(sum(extracted_record_count) AS DOUBLE) AS total
    FROM source_executions WHERE extracted_record_count IS NOT NULL GROUP BY ALL""")
def exposed_counters(e):
    """Job metrics as exposition text, and the counters read from its lines."""
    runs = e.source_executions().where("extracted_record_count IS NOT NULL")
    runs = runs.withColumn("failed_record_count", F.lit(0)).withColumn("ended_at", F.col("started_at").cast("timestamp"))
    text = file_sinks.exposition(metadata.job_metrics(runs).where("name = 'records_processed_total'"))
    path = _fresh(e, "metrics")
    text.select("value").write.text(path)
    line = e.spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    parts = F.split("value", " ")
    return line.groupBy(parts[0].alias("series")).agg(
        F.count("*").alias("samples"), F.sum(parts[1].cast("double")).alias("total")
    )


@query("X4", using("app_events") + """
    SELECT event_type, region, 'DeliveryError' AS error_type, 1 AS retry_count, count(*) AS letters
    FROM app_events WHERE event_id % 11 = 0 GROUP BY ALL""")
def undelivered_records(e):
    lost = e.app_events().where("event_id % 11 = 0").select(F.to_json(F.struct("event_type", "region")).alias("message"))
    path = _fresh(e, "letters")
    dlq.write(dlq.producer_failures(lost, "message", "topic_app_events", "timed out", F.current_timestamp()), path)
    field = lambda name: F.get_json_object("original_message", f"$.{name}").alias(name)
    return (
        e.spark.read.schema(schemas.DEAD_LETTER).parquet(path)
        .select(field("event_type"), field("region"), F.col("error.type").alias("error_type"), "retry_count")
        .groupBy("event_type", "region", "error_type", "retry_count").agg(F.count("*").alias("letters"))
    )


@query("Q20 Q7", using("dirty_events") + """
    SELECT CASE WHEN user_id IS NULL THEN 'dead_letter' ELSE 'kept' END AS fate, count(*) AS rows FROM dirty_events GROUP BY ALL""")
def gated_rows(e):
    """Rows without user go to the dead letters; then the gate over the expected columns fails the run."""
    events = e.dirty_events()
    path = _fresh(e, "gate")
    marked = events.select(F.when(F.col("user_id").isNull(), "dead_letter").otherwise("kept").alias("fate"))
    marked.write.parquet(path)
    try:
        quality.gate(quality.expected_columns(events, [*events.columns, "absent"], "dirty_events"))
    except quality.QualityGateError:
        return e.spark.read.schema("fate string").parquet(path).groupBy("fate").agg(F.count("*").alias("rows"))
    raise AssertionError("the gate let an absent column pass")


@query("K4", using("app_events") + """
    SELECT event_id, event_type, processing_date FROM app_events
    WHERE (processing_date = '2024-01-10' AND event_type = 'click') OR processing_date = '2024-01-11'""")
def published_days(e):
    """Two days published to a catalog table, one of them again with its clicks only."""
    table = f"strata_published_{uuid.uuid4().hex}"
    rows = e.app_events().select("event_id", "event_type", "processing_date")
    location, kept = _fresh(e, "published"), _fresh(e, "table")
    e.spark.sql(f"CREATE TABLE {table} (event_id bigint, event_type string, processing_date string) USING parquet PARTITIONED BY (processing_date)")
    try:
        for source, day in ((rows, "2024-01-10"), (rows, "2024-01-11"), (rows.where("event_type = 'click'"), "2024-01-10")):
            target = lambda name: publish.catalog_options(name, location)
            status = publish.publish_day(e.spark, lambda _: source, target, day, [table], publish.stage_folder, publish.swap_folder)
            if status.where("status = 'failed'").count():
                raise ValueError(status.first()["error"])
        e.spark.table(table).write.parquet(kept)
    finally:
        e.spark.sql(f"DROP TABLE {table}")
    return e.spark.read.schema("event_id bigint, event_type string, processing_date string").parquet(kept)


@query("P15", """
    SELECT CASE WHEN m < DATE '2001-01-01' - INTERVAL 365 DAY THEN 'archived' ELSE 'active' END AS state, count(*) AS bookings
    FROM (SELECT date_trunc('month', o_orderdate)::DATE AS m FROM orders) WHERE m >= DATE '2001-01-01' - INTERVAL 730 DAY GROUP BY ALL""")
def retained_bookings(e):
    """Bookings in a folder per month; what is older than a year moves to the archive, older than two years it goes."""
    path, archive = _fresh(e, "bookings"), _fresh(e, "archive")
    month = F.trunc(F.to_date("created_at"), "month").cast("string")
    layers.write_path(e.bookings().select("booking_id", month.alias("month")), path, ["month"])
    retention.apply(e.spark, path, archive, "month", date(2001, 1, 1), 365, 730)
    read = lambda folder, state: e.spark.read.schema("booking_id bigint, month string").parquet(folder).select(F.lit(state).alias("state"))
    return read(path, "active").unionByName(read(archive, "archived")).groupBy("state").agg(F.count("*").alias("bookings"))


@query("T1", using("app_events") + """
    SELECT region, processing_date, count(*) AS events FROM app_events
    WHERE event_type IN ('click', 'booking') GROUP BY ALL""")
def appended_rows(e):
    """Clicks written by day, then bookings added to the same days."""
    rows = e.app_events().select("event_id", "event_type", "region", "processing_date")
    path = _fresh(e, "appended")
    layers.write_path(rows.where("event_type = 'click'"), path, ["processing_date"])
    layers.append_rows(rows.where("event_type = 'booking'"), path, ["processing_date"])
    back = e.spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("region", "processing_date").agg(F.count("*").alias("events"))


@query("K5 K6", using("app_events") + """
    SELECT 'topic_' || event_type AS topic, region, count(*) AS messages, CAST(sum(event_id) AS BIGINT) AS ids FROM app_events GROUP BY ALL""")
def topic_messages(e):
    """Events as enveloped messages in the files of their topics, read back."""
    events = e.app_events().select("event_id", "event_type", "region")
    path = _fresh(e, "topics")
    sent = publish.records(events, "topic_any", "src", "Events", F.lit("2024-01-01T00:00:00"))
    topic = F.concat(F.lit("topic_"), F.get_json_object("value", "$.data.event_type"))
    publish.to_files(sent.withColumn("topic", topic), path)
    back = e.spark.read.schema("value string, topic string").text(path)
    field = lambda name: F.get_json_object("value", f"$.data.{name}")
    return back.groupBy("topic", field("region").alias("region")).agg(
        F.count("*").alias("messages"), F.sum(field("event_id").cast("bigint")).alias("ids")
    )


@query("M4", using("pipeline_runs") + """
    SELECT dag_id AS pipeline, count(*) AS extracted, count(*) FILTER (WHERE status <> 'FAILED') AS validated,
           CASE WHEN dag_id = '1-URGENT' THEN 'FAILED' ELSE 'SUCCESS' END AS status
    FROM pipeline_runs GROUP BY dag_id""")
def tracked_runs(e):
    """A tracked run per pipeline that reports what it read; one of them fails at its end and is on record all the same."""
    audit = _fresh(e, "audit")
    counted = e.pipeline_runs().groupBy("dag_id").agg(
        F.count("*").alias("extracted"), F.count(F.when(F.col("status") != "FAILED", 1)).alias("validated")
    )
    # One row per pipeline.
    for row in counted.collect():
        try:
            with tracked(e.spark, audit, row.dag_id, row.dag_id) as run:
                run.source(row.dag_id, row.extracted, row.validated)
                if row.dag_id == "1-URGENT":
                    raise RuntimeError("stopped")
        except RuntimeError:
            continue
    runs = e.spark.read.schema(schemas.PIPELINE_RUN).parquet(f"{audit}/pipeline_runs").select(F.col("run_id").alias("pipeline_run_id"), "status")
    sources = e.spark.read.schema(schemas.SOURCE_EXECUTION).parquet(f"{audit}/source_executions")
    return sources.join(runs.withColumnRenamed("status", "run_status"), "pipeline_run_id").select(
        F.col("source_id").alias("pipeline"), F.col("extracted_record_count").alias("extracted"),
        F.col("validated_record_count").alias("validated"), F.col("run_status").alias("status"),
    )


@query("M1 M7", using("app_events") + """
    SELECT 'events_' || lower(region) AS dataset, 'silver' AS layer, count(*) FILTER (WHERE processing_date = '2024-01-12') AS rows,
           'success' AS status, 'parquet' AS format FROM app_events WHERE processing_date IN ('2024-01-11', '2024-01-12') GROUP BY region""")
def catalogued_loads(e):
    """A lineage event per load of a region's table on two days; the catalogue names the last one."""
    days = e.app_events().where("processing_date IN ('2024-01-11', '2024-01-12')").groupBy("region", "processing_date").count()
    events = [
        # One row per region and day.
        metadata.lineage_event(
            e.spark, "transformation", datetime.fromisoformat(r.processing_date), job_name="load", row_count_in=r["count"], row_count_out=r["count"],
            destination={"layer": "silver", "table": f"events_{r.region.lower()}"},
        )
        for r in days.collect()
    ]
    path = _fresh(e, "lineage")
    reduce(DataFrame.unionByName, events).coalesce(1).write.parquet(path)
    return metadata.dataset_catalog(e.spark.read.schema(schemas.LINEAGE_EVENT).parquet(path)).drop("last_sync")


# --- streams -------------------------------------------------------------------------------------


def _landed(e, rows: DataFrame, path: str, triggers: int) -> int:
    """Writes the rows as files of one task each, as many as shuffles have partitions; how many make one trigger."""
    each = -(-int(e.spark.conf.get("spark.sql.shuffle.partitions")) // triggers)
    rows.repartition(each * triggers).write.parquet(path)
    return each


def _stream(e, rows: DataFrame, files: int = 4) -> DataFrame:
    """The rows as a stream of files, one per trigger."""
    path = _fresh(e, "stream")
    rows.repartition(files).write.parquet(path)
    return e.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _events(e) -> DataFrame:
    return e.table("events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("timestamp"))


def _written(e, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All output of a stream over its present input; every batch is appended as it comes, with its number."""
    path = _fresh(e, "out")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

    query = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", _fresh(e, "checkpoint"))
        .foreachBatch(write).start()
    )
    query.awaitTermination()
    return e.spark.read.schema(StructType([*stream.schema, StructField("_batch", IntegerType())])).parquet(path)


@query("K1 ST1 ST2 ST3 P8", """
    SELECT event_type || '_events' AS source_type, count(*) AS rows,
           count(*) FILTER (WHERE event_id % 19 = 0 OR event_id % 31 = 0) AS letters
    FROM events GROUP BY ALL""")
def stream_intake(e):
    """Queue records to bronze and dead letters by the stream, read back."""
    landing, bronze, dead = (_fresh(e, n) for n in ("queue", "bronze", "dead"))
    records = queue_records(e).select(
        F.lit(None).cast("binary").alias("key"), "value", "topic", "partition", "offset", "timestamp", F.lit(0).alias("timestampType")
    )
    each = _landed(e, records, landing, 2)
    ingest.start(queue.file_stream(e.spark, landing, files_per_trigger=each), bronze, dead, _fresh(e, "checkpoint"), once=True).awaitTermination()
    rows = e.spark.read.schema(schemas.BRONZE).parquet(bronze).groupBy("source_type").agg(F.count("*").alias("rows"))
    letters = (
        e.spark.read.schema(schemas.DEAD_LETTER).parquet(dead)
        .groupBy(F.regexp_replace("source", "^topic_", "").alias("source_type")).agg(F.count("*").alias("letters"))
    )
    return rows.join(letters, "source_type")


@query("ST5", "SELECT event_type, count(*) AS count FROM events GROUP BY ALL")
def stream_counters(e):
    counts = _written(e, stateful.running_counts(_stream(e, _events(e)), "event_type"), "update")
    return counts.groupBy("event_type").agg(F.max("count").alias("count"))


@query("ST6", using("dirty_events") + "SELECT DISTINCT event_id FROM dirty_events")
def stream_dedup(e):
    """Repeated events carry equal times, so one of each id stays."""
    rows = e.dirty_events().select("event_id", F.col("timestamp").cast("timestamp").alias("timestamp"))
    # late by up to all of the table's days: files come in any order
    return _written(e, stateful.dedup_within(_stream(e, rows), ["event_id"], 3600, lateness="60 days")).select("event_id")


@query("ST7", """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS events,
           count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL""")
def stream_hours(e):
    hours = _written(e, stateful.tumbling_counts(_stream(e, _events(e)), lateness="60 days"), "update")
    return hours.groupBy(ts_text("window_start").alias("window_start")).agg(
        F.max("events").alias("events"), F.max("errors").alias("errors")
    )


@query("ST9 W8", """
    SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (
        SELECT user_id, s, count(*) AS n FROM (
            SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
                SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
                FROM events)) GROUP BY ALL) GROUP BY user_id""")
def stream_sessions(e):
    """Sessions of the complete output, in which the last batch holds all of them."""
    out = _written(e, stateful.session_counts(_stream(e, _events(e)), "user_id", lateness="60 days"), "complete")
    last = out.agg(F.max("_batch")).scalar()
    final = out.where(F.col("_batch") == last)
    return final.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("ST10", """
    SELECT CASE WHEN ts > TIMESTAMP '2024-01-15' + INTERVAL 300 SECOND THEN 'future'
                WHEN ts < TIMESTAMP '2024-01-15' - INTERVAL 86400 SECOND THEN 'past' ELSE 'ok' END AS state, count(*) AS events
    FROM events GROUP BY ALL""")
def stream_time_split(e):
    """Every row ends in one of the two outputs."""
    accepted, refused = stateful.split_by_time(_stream(e, _events(e)), as_of=F.lit("2024-01-15").cast("timestamp"))
    good = _written(e, accepted).select(F.lit("ok").alias("state"))
    bad = _written(e, refused).select(F.col("time_state").alias("state"))
    return good.unionByName(bad).groupBy("state").agg(F.count("*").alias("events"))


@query("ST11 W7", using("changes") + """
    SELECT key, arg_max(op, (ts_ms, "offset")) AS op FROM changes GROUP BY key""")
def stream_latest_changes(e):
    changes = e.changes().select("key", "op", "ts_ms", "offset")
    out = _written(e, stateful.latest_changes(_stream(e, changes), "key", []), "update")
    return out.groupBy("key").agg(F.max_by("op", F.struct("ts_ms", "offset")).alias("op"))


@query("ST8 V1", using("offsets", d="""
        SELECT *, CASE WHEN value < p THEN value ELSE value - p END AS delta FROM (
            SELECT *, lag(value) OVER (PARTITION BY topic, instance ORDER BY ts) AS p FROM offsets)""") + f"""
    SELECT topic, strftime(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') AS window_start,
           round(coalesce(sum(delta), 0) / 300, 9) AS rate FROM d GROUP BY ALL""")
def stream_rates(e):
    """Counter samples in any order, every sample once; the rates are those of the samples in order."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = e.spark.conf.get(key)
    counters.prepare(e.spark)
    try:
        stream = _stream(e, e.offsets().select("topic", "instance", "ts", "value"), 3)
        grown = _written(e, counters.counter_growth(stream, ["topic", "instance"], lateness="60 days"))
    finally:
        e.spark.conf.set(key, before)
    rates = counters.window_rates(grown, ["topic"])
    return rates.withColumns({"window_start": ts_text("window_start"), "rate": F.round("rate", 9)})


@query("J7 ST11", using("changes") + """
    SELECT key, arg_max(balance, (ts_ms, "offset")) AS balance FROM changes
    GROUP BY key HAVING arg_max(op, (ts_ms, "offset")) <> 'd'""")
def stream_keyed_table(e):
    """Changes that come in any order, applied batch by batch to a table in buckets."""
    changes = e.changes().select("key", "op", "ts_ms", "offset", "balance")
    path = _fresh(e, "keyed")
    keyed.start(_stream(e, changes, 3), path, _fresh(e, "checkpoint"), "key", ["balance"], 16, once=True).awaitTermination()
    return keyed.current(e.spark, path, "key bigint, balance double")


@query("S1 ST1", """
    WITH read AS (
      SELECT 'topic_' || (event_id % 5) AS topic, CAST(event_id // 5 % 3 AS INT) AS partition, event_id // 15 AS o FROM events
    ), ends AS (SELECT topic, partition, max(o) FILTER (WHERE o % 50 <> 17) AS last_read FROM read GROUP BY ALL)
    SELECT topic, partition, CASE WHEN o % 50 = 17 THEN 'lost' ELSE 'repeated' END AS fault, o AS first, o AS last
    FROM read JOIN ends USING (topic, partition) WHERE (o % 50 = 17 AND o < last_read) OR (o % 70 = 40 AND o % 50 <> 17)""")
def stream_offset_faults(e):
    """Records read in three batches, some of them lost before and some read twice: the ledger names both."""
    id_ = F.col("event_id")
    records = e.table("events").select(
        F.concat(F.lit("topic_"), id_ % 5).alias("topic"), (F.expr("event_id div 5") % 3).cast("int").alias("partition"),
        F.expr("event_id div 15").alias("offset"),
    ).where("offset % 50 <> 17")
    copies = F.when(F.col("offset") % 70 == 40, 2).otherwise(1)
    path = _fresh(e, "ledger")
    stream = _stream(e, records.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy"), 3)
    query = (
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", _fresh(e, "checkpoint"))
        .foreachBatch(lambda batch, number: ledger.record(batch, number, path)).start()
    )
    query.awaitTermination()
    return ledger.faults(ledger.read(e.spark, path))


@query("ST4", "SELECT 'stream_input_rows' AS name, CAST(count(*) AS DOUBLE) AS total FROM events")
def stream_progress(e):
    """The rows of a stream as its progress samples count them."""
    log = ProgressSamples(e.spark, _fresh(e, "metrics"))
    e.spark.streams.addListener(log)
    try:
        _written(e, _stream(e, _events(e)))
        # Progress events come after their batches; removing the listener does not wait for them.
        e.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        e.spark.streams.removeListener(log)
    return log.samples().where("name = 'stream_input_rows'").groupBy("name").agg(F.sum("value").alias("total"))
