"""Executions, runs, queue summaries, lineage and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import envelope
from strata.functions.columns import day_text
from strata.operators import metadata
from strata.queries import query
from strata.queries.cleaning import queue_records
from strata.queries.entity_sql import using


@query("J1 A12", using("data_sources", "source_executions") + """
    SELECT d.source_id, d.source_name, d.source_type, d.is_enabled, count(DISTINCT e.execution_id) AS total_executions,
           count(*) FILTER (WHERE e.status = 'SUCCESS') AS successful_executions,
           count(*) FILTER (WHERE e.status = 'FAILED') AS failed_executions,
           strftime(max(e.started_at), '%Y-%m-%d') AS last_execution_time, coalesce(avg(e.quality_score), -1) AS avg_quality_score
    FROM data_sources d LEFT JOIN source_executions e ON d.source_id = e.source_id GROUP BY ALL""")
def source_status(e):
    status = metadata.source_status(e.data_sources(), e.source_executions())
    return status.withColumn("last_execution_time", day_text("last_execution_time")).na.fill(-1.0, ["avg_quality_score"])


@query("L3 L1", using("source_executions") + """
    SELECT execution_id, source_id, status, quality_score, extracted_record_count, validated_record_count,
           strftime(started_at, '%Y-%m-%d') AS started_at, duration_seconds FROM source_executions
    WHERE started_at >= TIMESTAMP '2000-03-01' - INTERVAL 7 DAY AND started_at < TIMESTAMP '2000-03-01'
    ORDER BY started_at DESC""")
def recent_executions(e):
    rows = metadata.recent_executions(e.source_executions(), "2000-03-01")
    return rows.withColumn("started_at", day_text("started_at"))


@query("A11", using("pipeline_runs") + """
    SELECT strftime(started_at, '%Y-%m-%d') AS execution_date, dag_id, count(*) AS total_runs,
           count(*) FILTER (WHERE status = 'SUCCESS') AS successful, count(*) FILTER (WHERE status = 'FAILED') AS failed,
           avg(duration_seconds) AS avg_duration_seconds, max(duration_seconds) AS max_duration_seconds,
           min(duration_seconds) AS min_duration_seconds FROM pipeline_runs GROUP BY ALL""")
def pipeline_summary(e):
    return metadata.pipeline_summary(e.pipeline_runs()).withColumn("execution_date", day_text("execution_date"))


@query("A29", using("source_executions") + """
    SELECT count(*) AS sources, count(*) FILTER (WHERE status = 'SUCCESS') AS successful,
           count(*) FILTER (WHERE status <> 'SUCCESS') AS failed, CAST(sum(extracted_record_count) AS BIGINT) AS records
    FROM source_executions""")
def ingestion_summary(e):
    return metadata.ingestion_summary(
        e.source_executions().select(F.lower("status").alias("status"), F.col("extracted_record_count").alias("record_count"))
    )


def _bronze(e):
    return envelope.with_validity(envelope.decode(queue_records(e)))


@query("A13", """
    SELECT CASE WHEN event_id % 19 <> 0 THEN 'src_' || (user_id % 20) END AS source_id, 'App events' AS source_name,
           'topic_' || event_type || '_events' AS kafka_topic, strftime(ts, '%Y-%m-%d') AS processed_date,
           CAST(hour(ts) AS INT) AS batch_id, count(*) AS event_count,
           avg(CASE WHEN event_id % 19 <> 0 AND event_id % 31 <> 0 THEN 100 ELSE 0 END) AS avg_quality_score,
           count(*) FILTER (WHERE event_id % 19 <> 0 AND event_id % 31 <> 0) AS valid_events,
           count(*) FILTER (WHERE NOT (event_id % 19 <> 0 AND event_id % 31 <> 0)) AS invalid_events
    FROM events GROUP BY ALL""")
def bronze_summary(e):
    rows = metadata.bronze_summary(_bronze(e), F.hour("kafka_timestamp"))
    return rows.withColumn("processed_date", day_text("processed_date"))


@query("A14", """
    SELECT 'topic_' || event_type || '_events' AS kafka_topic, CAST(user_id % 3 AS INT) AS "partition", count(*) AS message_count,
           max(event_id) AS message_offset, max((event_id % 1000) + 1) AS max_latency_ms, avg((event_id % 1000) + 1) AS avg_latency_ms,
           count(*) FILTER (WHERE event_id % 19 <> 0 AND event_id % 31 <> 0) AS valid_messages,
           count(*) FILTER (WHERE NOT (event_id % 19 <> 0 AND event_id % 31 <> 0)) AS invalid_messages
    FROM events GROUP BY ALL""")
def queue_metrics(e):
    late = F.timestamp_millis(F.unix_millis("kafka_timestamp") + F.col("offset") % 1000 + 1)
    return metadata.queue_metrics(_bronze(e).withColumn("processed_timestamp", late))


def lineage_events(e):
    """One transformation per supplier: its nation's table feeds its region's table."""
    geo = e.table("supplier").join(e.geography(), F.col("s_nationkey") == F.col("n_nationkey"))
    return geo.select(
        F.when(F.col("s_suppkey") % 4 == 0, "ingestion").otherwise("transformation").alias("event_type"),
        F.struct(F.lit("bronze").alias("layer"), F.array("n_name", F.concat(F.lit("ref_"), "r_name")).alias("tables")).alias("source"),
        F.struct(F.lit("silver").alias("layer"), F.col("r_name").alias("table")).alias("destination"),
        F.lit("bronze_to_silver").alias("job_name"),
    )


_GEO = "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_EDGES = f"""
    WITH g AS (SELECT n_name, r_name FROM {_GEO} WHERE s_suppkey % 4 <> 0),
    x AS (SELECT 'bronze' AS from_layer, n_name AS from_table, 'silver' AS to_layer, r_name AS to_table, 'bronze_to_silver' AS job_name FROM g
          UNION SELECT 'bronze', 'ref_' || r_name, 'silver', r_name, 'bronze_to_silver' FROM g) """


@query("A30", "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'ingestion' ELSE 'transformation' END AS event_type, count(*) AS events FROM supplier GROUP BY ALL")
def lineage_counts(e):
    return metadata.lineage_counts(lineage_events(e))


@query("M2", _EDGES + "SELECT * FROM x")
def lineage_edges(e):
    return metadata.lineage_edges(lineage_events(e))


_ONWARD = """, y AS (
        SELECT from_layer, from_table, to_layer, to_table FROM x
        UNION SELECT 'silver', to_table, 'gold', 'summary_' || (length(to_table) % 3) FROM x
        UNION SELECT 'gold', 'summary_' || (length(to_table) % 3), 'serving', 'report' FROM x),
    reach AS (SELECT *, 1 AS depth FROM y UNION
        SELECT r.from_layer, r.from_table, y.to_layer, y.to_table, depth + 1 FROM reach r
        JOIN y ON y.from_layer = r.to_layer AND y.from_table = r.to_table)
    SELECT from_layer, from_table, to_layer, to_table, min(depth) AS depth FROM reach GROUP BY ALL"""


@query("M3 J8 M2", _EDGES.replace("WITH g", "WITH RECURSIVE g") + _ONWARD)
def lineage_closure(e):
    """All that each table of the transformations feeds, over three layers."""
    edges = metadata.lineage_edges(lineage_events(e)).drop("job_name")
    gold = F.concat(F.lit("summary_"), F.length("to_table") % 3)
    onward = edges.select(
        F.explode(F.array(
            F.struct(F.lit("silver").alias("from_layer"), F.col("to_table").alias("from_table"), F.lit("gold").alias("to_layer"), gold.alias("to_table")),
            F.struct(F.lit("gold").alias("from_layer"), gold.alias("from_table"), F.lit("serving").alias("to_layer"), F.lit("report").alias("to_table")),
        )).alias("edge")
    ).select("edge.*").distinct()
    return metadata.lineage_closure(edges.unionByName(onward))


@query("M2", _EDGES + 'SELECT from_layer AS layer, from_table AS "table" FROM x UNION SELECT to_layer, to_table FROM x')
def lineage_graph_nodes(e):
    return metadata.lineage_graph_nodes(metadata.lineage_edges(lineage_events(e)))


def _recursive(base: str, step: str, columns: str) -> str:
    clause = using("lineage_nodes").replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{clause}, c AS ({base} UNION ALL {step}) SELECT {columns} FROM c"


@query("J8 M3", _recursive(
    "SELECT id, parent_id AS ancestor_id, 1 AS depth FROM lineage_nodes WHERE parent_id IS NOT NULL",
    "SELECT c.id, n.parent_id, c.depth + 1 FROM c JOIN lineage_nodes n ON c.ancestor_id = n.id WHERE n.parent_id IS NOT NULL",
    "id, ancestor_id, depth"))
def lineage_upstream(e):
    return metadata.ancestors(e.lineage_nodes())


@query("J8 M3", _recursive(
    "SELECT id, 1 AS depth FROM lineage_nodes WHERE parent_id = 1002",
    "SELECT n.id, c.depth + 1 FROM c JOIN lineage_nodes n ON n.parent_id = c.id", "id, depth"))
def lineage_downstream(e):
    return metadata.downstream(e.lineage_nodes(), 1002)


@query("M5", """
    WITH b AS (SELECT s_suppkey AS id, s_name AS name, CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) AS balance FROM supplier WHERE s_acctbal < 9000),
    a AS (SELECT s_suppkey AS id, s_name AS name,
                 CAST(CAST(round(s_acctbal) AS BIGINT) + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS balance FROM supplier WHERE s_acctbal > 500)
    SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'CREATED' WHEN a.id IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change_type,
           CASE WHEN b.balance IS DISTINCT FROM a.balance THEN coalesce(b.balance, '-') || '>' || coalesce(a.balance, '-') END AS balance_change
    FROM b FULL JOIN a ON b.id = a.id WHERE b.name IS DISTINCT FROM a.name OR b.balance IS DISTINCT FROM a.balance""")
def config_audit(e):
    rounded = F.round("s_acctbal").cast("bigint")
    select = lambda df, value: df.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), value.alias("balance"))
    supplier = e.table("supplier")
    before = select(supplier.where("s_acctbal < 9000"), rounded)
    after = select(supplier.where("s_acctbal > 500"), rounded + F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0))
    side = lambda f: F.coalesce(F.col(f"changed_fields.balance.{f}"), F.lit("-"))
    text = F.when(
        F.map_contains_key("changed_fields", F.lit("balance")),
        F.concat(side("old_value"), F.lit(">"), side("new_value")),
    )
    return metadata.config_changes(before, after, "id").select("id", "change_type", text.alias("balance_change"))
