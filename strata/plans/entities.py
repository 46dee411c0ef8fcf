"""Business entities as views over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.columns import day_text
from strata.sources.tables import table

# Stored event types that the business layer calls by another name.
EVENT_NAMES = {"purchase": "booking", "view": "search"}
# Return flag -> tour event, order status -> run / execution status.
TOUR_EVENT = {"N": "booking", "A": "click", "R": "view"}
EXECUTION_STATUS = {"F": "FAILED", "O": "SUCCESS", "P": "PARTIAL"}
RUN_STATUS = {"F": "FAILED", "O": "SUCCESS", "P": "RUNNING"}
# Event type -> log level, and -> change-data operation.
LOG_LEVEL = {"error": "ERROR", "signup": "WARN", "click": "DEBUG"}
CHANGE_OP = {"signup": "c", "view": "r", "purchase": "u", "click": "u", "error": "d"}
QUEUE_TOPIC = {"error": "dlq_processing_errors", "signup": "dlq_schema_validation_errors"}
JOBS = ["kafka-1", "kafka-2", "postgres-1", "minio", "api"]
LATENCY_BOUNDS = [250.0, 500.0, 1000.0, 2500.0, 5000.0, float("inf")]
COUNTER_RESET = "2024-01-15"
DEVICES = ["mobile", "tablet", "desktop"]


def recode(column, names: dict[str, str], default=None):
    """Renamed values; others become ``default``, or null without one."""
    out = None
    for old, new in names.items():
        out = F.when(column == old, new) if out is None else out.when(column == old, new)
    return out if default is None else out.otherwise(default)


class Entities:
    """Lazy views; nothing is read until a query runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def geography(self) -> DataFrame:
        """Nations with their region; 25 rows by definition of the tables."""
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", "n_name", "r_name"
        )

    def customers(self) -> DataFrame:
        return self.table("customer").join(
            self.geography(), F.col("c_nationkey") == F.col("n_nationkey")
        )

    def app_events(self) -> DataFrame:
        events = self.table("events")
        return events.join(self.customers(), events.user_id == F.col("c_custkey")).select(
            "event_id",
            "user_id",
            recode(F.col("event_type"), EVENT_NAMES, F.col("event_type")).alias("event_type"),
            F.col("ts").alias("timestamp"),
            F.col("value").alias("amount"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("country"),
            F.col("c_mktsegment").alias("source"),
            day_text("ts").alias("processing_date"),
        )

    def dirty_events(self) -> DataFrame:
        """App events with defects that depend on the id only: null user, padded upper-case
        type, negative amount, repeated rows."""
        e = self.app_events()
        mod = lambda n: F.col("event_id") % n == 0
        return e.select(
            "event_id",
            F.when(~mod(17), F.col("user_id")).alias("user_id"),
            F.when(mod(5), F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
            .otherwise(F.col("event_type"))
            .alias("event_type"),
            "timestamp",
            F.when(mod(29), -F.col("amount")).otherwise(F.col("amount")).alias("amount"),
            F.lower("region").alias("region"),
            F.explode(F.when(mod(23), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        ).drop("copy")

    def tours(self) -> DataFrame:
        part, region = self.table("part"), self.table("region")
        return part.join(region, F.col("r_regionkey") == F.col("p_partkey") % 5).select(
            F.col("p_partkey").alias("tour_id"),
            F.col("p_name").alias("name"),
            F.col("r_name").alias("region"),
            F.col("p_retailprice").alias("price"),
            (3.5 + (F.col("p_partkey") % 16) / 10.0).cast("double").alias("rating"),
            F.split("p_name", " ").alias("tags"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
        )

    def tour_events(self, only: str | None = None) -> DataFrame:
        """All tour events, or those of one type; the type is then filtered by its stored flag,
        which reaches the scan."""
        lineitem, orders, region = (self.table(t) for t in ("lineitem", "orders", "region"))
        if only is not None:
            flags = [flag for flag, name in TOUR_EVENT.items() if name == only]
            lineitem = lineitem.where(F.col("l_returnflag").isin(flags))
        return (
            lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(region, F.col("r_regionkey") == F.col("l_partkey") % 5)
            .select(
                F.col("o_custkey").alias("user_id"),
                F.col("l_partkey").alias("tour_id"),
                recode(F.col("l_returnflag"), TOUR_EVENT).alias("event_type"),
                F.col("l_extendedprice").alias("amount"),
                F.col("l_shipdate").alias("timestamp"),
                F.col("r_name").alias("region"),
                day_text("l_shipdate").alias("processing_date"),
            )
        )

    def bookings(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("booking_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderstatus").alias("status"),
        )

    def data_sources(self) -> DataFrame:
        return self.table("nation").select(
            F.concat(F.lit("src_"), F.col("n_nationkey")).alias("source_id"),
            F.col("n_name").alias("source_name"),
            F.when(F.col("n_regionkey") < 2, "api").otherwise("jdbc").alias("source_type"),
            (F.col("n_nationkey") % 7 != 0).alias("is_enabled"),
        )

    def source_executions(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("execution_id"),
            F.concat(F.lit("src_"), F.col("o_custkey") % 20).alias("source_id"),
            recode(F.col("o_orderstatus"), EXECUTION_STATUS).alias("status"),
            F.col("o_orderdate").alias("started_at"),
            (F.col("o_orderkey") % 101).cast("double").alias("quality_score"),
            (F.col("o_orderkey") % 1000).alias("extracted_record_count"),
            (F.col("o_orderkey") % 1000 - F.col("o_orderkey") % 10).alias("validated_record_count"),
            (F.col("o_orderkey") * 7 % 600).alias("duration_seconds"),
        )

    def pipeline_runs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_orderpriority").alias("dag_id"),
            F.col("o_orderdate").alias("started_at"),
            (F.col("o_orderkey") * 7 % 600).alias("duration_seconds"),
            recode(F.col("o_orderstatus"), RUN_STATUS).alias("status"),
        )

    def lineage_nodes(self) -> DataFrame:
        region, nation, supplier = (self.table(t) for t in ("region", "nation", "supplier"))
        return (
            region.select(
                (1000 + F.col("r_regionkey")).cast("bigint").alias("id"),
                F.col("r_name").alias("name"),
                F.lit("source").alias("type"),
                F.lit(None).cast("bigint").alias("parent_id"),
            )
            .unionByName(
                nation.select(
                    (2000 + F.col("n_nationkey")).cast("bigint").alias("id"),
                    F.col("n_name").alias("name"),
                    F.lit("bronze").alias("type"),
                    (1000 + F.col("n_regionkey")).cast("bigint").alias("parent_id"),
                )
            )
            .unionByName(
                supplier.select(
                    (3000 + F.col("s_suppkey")).alias("id"),
                    F.col("s_name").alias("name"),
                    F.lit("silver").alias("type"),
                    (2000 + F.col("s_nationkey")).cast("bigint").alias("parent_id"),
                )
            )
        )

    def logs(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("ts"),
            recode(F.col("event_type"), LOG_LEVEL, F.lit("INFO")).alias("level"),
            F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("service"),
            F.concat_ws(" ", "event_type", "props").alias("message"),
            (F.col("value") * 20).alias("response_time"),
        )

    def clicks(self) -> DataFrame:
        """Clickstream rows: a session is one user's day."""
        return self.table("events").select(
            "event_id",
            "user_id",
            F.col("ts").alias("timestamp"),
            F.concat_ws("-", F.col("user_id").cast("string"), day_text("ts")).alias("session_id"),
            F.concat(
                F.lit("/"), F.col("event_type"), F.lit("/"), F.get_json_object("props", "$.k")
            ).alias("page_url"),
            F.col("event_type").alias("category"),
            F.element_at(
                F.array(*[F.lit(d) for d in DEVICES]), (F.col("user_id") % 3 + 1).cast("int")
            ).alias("device_type"),
        )

    def changes(self) -> DataFrame:
        """Change-data rows keyed by user; ``offset`` is the total order of the log."""
        return self.table("events").select(
            F.col("user_id").alias("key"),
            recode(F.col("event_type"), CHANGE_OP).alias("op"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
            F.col("event_id").alias("offset"),
            F.col("value").alias("balance"),
        )

    def positions(self) -> DataFrame:
        """Location readings spread over the globe by event id."""
        e = self.table("events")
        return e.select(
            "event_id",
            "user_id",
            F.col("ts").alias("timestamp"),
            ((F.col("event_id") * 7919 % 18000).cast("double") / 100 - 90).alias("latitude"),
            ((F.col("event_id") * 104729 % 36000).cast("double") / 100 - 180).alias("longitude"),
        )

    def offsets(self) -> DataFrame:
        """Queue offsets as a counter per topic and broker, sampled in every minute with events;
        all counters restart at one moment."""
        topic = F.coalesce(
            recode(F.col("event_type"), QUEUE_TOPIC),
            F.concat(F.lit("topic_"), F.col("event_type")),
        )
        minutes = (
            self.table("events")
            .groupBy(
                topic.alias("topic"),
                F.concat(F.lit("broker-"), F.col("user_id") % 3).alias("instance"),
                F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("ts"),
            )
            .agg(F.count("*").alias("n"))
        )
        return minutes.select("topic", "instance", "ts", self._since_reset("topic", "instance").alias("value"))

    @staticmethod
    def _since_reset(*series: str, value: str = "n"):
        restarted = F.col("ts") >= F.lit(COUNTER_RESET).cast("timestamp_ntz")
        w = Window.partitionBy(*series, restarted).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(value).over(w).cast("double")

    def request_counters(self) -> DataFrame:
        """Request count and summed duration (ms) as counters per service and status class."""
        status = F.when(F.col("event_type") == "error", "5xx").otherwise("2xx")
        minutes = (
            self.table("events")
            .groupBy(
                F.concat(F.lit("svc-"), F.col("user_id") % 5).alias("service"),
                status.alias("status"),
                F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("ts"),
            )
            .agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 20).cast("bigint")).alias("ms"))
        )
        running = minutes.select(
            "service", "status", "ts",
            self._since_reset("service", "status").alias("n"),
            self._since_reset("service", "status", value="ms").alias("ms"),
        )
        return running.select(
            "service", "status", "ts",
            F.expr("stack(2, 'request_duration_count', n, 'request_duration_sum', ms) AS (metric, value)"),
        )

    def gauges(self) -> DataFrame:
        """Memory gauges per node and hour."""
        hours = (
            self.table("events")
            .groupBy(
                F.concat(F.lit("node-"), F.col("user_id") % 5).alias("instance"),
                F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"),
            )
            .agg(F.min("value").alias("available"), (F.max("value") + 1).alias("total"))
        )
        return hours.select(
            "instance", "ts",
            F.expr("stack(2, 'memory_available', available, 'memory_total', total) AS (metric, value)"),
        )

    def up(self) -> DataFrame:
        """Up / down samples per job: an error event is a failed probe."""
        jobs = F.array(*[F.lit(j) for j in JOBS])
        return self.table("events").select(
            F.element_at(jobs, (F.col("user_id") % 5 + 1).cast("int")).alias("job"),
            F.concat(F.lit("host-"), F.col("user_id") % 7).alias("instance"),
            "ts",
            F.col("event_id").alias("sample_id"),
            F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("value"),
        )

    def latency_buckets(self) -> DataFrame:
        """Cumulative response-time buckets per service."""
        logs = self.logs()
        counts = logs.groupBy("service").agg(
            *[F.count(F.when(F.col("response_time") <= b, 1)).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)]
        )
        rows = [
            F.struct(F.lit(b).alias("le"), F.col(f"b{i}").cast("double").alias("count"))
            for i, b in enumerate(LATENCY_BOUNDS)
        ]
        return counts.select("service", F.inline(F.array(*rows)))

    def searches(self) -> DataFrame:
        """Search history: what was looked for and how many hits it had."""
        k = F.get_json_object("props", "$.k")
        return self.table("events").select(
            "user_id",
            F.concat_ws(" ", "event_type", k).alias("query"),
            ((F.col("user_id") + k.cast("bigint")) % 7).alias("results_count"),
        )
