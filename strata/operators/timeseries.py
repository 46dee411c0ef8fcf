"""Monitoring operators over samples (series labels, ts, value).

Counter increases are exact: each sample adds what the counter grew since the previous sample of
its series, and a counter that fell has restarted from zero.  The growth belongs to the window of
the later sample, so window increases always add up to the total increase.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.columns import col, epoch, ratio
from strata.functions.ordered import time_slice, with_previous, with_running_max

DAY = 86_400
# Limits of the monitoring rules.
LAG_MESSAGES = 10_000
NULL_PERCENT = 10
QUALITY_FAILURE_PERCENT = 5
API_SUCCESS_PERCENT = 95
EPSILON = 0.001


def increases(samples: DataFrame, series: list[str], slice_seconds: int = DAY) -> DataFrame:
    """Adds ``delta`` and ``elapsed`` seconds since the series' previous sample; null on its first."""
    paired = with_previous(samples, series, ["ts"], time_slice("ts", slice_seconds), ["ts", "value"])
    before = F.col("previous.value")
    return paired.select(
        *samples.columns,
        F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before).alias("delta"),
        (epoch("ts") - epoch("previous.ts")).alias("elapsed"),
    )


def window_start(ts: str | Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(epoch(ts) / seconds) * seconds).cast("timestamp_ntz")


def increase(samples: DataFrame, series: list[str], by: list[str], seconds: int = DAY) -> DataFrame:
    """Counter growth per window, summed over the series of a group."""
    return (
        increases(samples, series)
        .groupBy(*by, window_start("ts", seconds).alias("window_start"))
        .agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("increase"))
    )


def rate(samples: DataFrame, series: list[str], by: list[str], seconds: int = 300) -> DataFrame:
    """Growth per second in windows of ``seconds``."""
    grown = increase(samples, series, by, seconds)
    return grown.select(*by, "window_start", (F.col("increase") / seconds).alias("rate"))


def instant_rate(samples: DataFrame, series: list[str], by: list[str], seconds: int = 300) -> DataFrame:
    """Rate between the last two samples of each series and window, averaged over a group."""
    last = (
        increases(samples, series)
        .where(F.col("delta").isNotNull())
        .groupBy(*series, window_start("ts", seconds).alias("window_start"))
        .agg(F.max_by(F.col("delta") / F.col("elapsed"), "ts").alias("irate"))
    )
    return last.groupBy(*by, "window_start").agg(F.avg("irate").alias("irate"))


def gauge_ratio(samples: DataFrame, part: str, whole: str, series: list[str]) -> DataFrame:
    """Two gauges side by side in one aggregate, and their guarded ratio.  Several samples of a
    gauge per group and time, such as connections per database, add up."""
    value_of = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")))
    return (
        samples.where(F.col("metric").isin(part, whole))
        .groupBy(*series, "ts")
        .agg(value_of(part).alias("part"), value_of(whole).alias("whole"))
        .withColumn("ratio", F.col("part") / F.nullif(F.col("whole"), F.lit(0.0)))
    )


def bucket_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile from cumulative ``le`` buckets by linear interpolation inside the bucket that holds
    the rank; a rank in the unbounded bucket gives the largest finite bound.  One row per bound
    enters the window."""
    w = Window.partitionBy(*by).orderBy("le")
    total = F.max("count").over(Window.partitionBy(*by))
    rows = buckets.select(
        *by,
        "le",
        "count",
        F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"),
        F.coalesce(F.lag("count").over(w), F.lit(0.0)).alias("below"),
        (total * q).alias("rank"),
    ).where((F.col("count") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (
        (F.col("rank") - F.col("below")) / (F.col("count") - F.col("below"))
    )
    return rows.select(
        *by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile")
    )


def latest(samples: DataFrame, series: list[str], order: list[str] | None = None) -> DataFrame:
    """Last sample per series, a map-side combinable maximum."""
    order = order or ["ts"]
    return samples.groupBy(*series).agg(
        F.max("ts").alias("ts"), F.max_by("value", F.struct(*order)).alias("value")
    )


def top_series(samples: DataFrame, series: list[str], k: int = 10) -> DataFrame:
    return latest(samples, series).orderBy(F.desc("value"), *series).limit(k)


def sum_latest(samples: DataFrame, series: list[str], by: list[str]) -> DataFrame:
    return latest(samples, series).groupBy(*by).agg(F.sum("value").alias("value"))


def share_of_increase(
    samples: DataFrame, series: list[str], by: list[str], part: Column, seconds: int = 300
) -> DataFrame:
    """Increase of the series picked by ``part`` beside the increase of all series, per window."""
    return (
        increases(samples, series)
        .groupBy(*by, window_start("ts", seconds).alias("window_start"))
        .agg(
            F.coalesce(F.sum(F.when(part, F.col("delta"))), F.lit(0.0)).alias("part"),
            F.coalesce(F.sum("delta"), F.lit(0.0)).alias("whole"),
        )
    )


def error_ratio(
    counters: DataFrame, series: list[str], by: list[str], failed: Column, seconds: int = 300
) -> DataFrame:
    return share_of_increase(counters, series, by, failed, seconds).select(
        *by, "window_start", ratio("part", "whole").alias("error_ratio")
    )


def mean_latency(counters: DataFrame, series: list[str], by: list[str], seconds: int = 300) -> DataFrame:
    """Summed duration over request count, both as increases of their counters."""
    grown = increase(counters, [*series, "metric"], [*by, "metric"], seconds)
    value_of = lambda m: F.max(F.when(F.col("metric") == m, F.col("increase")))
    return (
        grown.groupBy(*by, "window_start")
        .agg(value_of("request_duration_sum").alias("total"), value_of("request_duration_count").alias("n"))
        .where(F.col("n") > 0)
        .select(*by, "window_start", (F.col("total") / F.col("n")).alias("mean_latency"))
    )


def quality_rate(samples: DataFrame, series: list[str], seconds: int = 300) -> DataFrame:
    """100 minus the percentage of dead letters among all messages; the small term guards an idle queue."""
    dead = F.col("topic").startswith("dlq")
    shares = share_of_increase(samples, series, [], dead, seconds)
    score = (1 - (F.col("part") / seconds) / (F.col("whole") / seconds + EPSILON)) * 100
    return shares.select("window_start", score.alias("quality_score"))


def dead_letter_health(samples: DataFrame, series: list[str], seconds: int = 300) -> DataFrame:
    dead = rate(samples.where(F.col("topic").startswith("dlq")), series, [], seconds)
    return dead.select("window_start", (100 - F.col("rate") * 10).alias("health"))


def health_score(up: DataFrame, series: list[str], groups: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """Mean of the up-shares of the job groups in %, from the last sample of each series."""
    last = latest(up, series, order)
    shares = [F.avg(F.when(F.col("job").rlike(f"^{p}$"), F.col("value"))).alias(g) for g, p in groups.items()]
    names = list(groups)
    return last.agg(*shares).select(
        *names, (reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names) * 100).alias("health")
    )


def alerts(
    samples: DataFrame, series: list[str], condition: Column, hold_seconds: int | Column, tie: list[str] | None = None,
    slice_seconds: int = DAY,
) -> DataFrame:
    """Unbroken stretches of samples that meet the condition; one fires when it lasts the hold time.

    The last sample before the stretch that missed the condition names the stretch: all its rows
    share it, so stretches are an aggregate and never a per-series loop.
    """
    order = ["ts", *(tie or [])]
    met = F.coalesce(condition, F.lit(False))
    marked = samples.withColumn("_met", met)
    miss = F.when(~F.col("_met"), F.struct(*order))
    named = with_running_max(marked, series, order, time_slice("ts", slice_seconds), miss, "_since")
    return (
        named.where("_met")
        .groupBy(*series, "_since")
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("last_seen"),
            F.count("*").alias("samples"),
        )
        .withColumn("firing", epoch("last_seen") - epoch("started_at") >= hold_seconds)
        .drop("_since")
    )


def consumer_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """End offset minus committed offset, in messages and seconds, worst and total per group and
    topic.  A partition the group never committed lags by its whole length."""
    ends = ends.select("topic", "partition", F.col("offset").alias("end"), F.col("ts").alias("end_ts"))
    done = committed.select("group", "topic", "partition", F.col("offset").alias("at"), F.col("ts").alias("at_ts"))
    groups = committed.select("group", "topic").distinct()
    lag = (
        ends.join(groups, "topic")
        .join(done, ["group", "topic", "partition"], "left")
        .withColumn("lag", F.col("end") - F.coalesce("at", F.lit(0)))
        .withColumn("lag_seconds", F.greatest(epoch("end_ts") - epoch("at_ts"), F.lit(0.0)))
    )
    return lag.groupBy("group", "topic").agg(
        F.max("lag").alias("lag_messages"), F.sum("lag").alias("total_lag"), F.max("lag_seconds").alias("lag_seconds")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str, float, int, str]]) -> DataFrame:
    """(alert, metric, operator, threshold, hold_seconds, severity) rows of the configuration."""
    return spark.createDataFrame(
        rules, "alert string, metric string, operator string, threshold double, hold_seconds int, severity string"
    )


# The configured gauge alerts; they hold at once.
RULES = [
    ("high_consumer_lag", "kafka_consumer_lag", ">", float(LAG_MESSAGES), 0, "warning"),
    ("data_quality_failure_rate", "data_quality_failures", ">", float(QUALITY_FAILURE_PERCENT), 0, "critical"),
    ("external_api_down", "api_success_rate", "<", float(API_SUCCESS_PERCENT), 0, "warning"),
    ("high_null_rate", "data_quality_null_percentage", ">", float(NULL_PERCENT), 0, "warning"),
    ("data_quality_check_failed", "data_quality_check_status", "==", 0.0, 0, "warning"),
]
# The monitoring rules with the names, limits, hold times in seconds and severities they are configured
# with, for alerts are routed by them; the metrics are values derived by the operators above.
HELD_RULES = [
    ("HighMemoryUsage", "memory_used_percent", ">", 85.0, 300, "critical"),
    ("HighCPUUsage", "cpu_used_percent", ">", 80.0, 300, "warning"),
    ("DiskSpaceLow", "disk_free_percent", "<", 15.0, 300, "critical"),
    ("KafkaBrokerDown", "up_kafka", "==", 0.0, 120, "critical"),
    ("KafkaUnderReplicatedPartitions", "under_replicated_partitions", ">", 0.0, 300, "warning"),
    ("KafkaOfflinePartitions", "offline_partitions", ">", 0.0, 120, "critical"),
    ("KafkaConsumerLag", "consumer_lag", ">", 10_000.0, 600, "warning"),
    ("SparkMasterDown", "up_spark_master", "==", 0.0, 120, "critical"),
    ("SparkWorkerDown", "up_spark_worker", "==", 0.0, 120, "warning"),
    ("SparkJobFailureRate", "job_failures_per_second", ">", 0.1, 300, "warning"),
    ("MinIONodeOffline", "storage_nodes_offline", ">", 0.0, 120, "critical"),
    ("MinIODiskOffline", "storage_disks_offline", ">", 0.0, 120, "critical"),
    ("MinIOHighStorageUsage", "storage_used_percent", ">", 85.0, 300, "warning"),
    ("PostgreSQLDown", "up_postgres", "==", 0.0, 120, "critical"),
    ("PostgreSQLTooManyConnections", "connections_share", ">", 0.8, 300, "warning"),
    ("PostgreSQLDeadLocks", "deadlocks_increase", ">", 0.0, 60, "warning"),
    ("ClickHouseDown", "up_clickhouse", "==", 0.0, 120, "critical"),
    ("ClickHouseSlowQueries", "olap_mean_seconds", ">", 10.0, 300, "warning"),
    ("HighAPIErrorRate", "api_error_share", ">", 0.05, 300, "critical"),
    ("HighAPILatency", "api_p95_seconds", ">", 2.0, 300, "warning"),
    ("APIDown", "up_api", "==", 0.0, 120, "critical"),
    ("DataQualityCheckFailed", "data_quality_check_status", "==", 0.0, 300, "warning"),
    ("HighNullRate", "data_quality_null_percentage", ">", 10.0, 300, "warning"),
    ("AirflowSchedulerDown", "up_airflow_scheduler", "==", 0.0, 120, "critical"),
    ("AirflowDAGFailures", "run_failures_per_second", ">", 0.0, 300, "warning"),
    ("JaegerCollectorDown", "up_jaeger", "==", 0.0, 120, "warning"),
    ("HighTraceSamplingDropRate", "traces_dropped_per_second", ">", 100.0, 300, "warning"),
]


def _broken() -> Column:
    value, limit, op = F.col("value"), F.col("threshold"), F.col("operator")
    return F.when(op == ">", value > limit).when(op == "<", value < limit).when(op == "==", value == limit)


def apply_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Every metric row that breaks a rule of its metric."""
    return metrics.join(rules, "metric").where(_broken()).drop("hold_seconds")


def held_alerts(metrics: DataFrame, rules: DataFrame, series: list[str], tie: list[str] | None = None) -> DataFrame:
    """Unbroken stretches in which a series of (series, ts, metric, value) breaks a rule of its metric; each rule fires
    when a stretch lasts its own hold time."""
    judged = metrics.join(rules, "metric")
    return alerts(judged, [*series, "alert", "severity", "hold_seconds"], _broken(), F.col("hold_seconds"), tie)


def up_status(up: DataFrame, series: list[str], order: list[str] | None = None) -> DataFrame:
    return latest(up, series, order).withColumn("status", F.when(col("value") == 1, "UP").otherwise("DOWN"))
