"""Rankings, sessions and journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import epoch
from strata.functions.ordered import attach, time_slice, with_next

# Fixed value: minutes of silence that end a session.
SESSION_GAP_SECONDS = 30 * 60
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key, by the same plan for every ``n``.

    Each task keeps ``n`` rows per key before a shuffle (Spark's window group limit, whose threshold is raised to
    ``n``).  A first round per (key, slice of the row hash), with a slice per shuffle partition, shares out what the
    tasks of a hot key have kept: the global top ``n`` lie within the slices' top ``n``.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT)) < n:
        conf.set(GROUP_LIMIT, str(n))
    slices = int(conf.get("spark.sql.shuffle.partitions"))
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    salted = df.withColumn("_slice", F.pmod(F.xxhash64(*hashed), F.lit(slices)))
    part = Window.partitionBy(*keys, "_slice").orderBy(*order)
    df = salted.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= n).drop("_slice", "_rank")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def leaderboard(df: DataFrame, member: str, score: Column, n: int = 10) -> DataFrame:
    """Top members by score; the rank is numbered over the ``n`` rows that are left."""
    top = df.groupBy(member).agg(score.alias("score")).orderBy(F.desc("score"), member).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), member)))


def _bouts(df: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """One row per (key, gap-wide slice of time).  Rows of a slice are closer than the gap, so they
    belong to one session; a key has at most one row per slice, whatever its number of events."""
    per_slice = df.groupBy(key, F.floor(epoch(ts) / gap).alias("_slice")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count("*").alias("_events")
    )
    w = Window.partitionBy(key).orderBy("_slice")
    before = F.lag("_last").over(w)
    opens = before.isNull() | (epoch("_first") - epoch(before) > gap)
    return per_slice.withColumn("_opens", F.when(opens, 1).otherwise(0)).withColumn(
        "session_no", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def sessions(df: DataFrame, key: str, ts: str, gap: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Sessions by inactivity: a pause longer than ``gap`` seconds starts a new one."""
    return (
        _bouts(df, key, ts, gap)
        .groupBy(key, "session_no")
        .agg(
            F.min("_first").alias("started_at"),
            F.max("_last").alias("ended_at"),
            F.sum("_events").alias("events"),
        )
        .withColumn("duration_seconds", epoch("ended_at") - epoch("started_at"))
    )


def with_session(df: DataFrame, key: str, ts: str, gap: int = SESSION_GAP_SECONDS) -> DataFrame:
    """Every event with its session number: a slice lies in exactly one session."""
    numbers = _bouts(df, key, ts, gap).select(key, "_slice", "session_no")
    return attach(df.withColumn("_slice", F.floor(epoch(ts) / gap)), numbers, [key, "_slice"]).drop("_slice")


def landing_pages(clicks: DataFrame) -> DataFrame:
    """Entry pages by number of sessions; the first page is a map-side combinable minimum."""
    entry = clicks.groupBy("session_id").agg(
        F.min_by("page_url", F.struct("timestamp", "event_id")).alias("landing_page")
    )
    return entry.groupBy("landing_page").agg(F.count("*").alias("sessions"))


def journey_edges(clicks: DataFrame, step: str = "category", slice_seconds: int = 3600) -> DataFrame:
    """Steps taken within sessions as (from, to, count)."""
    rows = clicks.select("session_id", "timestamp", "event_id", F.col(step).alias("step"))
    paired = with_next(
        rows, ["session_id"], ["timestamp", "event_id"], time_slice("timestamp", slice_seconds), ["step"]
    )
    return (
        paired.where(F.col("following").isNotNull())
        .groupBy(F.col("step").alias("from_step"), F.col("following.step").alias("to_step"))
        .agg(F.count("*").alias("count"))
    )
