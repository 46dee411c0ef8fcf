"""Stateful stream operators.  Event times must be zoned timestamps; ``as_event_time`` casts.

State is kept by Spark's own operators but for duplicates within a time: partial aggregation runs before the state's
shuffle, so a hot type or page sends one row per task, and watermarks bound what is kept.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from strata.functions.columns import count_of
from strata.operators.quality import MAX_FUTURE_SECONDS, MAX_PAST_SECONDS, timestamp_state

# Seconds between the time check of a row and its batch in a stateful operator, our own choice.
PROCESSING_SECONDS = 600
# Watermarks trail the newest accepted time, which may lie ahead, by all the range that ``split_by_time`` accepts, so a
# row it let through is not dropped as late if it is processed within ``PROCESSING_SECONDS``.
LATENESS = f"{MAX_PAST_SECONDS + MAX_FUTURE_SECONDS + PROCESSING_SECONDS} seconds"

# States that the keys of a stream without repeats share, our own choice.
BUCKETS = 1 << 10
NO_TIME = int(np.iinfo(np.int64).min)


def as_event_time(stream: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Zone-free times cannot carry a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def split_by_time(stream: DataFrame, ts: str = "timestamp", as_of=None) -> tuple[DataFrame, DataFrame]:
    """Rows in the accepted time range, and the late, future or time-less ones with the reason.
    Comes before any watermark, which would drop late rows silently."""
    state = timestamp_state(F.col(ts), F.current_timestamp() if as_of is None else as_of)
    flagged = stream.withColumn("time_state", state)
    return flagged.where("time_state = 'ok'").drop("time_state"), flagged.where("time_state <> 'ok'")


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    """Counters per key since the start; for update or complete mode."""
    return stream.groupBy(key).agg(F.count("*").alias("count"))


def _time_numbers(times) -> np.ndarray:
    """Microseconds; a missing time is the smallest number."""
    return np.asarray(times, "datetime64[us]").view(np.int64)


def _chosen(known: np.ndarray, fresh: np.ndarray, span: int) -> np.ndarray:
    """Which of ``fresh`` to keep: earliest first, those more than ``span`` away from all rows of the key kept before.

    Rows are (key, key, time), ``known`` those kept before.  A row without a time stays if its key has no other.
    """
    rows = np.concatenate([known, fresh])
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    keys = rows[order, :2]
    new = np.append(True, (keys[1:] != keys[:-1]).any(1))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(rows)))
    keep = np.zeros(len(rows), bool)
    keep[order[starts[sizes == 1]]] = True
    # Only keys that come more than once are looked at row by row.
    for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        places = order[a : a + n]
        kept = [t for p, t in zip(places.tolist(), rows[places, 2].tolist(), strict=True) if p < len(known)]
        timeless = [p for p in places.tolist() if rows[p, 2] == NO_TIME]
        for p in [*(p for p in places.tolist() if rows[p, 2] != NO_TIME), *timeless]:
            if p < len(known):
                continue
            time = int(rows[p, 2])
            at = bisect_left(kept, time)
            near = kept[:1] if NO_TIME in (time, *kept[:1]) else kept[max(0, at - 1) : at + 1]
            if all(NO_TIME not in (t, time) and abs(time - t) > span for t in near):
                kept.insert(at, time)
                keep[p] = True
    return keep[len(known) :]


def dedup_within(
    stream: DataFrame, keys: list[str], seconds: int, ts: str = "timestamp", lateness: str = LATENESS, buckets: int = BUCKETS
) -> DataFrame:
    """Rows of a key that are more than ``seconds`` of event time away from every row of it kept before.

    The state holds the times kept for a key, at most one per ``seconds`` of the accepted past.  How long a key is
    remembered is not tied to the watermark, so late rows of new keys pass.  Unlike the batch form, repeats do not
    prolong the time.

    Keys share the states of ``buckets``, so a batch calls Python once per bucket and not once per key; the number of
    buckets belongs to the checkpoint.  In a bucket a key goes by two hashes of 64 bits.
    """
    span, columns = seconds * 1_000_000, stream.columns
    parts = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
    first, second = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
    shared = stream.withColumns({"_bucket": F.pmod(first, F.lit(buckets)), "_first": first, "_second": second})

    def keep(_, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        kept = np.frombuffer(state.get[0], np.int64).reshape(-1, 3) if state.exists else np.zeros((0, 3), np.int64)
        for frame in frames:
            fresh = np.stack([frame["_first"], frame["_second"], _time_numbers(frame[ts])], axis=1)
            chosen = _chosen(kept, fresh, span)
            kept = np.concatenate([kept, fresh[chosen]])
            if chosen.any():
                yield frame.loc[chosen, columns]
        border = state.getCurrentWatermarkMs() * 1000 - span
        kept = kept[kept[:, 2] >= border]
        state.update((kept.tobytes(),))
        newest = max(border, int(kept[:, 2].max(initial=border)))
        state.setTimeoutTimestamp(max((newest + 2 * span) // 1000, state.getCurrentWatermarkMs() + 1))

    return (
        shared.withWatermark(ts, lateness)
        .groupBy("_bucket")
        .applyInPandasWithState(keep, stream.schema, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)
    )


def tumbling_counts(
    stream: DataFrame, ts: str = "timestamp", width: str = "1 hour", lateness: str = LATENESS,
    error=None,
) -> DataFrame:
    failed = F.col("event_type") == "error" if error is None else error
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width))
        .agg(F.count("*").alias("events"), count_of(failed).alias("errors"))
        .select(F.col("window.start").alias("window_start"), "events", "errors")
    )


def sliding_rate(
    stream: DataFrame, by: str, ts: str = "timestamp", width_seconds: int = 300, slide_seconds: int = 60,
    lateness: str = LATENESS,
) -> DataFrame:
    """Events per second and group in overlapping windows."""
    w = F.window(ts, f"{width_seconds} seconds", f"{slide_seconds} seconds")
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(w, by)
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("window_start"), by, (F.col("events") / width_seconds).alias("rate"))
    )


def session_counts(
    stream: DataFrame, key: str, ts: str = "timestamp", gap: str = "30 minutes", lateness: str = LATENESS
) -> DataFrame:
    """Sessions by inactivity.  A session ends ``gap`` after its last event."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.session_window(ts, gap), key)
        .agg(F.count("*").alias("events"))
        .select(
            key,
            F.col("session_window.start").alias("started_at"),
            F.col("session_window.end").alias("ended_at"),
            "events",
        )
    )


def latest_changes(stream: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Latest change per key, kept incrementally: a batch touches the state of its own keys only.
    In update mode it emits the changed keys, to be merged into the keyed table downstream."""
    at = F.struct("ts_ms", "offset")
    newest = F.max_by(F.struct("ts_ms", "offset", "op", *columns), at)
    return stream.groupBy(key).agg(newest.alias("c")).select(key, "c.*")
