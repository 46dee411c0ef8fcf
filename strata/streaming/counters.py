"""Growth of counters as a stream: what each sample adds since the sample of its series before it.

A sample may come late, between two that were seen already.  Its neighbours' growth is then split anew: the stream
emits what changes, so the emitted growth of a series always adds up to that of all its samples in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strata.functions.columns import epoch
from strata.streaming.stateful import LATENESS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def growth(samples: list[tuple[pd.Timestamp, float]]) -> dict[tuple[pd.Timestamp, float], float]:
    """Growth of each of the ordered samples; 0 for the first, and a counter that fell has restarted from zero."""
    out = {sample: 0.0 for sample in samples[:1]}
    for (_, before), (time, value) in zip(samples, samples[1:], strict=False):
        out[time, value] = value if value < before else value - before
    return out


class _Growth(StatefulProcessor):
    """State of a series: its samples the watermark has not passed, and the last one that it has."""

    def __init__(self, series: list[str], idle_ms: int):
        self.series, self.idle_ms = series, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<timestamp>, values array<double>, timer bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, values, timer = self.held.get() if self.held.exists() else ([], [], None)
        old = [(pd.Timestamp(t), float(v)) for t, v in zip(times, values, strict=True)]
        come = {(t, float(v)) for frame in rows for t, v in zip(frame["ts"], frame["value"], strict=True) if pd.notna(t) and pd.notna(v)}
        new = sorted(come.union(old))
        before, after = growth(old), growth(new)
        changed = [(t, v, after[t, v] - before.get((t, v), 0.0)) for t, v in new if (t, v) not in before or after[t, v] != before[t, v]]
        if changed:
            frame = pd.DataFrame(changed, columns=["ts", "value", "delta"])
            for name, part in zip(self.series, key, strict=True):
                frame.insert(0, name, part)
            yield frame[[*self.series, "ts", "value", "delta"]]
        border = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        passed = [s for s in new if s[0] < border]
        kept = passed[-1:] + new[len(passed) :]
        if not kept:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(int(kept[-1][0].timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self.handle.registerTimer(timer)
        self.held.update(([t.to_pydatetime() for t, _ in kept], [v for _, v in kept], timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """The state of this operator needs a store with timers and several columns."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def counter_growth(
    stream: DataFrame, series: list[str], lateness: str = LATENESS, idle_seconds: int = 86_400
) -> DataFrame:
    """(series, ts, value, delta) of a stream of (series, ts, value); for append mode, see :func:`prepare`.

    Samples behind the watermark are dropped by Spark, null ones are left out, and a sample that comes again adds
    nothing.  Samples of one time count in the order of their values.  A series without samples for ``idle_seconds``
    beyond the watermark is forgotten; if it comes back, it starts like a new one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([f"{s} {kinds[s]}" for s in series] + ["ts timestamp", "value double", "delta double"])
    return (
        stream.select(*series, F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
        .withWatermark("ts", lateness)
        .groupBy(*series)
        .transformWithStateInPandas(_Growth(series, idle_seconds * 1000), schema, "Append", "EventTime")
    )


def window_rates(grown: DataFrame, by: list[str], seconds: int = 300) -> DataFrame:
    """Growth per second in windows, from all that :func:`counter_growth` has emitted so far."""
    start = F.timestamp_seconds(F.floor(epoch("ts") / seconds) * seconds).cast("timestamp_ntz")
    return grown.groupBy(*by, start.alias("window_start")).agg((F.sum("delta") / seconds).alias("rate"))
