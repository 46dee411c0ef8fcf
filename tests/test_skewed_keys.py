"""Operators with ordered semantics, against brute force, with one key holding a third of the rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions.ordered import time_slice, with_next, with_previous, with_running_max
from strata.operators import cdc, dedup, timeseries, windows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else rng.randrange(1, 40)
        out.append((key, i, rng.choice([rng.randrange(0, 200_000), 5_000]), rng.choice("abc"), float(rng.randrange(0, 50))))
    return pd.DataFrame(out, columns=["key", "id", "second", "label", "value"])


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows).withColumn("ts", F.timestamp_seconds("second")).repartition(7)


def ordered(rows):
    return rows.sort_values(["key", "second", "id"])


def as_list(frame, *columns):
    return sorted(tuple(r) for r in frame[list(columns)].itertuples(index=False))


@pytest.mark.parametrize("width", [60, 3600, 500_000])
def test_previous_and_next(df, rows, width):
    p = with_previous(df, ["key"], ["ts", "id"], time_slice("ts", width), ["id"])
    n = with_next(df, ["key"], ["ts", "id"], time_slice("ts", width), ["id"])
    o = ordered(rows)
    for frame, shift, name in ((p, 1, "previous"), (n, -1, "following")):
        want = o.assign(x=o.groupby("key").id.shift(shift).fillna(-1).astype(int))
        got = frame.select("id", F.coalesce(f"{name}.id", F.lit(-1)).alias("x")).toPandas()
        assert as_list(got, "id", "x") == as_list(want, "id", "x")


def test_running_max(df, rows):
    got = with_running_max(df, ["key"], ["ts", "id"], time_slice("ts", 3600), F.col("value"), "top").select("id", "top").toPandas()
    o = ordered(rows)
    assert as_list(got, "id", "top") == as_list(o.assign(top=o.groupby("key").value.cummax()), "id", "top")


@pytest.mark.parametrize("seconds", [1, 60, 3600])
def test_dedup_window(df, rows, seconds):
    o = ordered(rows)
    gap = o.second - o.groupby("key").second.shift(1)
    want = o[gap.isna() | (gap > seconds)]
    got = dedup.outside_window(df, ["key"], "ts", seconds, "id").select("key", "id").toPandas()
    assert as_list(got, "key", "id") == as_list(want, "key", "id")


@pytest.mark.parametrize("gap", [30, 1800])
def test_sessions(df, rows, gap):
    o = ordered(rows)
    opens = (o.second - o.groupby("key").second.shift(1)).fillna(gap + 1) > gap
    o = o.assign(session_no=opens.astype(int).groupby(o.key).cumsum())
    got = windows.with_session(df, "key", "ts", gap).select("id", "session_no").toPandas()
    assert as_list(got, "id", "session_no") == as_list(o, "id", "session_no")
    want = o.groupby(["key", "session_no"]).size()
    totals = windows.sessions(df, "key", "ts", gap).select("key", "session_no", "events").toPandas()
    assert {(r.key, r.session_no): r.events for r in totals.itertuples()} == want.to_dict()


@pytest.mark.parametrize("n", [3, 1500])
def test_top_per_key(df, rows, n):
    got = windows.top_per_key(df, ["key"], [F.desc("value"), F.col("id")], n).select("key", "id", "rank").toPandas()
    o = rows.sort_values(["key", "value", "id"], ascending=[True, False, True])
    o = o.assign(rank=o.groupby("key").cumcount() + 1)
    assert as_list(got, "key", "id", "rank") == as_list(o[o["rank"] <= n], "key", "id", "rank")


def test_alert_stretches(df, rows):
    o = ordered(rows)
    bad = o.value < 25
    stretch = (~bad).groupby(o.key).cumsum()
    o = o.assign(stretch=stretch)[bad]
    want = o.groupby(["key", "stretch"]).agg(n=("id", "size"), a=("second", "min"), b=("second", "max")).reset_index()
    want["firing"] = want.b - want.a >= 600
    got = timeseries.alerts(df, ["key"], F.col("value") < 25, 600, ["id"], slice_seconds=3600).toPandas()
    assert sorted(zip(got.key, got.samples, got.firing)) == sorted(zip(want.key, want.n, want.firing))


def test_counter_increase_survives_resets(spark):
    values = [3, 7, 7, 2, 5, 1, 10]
    samples = spark.createDataFrame([("s", i * 60, float(v)) for i, v in enumerate(values)], "s string, t long, value double")
    samples = samples.withColumn("ts", F.timestamp_seconds("t"))
    total = timeseries.increases(samples, ["s"], slice_seconds=120).agg(F.sum("delta")).first()[0]
    assert total == 4 + 0 + 2 + 3 + 1 + 9


def test_latest_change_of_a_hot_key(df, rows):
    got = cdc.latest(df.withColumnRenamed("second", "ts_ms").withColumnRenamed("id", "offset"), ["key"]).select("key", "offset").toPandas()
    want = ordered(rows).groupby("key").id.last()
    assert dict(zip(got.key, got.offset)) == want.to_dict()
