"""Counters, keyed tables and the offset ledger over streams that stop, restart and repeat."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.operators import cdc, timeseries
from strata.streaming import counters, keyed, ledger

T0 = datetime(2024, 1, 1)


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


# --- counters ------------------------------------------------------------------------------------

SAMPLES = "topic string, instance string, ts timestamp, value double"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    counters.prepare(spark)
    yield
    spark.conf.set(key, before)


def grown(spark, tmp_path, lateness="2 days"):
    stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        counters.counter_growth(stream, ["topic", "instance"], lateness).writeStream.trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).start()
    )
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_growth_of_late_and_restarted_counters(spark, tmp_path, store):
    rng = random.Random(1)
    rows = []
    for topic in "ab":
        for instance in "xy":
            value = 0.0
            for minute in range(60):
                value = float(rng.randint(0, 3)) if minute == 30 else value + rng.randint(0, 9)
                rows.append((topic, instance, T0 + timedelta(minutes=minute), value))
    late = [r for k, r in enumerate(rows) if k % 7 == 3]
    rest = [r for r in rows if r not in late]
    # three files, then a restart with the late ones, one sample again and one null
    for part in (rest[:80], rest[80:150], rest[150:]):
        land(spark, str(tmp_path / "in"), part, SAMPLES)
    grown(spark, tmp_path)
    land(spark, str(tmp_path / "in"), [*late, rest[3], ("a", "x", T0, None)], SAMPLES)
    out = grown(spark, tmp_path)
    got = {(r.topic, r.window_start): round(r.rate, 9) for r in counters.window_rates(out, ["topic"]).collect()}
    samples = spark.createDataFrame(rows, SAMPLES)
    want = timeseries.rate(samples, ["topic", "instance"], ["topic"], 300).collect()
    assert got == {(r.topic, r.window_start): round(r.rate, 9) for r in want}


def test_what_the_watermark_has_passed_is_forgotten(spark, tmp_path, store):
    times = [0, 1, 5, 200, 400]
    for k, minute in enumerate(times):
        land(spark, str(tmp_path / "in"), [("a", "x", T0 + timedelta(minutes=minute), float(10 * k))], SAMPLES)
    out = grown(spark, tmp_path, "10 minutes")
    assert sorted(r.delta for r in out.collect()) == [0.0, 10.0, 10.0, 10.0, 10.0]
    land(spark, str(tmp_path / "in"), [("a", "x", T0 + timedelta(minutes=3), 15.0), ("a", "x", T0 + timedelta(minutes=401), 41.0)], SAMPLES)
    out = grown(spark, tmp_path, "10 minutes")
    assert out.count() == 6 and out.agg(F.sum("delta")).first()[0] == 41.0


# --- keyed tables --------------------------------------------------------------------------------

CHANGES = "key long, op string, ts_ms long, offset long, balance double"


def apply(spark, tmp_path):
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keyed.start(stream, str(tmp_path / "t"), str(tmp_path / "cp"), "key", ["balance"], buckets=8, once=True).awaitTermination()
    return sorted(map(tuple, keyed.current(spark, str(tmp_path / "t"), "key long, balance double").collect()), key=str)


def expected(spark, rows):
    base = spark.createDataFrame([], "key long, balance double")
    got = cdc.apply_changes(base, spark.createDataFrame(rows, CHANGES), "key", ["balance"], include_snapshot=True)
    return sorted(map(tuple, got.collect()), key=str)


def changes(seed, n, offset):
    rng = random.Random(seed)
    ops = lambda: rng.choice("ccuuurd")
    return [(rng.randint(0, 40), ops(), 1000 * rng.randint(0, 500), offset + i, float(rng.randint(0, 99))) for i in range(n)]


def test_keyed_table_after_deletes_repeats_and_a_restart(spark, tmp_path):
    parts = [changes(k, 60, 1000 * k) for k in range(4)]
    land(spark, str(tmp_path / "in"), parts[0], CHANGES)
    land(spark, str(tmp_path / "in"), parts[1], CHANGES)
    assert apply(spark, tmp_path) == expected(spark, parts[0] + parts[1])
    land(spark, str(tmp_path / "in"), parts[2] + parts[0][:20], CHANGES)
    land(spark, str(tmp_path / "in"), parts[3], CHANGES)
    assert apply(spark, tmp_path) == expected(spark, [r for p in parts for r in p])


def test_a_batch_rewrites_its_own_buckets_and_completes_itself(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, CHANGES)
    first = [(k, "c", 1, k, float(k)) for k in range(200)]
    keyed.merge_batch(frame(first), 0, path, "key", ["balance"], 8)
    stamps = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").glob("_bucket=*/*.parquet")}
    before = stamps()
    second = [(7, "d", 2, 500, None), (8, "u", 2, 501, 1.0), (8, "u", 0, 502, 5.0)]
    # the batch is stopped after it wrote its rows beside the table
    monkeypatch.setattr(keyed, "_delete", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        keyed.merge_batch(frame(second), 1, path, "key", ["balance"], 8)
    monkeypatch.undo()
    keyed.merge_batch(frame([]), 1, path, "key", ["balance"], 8)
    kept = [p for p in before if stamps().get(p) == before[p]]
    assert len(kept) >= 6
    rows = {r.key: r.balance for r in keyed.current(spark, path, "key long, balance double").collect()}
    assert rows == {k: float(k) for k in range(200) if k != 7} | {8: 1.0}
    keyed.merge_batch(frame([(7, "u", 1, 499, 9.0)]), 2, path, "key", ["balance"], 8)
    assert keyed.current(spark, path, "key long, balance double").where("key = 7").count() == 0


# --- offsets -------------------------------------------------------------------------------------


@pytest.mark.parametrize("slice_offsets", [4, 1 << 16])
def test_ranges_and_faults(spark, tmp_path, slice_offsets):
    rows = [("a", 0, o) for o in [*range(5, 20), *range(30, 33), 31, 31, 40]] + [("a", 1, 7), ("b", 0, 1), ("b", 0, 2)]
    got = ledger.ranges(spark.createDataFrame(rows, "topic string, partition int, offset long"), slice_offsets).collect()
    want = [("a", 0, 5, 19), ("a", 0, 30, 32), ("a", 0, 31, 31), ("a", 0, 31, 31), ("a", 0, 40, 40), ("a", 1, 7, 7), ("b", 0, 1, 2)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_ledger_reports_a_hole_and_a_repeat_and_nothing_else(spark, tmp_path):
    batch = lambda *spans: spark.createDataFrame(
        [(t, p, o) for t, p, a, z in spans for o in range(a, z)], "topic string, partition int, offset long"
    )
    path = str(tmp_path / "l")
    ledger.record(batch(("a", 0, 100, 200), ("b", 0, 0, 50)), 0, path)
    ledger.record(batch(("a", 0, 220, 300), ("b", 0, 50, 90)), 1, path)
    ledger.record(batch(("a", 0, 290, 310), ("b", 0, 90, 91)), 2, path)
    ledger.record(batch(("a", 0, 290, 310), ("b", 0, 90, 91)), 2, path)
    got = sorted(map(tuple, ledger.faults(ledger.read(spark, path)).collect()))
    assert got == [("a", 0, "lost", 200, 219), ("a", 0, "repeated", 290, 299)]
    early = ledger.faults(ledger.read(spark, path), F.lit(90)).where("topic = 'a' AND fault = 'lost'").collect()
    assert sorted((r.first, r.last) for r in early) == [(90, 99), (200, 219)]


@pytest.mark.parametrize("slice_offsets", [4, 1 << 16])
def test_faults_over_slices_and_files(spark, tmp_path, slice_offsets):
    rows = [("a", 0, f, l) for f, l in [(0, 1), (2, 30), (5, 6), (20, 40), (45, 50), (51, 60)]] + [(None, 1, 3, 3), (None, 1, 9, 9)]
    got = ledger.faults(spark.createDataFrame(rows, "topic string, partition int, first long, last long"), slice_offsets=slice_offsets)
    want = [("a", 0, "lost", 41, 44), ("a", 0, "repeated", 5, 6), ("a", 0, "repeated", 20, 30), (None, 1, "lost", 4, 8)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_ranges_of_a_batch_are_not_gathered_in_one_task(spark, tmp_path):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        batch = spark.range(4000).selectExpr("'t' || id % 40 AS topic", "0 AS partition", "id * 2 AS offset")
        ledger.record(batch, 0, str(tmp_path / "l"))
    finally:
        spark.conf.set(key, before)
    back = ledger.read(spark, str(tmp_path / "l"))
    assert back.count() == 4000 and back.select(F.input_file_name()).distinct().count() > 1
