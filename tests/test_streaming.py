import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata import schemas
from strata.sources import queue
from strata.streaming import ingest, stateful
from strata.streaming.monitor import ProgressSamples

T0 = datetime(2024, 1, 1, 10)


def message(i, valid=True):
    body = {"source_id": "s", "source_name": "S", "ingestion_timestamp": "2024-01-01T10:00:00"}
    if valid:
        body["data"] = {"event_id": i, "event_type": "click"}
    return (None, json.dumps(body).encode(), "topic_app_events" if i % 2 else "topic_clickstream", 0, i, T0, 0)


def land(spark, path, rows):
    spark.createDataFrame(rows, schemas.QUEUE_RECORD).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def dirs(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "bronze", "dead", "checkpoint")}


def run(spark, dirs):
    q = ingest.start(queue.file_stream(spark, dirs["in"]), dirs["bronze"], dirs["dead"], dirs["checkpoint"], once=True)
    q.awaitTermination()


def bronze(spark, dirs):
    return spark.read.schema(schemas.BRONZE).parquet(dirs["bronze"])


def test_intake_diverts_resumes_and_adds_nothing_twice(spark, dirs):
    land(spark, dirs["in"], [message(i, valid=i % 5 != 0) for i in range(20)])
    land(spark, dirs["in"], [(None, b"{}", "other_topic", 0, 99, T0, 0)])
    run(spark, dirs)
    assert bronze(spark, dirs).count() == 20
    assert {r.source_type: r["count"] for r in bronze(spark, dirs).groupBy("source_type").count().collect()} == {
        "app_events": 10, "clickstream": 10,
    }
    dead = spark.read.parquet(dirs["dead"])
    assert dead.count() == 4 and dead.first().queue == "dlq_processing_errors"
    run(spark, dirs)
    assert bronze(spark, dirs).count() == 20
    land(spark, dirs["in"], [message(i) for i in range(20, 25)])
    run(spark, dirs)
    assert bronze(spark, dirs).count() == 25 and bronze(spark, dirs).select("offset").distinct().count() == 25


def test_repeated_batch_replaces_itself(spark, dirs):
    batch = ingest.decoded(spark.createDataFrame([message(i) for i in range(6)], schemas.QUEUE_RECORD)).withColumn(
        "processed_timestamp", F.lit(T0)
    )
    for _ in range(2):
        ingest.write_batch(batch, 7, dirs["bronze"], dirs["dead"])
    assert bronze(spark, dirs).count() == 6
    ingest.write_batch(batch.limit(0), 8, dirs["bronze"], dirs["dead"])
    assert bronze(spark, dirs).count() == 6


EVENT = "event_id bigint, user_id bigint, event_type string, timestamp timestamp"


def stream(spark, path, *batches):
    """One file per batch; files are read one per trigger, oldest first."""
    import os
    import time

    for n, rows in enumerate(batches):
        target = f"{path}/b{n}"
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(target)
        part = next(f for f in os.listdir(target) if f.endswith(".parquet"))
        os.utime(f"{target}/{part}", (time.time() - 1000 + n, time.time() - 1000 + n))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def collect(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_running_counts(spark, tmp_path):
    s = stream(spark, str(tmp_path), [(1, 1, "click", at(0)), (2, 1, "view", at(0))], [(3, 1, "click", at(1))])
    got = collect(stateful.running_counts(s, "event_type"), "running", "complete")
    assert {r.event_type: r["count"] for r in got.collect()} == {"click": 2, "view": 1}


def test_dedup_within_window(spark, tmp_path):
    s = stream(
        spark, str(tmp_path),
        [(1, 1, "click", at(0)), (1, 1, "click", at(0.5))],
        [(1, 1, "click", at(0.8)), (2, 1, "click", at(1))],
        [(3, 1, "click", at(60))],
        [(4, 1, "click", at(120))],
        [(1, 1, "click", at(121))],
    )
    got = collect(stateful.dedup_within(s, ["event_id"], 60), "dedup", "append")
    # after its minute the key may appear again
    assert sorted(r.event_id for r in got.collect()) == [1, 1, 2, 3, 4]


def test_keys_share_states(spark, tmp_path):
    rows = [(i, 1, "click", at(i % 7)) for i in range(300)]
    s = stream(spark, str(tmp_path), rows, rows + [(i, 1, "click", at(i % 7 + 61)) for i in range(0, 300, 2)])
    kept = stateful.dedup_within(s, ["event_id"], 60, buckets=8)
    query = kept.writeStream.format("memory").queryName("dedup_shared").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("dedup_shared").collect()) == sorted([*range(300), *range(0, 300, 2)])
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


def test_rows_kept_are_those_of_a_walk_in_time():
    rng = np.random.default_rng(2)
    for _ in range(40):
        known = np.array([(k, 0, 100 * k + 50 * j) for k in range(3) for j in range(int(rng.integers(3)))], np.int64).reshape(-1, 3)
        fresh = np.stack([rng.integers(0, 5, 30), np.zeros(30, np.int64), rng.integers(0, 400, 30)], axis=1)
        fresh[rng.random(30) < 0.1, 2] = stateful.NO_TIME
        kept = {}
        for k, _, t in known.tolist():
            kept.setdefault(k, []).append(t)
        want = set()
        for i in sorted(range(30), key=lambda i: (fresh[i, 2] == stateful.NO_TIME, fresh[i, 2], i)):
            k, t = int(fresh[i, 0]), int(fresh[i, 2])
            seen = kept.setdefault(k, [])
            if not seen if t == stateful.NO_TIME else all(abs(t - s) > 20 for s in seen):
                seen.append(t)
                want.add(i)
        assert set(np.flatnonzero(stateful._chosen(known, fresh, 20)).tolist()) == want


def test_late_keys_are_not_lost(spark, tmp_path):
    s = stream(
        spark, str(tmp_path),
        [(1, 1, "a", at(0)), (2, 1, "a", at(600))], [(3, 1, "a", at(5)), (2, 1, "a", at(599.5))],
        [(4, 1, "a", at(-700)), (4, 1, "a", at(-699.5)), (5, 1, "a", at(900))],
    )
    got = collect(stateful.dedup_within(s, ["event_id"], 60), "dedup_late", "append")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4, 5]


def test_accepted_rows_are_not_late_after_one_from_ahead(spark, tmp_path):
    # an accepted row 300 s ahead, then one almost a day old: both lie in the range of the time check
    s = stream(
        spark, str(tmp_path), [(1, 1, "a", at(5))], [(2, 1, "a", at(0))], [(3, 1, "a", at(0))], [(4, 1, "a", at(-1439))], [(5, 1, "a", at(5))]
    )
    ok, _ = stateful.split_by_time(s, as_of=F.lit(T0))
    got = collect(stateful.dedup_within(ok, ["event_id"], 60), "dedup_ahead", "append")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4, 5]
    counts = collect(stateful.tumbling_counts(ok, width="1 minute"), "tumbling_ahead", "update")
    assert at(-1439) in {r.window_start for r in counts.collect()}


def test_tumbling_counts_with_late_rows(spark, tmp_path):
    s = stream(
        spark, str(tmp_path),
        [(1, 1, "click", at(0)), (2, 1, "error", at(59))],
        [(3, 1, "click", at(55)), (4, 1, "click", at(75))],
        [(5, 1, "click", at(80))],
        [(6, 1, "click", at(10)), (7, 1, "click", at(300))],
        [(8, 1, "click", at(3000))],
        [(9, 1, "click", at(3001))],
    )
    got = collect(stateful.tumbling_counts(s), "tumbling", "append")
    rows = {r.window_start: (r.events, r.errors) for r in got.collect()}
    # the late event 6 lies within the accepted past and is counted
    assert rows[T0] == (4, 1) and rows[at(60)] == (2, 0)


def test_sliding_rate(spark, tmp_path):
    s = stream(spark, str(tmp_path), [(i, 1, "click", at(i)) for i in range(5)], [(9, 1, "click", at(60))], [(10, 1, "click", at(61))])
    got = collect(stateful.sliding_rate(s, "event_type", lateness="10 minutes"), "sliding", "append")
    assert {r.window_start: r.rate for r in got.collect()}[T0] == 5 / 300


def test_session_windows(spark, tmp_path):
    s = stream(
        spark, str(tmp_path),
        [(1, 7, "a", at(0)), (2, 7, "a", at(20)), (3, 7, "a", at(120))], [(4, 8, "a", at(500))], [(5, 8, "a", at(501))],
    )
    got = collect(stateful.session_counts(s, "user_id", lateness="10 minutes"), "sessions_out", "append")
    assert sorted((r.user_id, r.events) for r in got.collect()) == [(7, 1), (7, 2)]


def test_time_split_keeps_late_and_future_rows(spark, tmp_path):
    s = stream(spark, str(tmp_path), [(1, 1, "a", at(0)), (2, 1, "a", at(6)), (3, 1, "a", at(-1441)), (4, 1, "a", None)])
    ok, off = stateful.split_by_time(s, as_of=F.lit(T0))
    assert [r.event_id for r in collect(ok, "ok_rows", "append").collect()] == [1]
    assert {r.event_id: r.time_state for r in collect(off, "off_rows", "append").collect()} == {2: "future", 3: "past", 4: "missing"}


def test_latest_change_per_key(spark, tmp_path):
    path = str(tmp_path / "cdc")
    schema = "key bigint, op string, ts_ms bigint, offset bigint, v string"
    for n, rows in enumerate([[(1, "c", 1, 1, "a"), (2, "c", 1, 2, "b")], [(1, "u", 2, 3, "A"), (2, "d", 0, 4, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{n}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    got = collect(stateful.latest_changes(s, "key", ["v"]), "latest_out", "complete")
    assert {r.key: (r.op, r.v) for r in got.collect()} == {1: ("u", "A"), 2: ("c", "b")}


def test_event_time_cast(spark, entities):
    df = stateful.as_event_time(entities.app_events())
    assert dict(df.dtypes)["timestamp"] == "timestamp"


def test_progress_samples(spark, dirs):
    import os
    import time

    log = ProgressSamples(spark, dirs["in"] + "_metrics")
    spark.streams.addListener(log)
    try:
        land(spark, dirs["in"], [message(i) for i in range(4)])
        run(spark, dirs)
        for _ in range(100):
            if os.path.exists(log.path) and log.samples().where("name = 'stream_input_rows' and value > 0").count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    samples = [r.value for r in log.samples().where("name = 'stream_input_rows'").collect()]
    assert sum(samples) == 4.0


def test_new_checkpoints_keep_old_letters_and_messages_replay_as_sent(spark, dirs):
    from strata.operators import dlq

    bad = b'{"source_id": "s", "broken": '
    land(spark, dirs["in"], [(None, bad, "topic_app_events", 0, 1, T0, 0), message(2, valid=False)])
    run(spark, dirs)
    dirs["checkpoint"] += "_anew"
    land(spark, dirs["in"], [message(4, valid=False)])
    run(spark, dirs)
    dead = spark.read.parquet(dirs["dead"])
    texts = sorted(r.original_message for r in dead.collect())
    want = [bad.decode(), *[message(i, valid=False)[1].decode() for i in (2, 4)]]
    # the second query starts at the beginning, so the first two letters stand there twice
    assert texts == sorted(want + want[:2])
    outcomes = {r.original_message: r.outcome for r in dlq.replay(dead).collect()}
    assert outcomes[bad.decode()] == "failed" and outcomes[want[1]] == "retried"


def test_files_of_a_stream_grow_in_number_not_in_size(spark, tmp_path):
    from strata.plans.entities import Entities
    from strata.queries import roundtrips

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "12")
    try:
        each = roundtrips._landed(Entities(spark, ""), spark.range(5000), str(tmp_path / "landed"), 2)
    finally:
        spark.conf.set(key, before)
    back = spark.read.schema("id long").parquet(str(tmp_path / "landed"))
    per_file = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert each == 6 and len(per_file) == 12 and max(per_file) < 1000 and sum(per_file) == 5000
