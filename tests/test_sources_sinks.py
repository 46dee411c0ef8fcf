import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strata import schemas
from strata.functions import envelope
from strata.operators import cdc, clean, dlq, gold, metadata
from strata.sinks import files as file_sinks
from strata.sinks import layers, publish
from strata.sources import extract, incremental, queue, tables


@pytest.mark.parametrize(
    "payload, ids",
    [
        ({"data": [{"id": 1}, {"id": 2}]}, [1, 2]),
        ([{"id": 3}], [3]),
        ({"id": 4}, [4]),
        ({"data": []}, []),
        ({"data": {"id": 5}}, [5]),
    ],
)
def test_json_payload_forms(spark, tmp_path, payload, ids):
    (tmp_path / "page.json").write_text(json.dumps(payload, indent=2))
    got = extract.json_records(spark, str(tmp_path / "page.json"), "id int")
    assert sorted(r.id for r in got.collect()) == ids


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_files_by_format(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    writer = df.write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(str(tmp_path / fmt))
    source = {"source_type": "s3", "location": str(tmp_path / fmt), "schema": "id int, name string", "format": fmt}
    assert sorted(tuple(r) for r in extract.extract(spark, source).collect()) == [(1, "a"), (2, "b")]


def test_jdbc_options():
    base = dict(url="u", driver="d", user="x", password="y")
    whole = extract.jdbc_options(**base, table="t", partition_column="id", bounds=("0", "9"), partitions=4)
    assert whole["dbtable"] == "t" and whole["numPartitions"] == "4"
    new = extract.jdbc_options(**base, query="SELECT * FROM a", watermark_column="updated_at", watermark="2024-01-01'")
    assert new["dbtable"] == "(SELECT * FROM (SELECT * FROM a) q WHERE updated_at > '2024-01-01''') w"
    with pytest.raises(ValueError):
        extract.jdbc_options(**base)
    with pytest.raises(ValueError):
        extract.jdbc_options(**base, table="t", partition_column="id")


def test_queue_options():
    options = queue.kafka_options("b:9092")
    assert options["subscribePattern"] == "topic_.*" and options["maxOffsetsPerTrigger"] == "10000"
    assert options["startingOffsets"] == "latest" and options["failOnDataLoss"] == "false"


def test_absent_bronze_has_the_schema(spark, tmp_path):
    df = tables.bronze_partition(spark, str(tmp_path / "none"), schemas.BRONZE, F.col("source_type") == "x")
    assert df.count() == 0 and "raw_data" in df.columns
    assert tables.try_catalog_table(spark, "no_such_table", "a int").columns == ["a"]


def test_watermark(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, d)) for d in (1, 2, 3)], "s string, updated_at timestamp")
    assert incremental.newer_than(df, "updated_at", None).count() == 3
    new = incremental.newer_than(df, "updated_at", "2024-01-01 12:00:00")
    mark = incremental.high_water_mark(new, "updated_at", F.col("s")).first()
    assert (mark.new_rows, mark.watermark) == (2, datetime(2024, 1, 3))


def test_layer_path_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "layer")
    write = lambda rows: layers.write_path(spark.createDataFrame(rows, "v int, processing_date string"), path, ["processing_date"], ["v"])
    write([(1, "2024-01-01"), (2, "2024-01-02")])
    write([(3, "2024-01-02")])
    assert sorted((r.v, str(r.processing_date)) for r in spark.read.parquet(path).collect()) == [(1, "2024-01-01"), (3, "2024-01-02")]


def test_layer_table_replaces_only_its_day(spark):
    spark.sql("DROP TABLE IF EXISTS daily")
    write = lambda rows: layers.write_table(spark.createDataFrame(rows, "processing_date string, v int"), "daily", ["processing_date"])
    write([("2024-01-01", 1), ("2024-01-02", 2)])
    write([("2024-01-02", 3)])
    assert sorted(r.v for r in spark.table("daily").collect()) == [1, 3]
    assert [r.v for r in tables.catalog_table(spark, "daily", "2024-01-01").collect()] == [1]
    spark.sql("DROP TABLE daily")


def test_catalogue_of_written_tables(spark):
    load = lambda day, table, n, **more: metadata.lineage_event(
        spark, "transformation", datetime(2024, 1, day), job_name="j", source={"layer": "bronze", "tables": ["a"]},
        destination={"layer": "silver", "table": table}, row_count_in=9, row_count_out=n, **more,
    )
    events = load(1, "Daily", 2).unionByName(load(2, "Daily", 5, status="failed")).unionByName(load(1, "other", 1))
    row = metadata.dataset_catalog(events, "dail").first()
    assert (row.dataset, row.layer, row.rows, row.status, row.format) == ("Daily", "silver", 5, "failed", "parquet")
    assert metadata.dataset_catalog(events).count() == 2


def test_publish_replaces_the_day_and_survives_a_failing_table(spark):
    store: dict[str, list] = {}
    frames = {
        "good": spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, processing_date string"),
        "empty": spark.createDataFrame([], "v int, processing_date string"),
        "nested": spark.createDataFrame([([1, 2], "2024-01-01")], "v array<int>, processing_date string"),
    }

    def stage(df, options):
        if options["dbtable"] == "bad":
            raise RuntimeError("refused")
        staged[options["dbtable"]] = [tuple(r) for r in df.collect()]

    def swap(_, options, date):
        table = options["dbtable"]
        store[table] = [r for r in store.get(table, []) if r[1] != date] + staged.pop(table)

    staged: dict[str, list] = {}
    target = lambda t: publish.jdbc_writer_options("u", "d", "x", "y", t)
    for _ in range(2):
        result = publish.publish_day(
            spark, lambda t: frames.get(t, frames["good"]), target, "2024-01-01", ["bad", "good", "empty", "nested"], stage, swap
        )
    assert {r.table: (r.status, r.rows) for r in result.collect()} == {
        "bad": ("failed", None), "good": ("published", 1), "empty": ("skipped", 0), "nested": ("published", 1),
    }
    assert store == {"good": [(1, "2024-01-01")], "nested": [("[1,2]", "2024-01-01")]}
    assert publish.staging(target("t"))["dbtable"] == "t__staged"


def test_a_failing_publisher_leaves_the_old_day_readable(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS published_days")
    spark.sql("CREATE TABLE published_days (v int, processing_date string) USING parquet PARTITIONED BY (processing_date)")
    days = lambda: sorted(map(tuple, spark.table("published_days").select("v", "processing_date").collect()))
    frame = lambda *rows: spark.createDataFrame(list(rows), "v int, processing_date string")
    target = lambda t: publish.catalog_options(t, str(tmp_path))
    send = lambda df, swap=publish.swap_folder: publish.publish_day(
        spark, lambda _: df, target, "2024-01-01", ["published_days"], publish.stage_folder, swap
    ).first()
    assert send(frame((1, "2024-01-01"), (2, "2024-01-01"), (9, "2024-01-02"))).rows == 2
    assert days() == [(1, "2024-01-01"), (2, "2024-01-01")]

    def fails(*_):
        raise RuntimeError("stopped between writing and swapping")

    assert send(frame((5, "2024-01-01")), fails).status == "failed"
    assert days() == [(1, "2024-01-01"), (2, "2024-01-01")]
    broken = frame((6, "2024-01-01")).withColumn("v", F.expr("if(v = 6, raise_error('half way'), v)").cast("int"))
    assert send(broken).status == "failed"
    assert days() == [(1, "2024-01-01"), (2, "2024-01-01")]
    assert send(frame((7, "2024-01-01"))).status == "published" and days() == [(7, "2024-01-01")]
    assert send(frame((8, "2024-01-03"))).status == "skipped" and days() == [(7, "2024-01-01")]
    spark.sql("DROP TABLE published_days")


def test_messages_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "booking"), (2, None)], "id int, kind string")
    sent = publish.records(df, "topic_x", "src", "Source", F.lit("2024-01-01T00:00:00"))
    publish.to_files(sent, str(tmp_path / "out"))
    back = spark.read.schema("value string, topic string").text(str(tmp_path / "out"))
    message = json.loads(back.orderBy("value").first().value)
    assert message == {"source_id": "src", "source_name": "Source", "ingestion_timestamp": "2024-01-01T00:00:00", "data": {"id": 1, "kind": "booking"}}


def record(spark, value):
    row = [(None, value.encode(), "topic_app_events", 0, 1, datetime(2024, 1, 1, 5), 0)]
    return spark.createDataFrame(row, schemas.QUEUE_RECORD)


@pytest.mark.parametrize(
    "value, valid, payload",
    [
        ('{"source_id":"s","ingestion_timestamp":"t","data":{"a":1}}', True, {"a": "1"}),
        ('{"source_id":"s","ingestion_timestamp":"t"}', False, None),
        ('{"event_type":"click","source":"app","timestamp":"t"}', True, {"event_type": "click", "source": "app", "timestamp": "t"}),
        ('{"event_type":"click"}', False, {"event_type": "click"}),
        ("not json", False, None),
        ('{"source_id":"s","ingestion_timestamp":"t","data":{}}', True, {}),
    ],
)
def test_envelope_and_flat_events(spark, value, valid, payload):
    row = envelope.with_validity(envelope.decode(record(spark, value))).first()
    assert (row.is_valid, row.quality_score, row.raw_data) == (valid, 100 if valid else 0, payload)


def test_typed_payload(spark):
    decoded = envelope.decode(record(spark, '{"source_id":"s","ingestion_timestamp":"t","data":{"amount":"x","n":"7"}}'))
    row = envelope.typed(decoded, {"amount": "double", "n": "int", "gone": "string"}).first()
    assert (row.amount, row.n, row.gone) == (None, 7, None)


def test_bulk_cache_and_exports(spark, tmp_path):
    df = spark.createDataFrame([("t1", 4.5), ("t2", 3.0)], "id string, rating double")
    file_sinks.write_bulk(df, "tours", "id", str(tmp_path / "bulk"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "bulk")).collect())
    assert lines[0] == '{"id":"t1","rating":4.5}' and json.loads(lines[2])["index"] == {"_index": "tours", "_id": "t1"}
    for fmt in ("csv", "json"):
        file_sinks.export(df, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError):
        file_sinks.export(df, str(tmp_path / "x"), "xml")


def test_exposition(spark):
    rows = [("up", "gauge", 1.0, {"job": "a", "host": "h"}, "is it up", 1), ("n", "counter", 2.0, {}, "n metric", 1)]
    got = {r.name: r.value for r in file_sinks.exposition(spark.createDataFrame(rows, schemas.METRIC_SAMPLE)).collect()}
    assert got["n"] == "# HELP n n metric\n# TYPE n counter\nn 2.0"
    assert got["up"].endswith('up{host="h",job="a"} 1.0')


def test_positions_snap_to_a_grid(spark):
    df = spark.createDataFrame([(21.0004, 105.0005), (21.00041, 105.00051), (22.0, 105.0)], "latitude double, longitude double")
    got = clean.anonymise_position(df, 100)
    assert got.distinct().count() == 2
    assert all(abs(r.latitude - o.latitude) <= 100 / 111_320 for r, o in zip(got.collect(), df.collect()))


def test_sampling_is_stable_and_keeps_the_rate(spark):
    df = spark.range(20_000)
    kept = {r.id for r in clean.sample_by_key(df, "id", 0.25).collect()}
    assert kept == {r.id for r in clean.sample_by_key(df.repartition(7), "id", 0.25).collect()}
    assert 4_700 < len(kept) < 5_300 and clean.sample_by_key(df, "id", 1.0).count() == 20_000


def test_small_rates_keep_some_keys(spark):
    kept = clean.sample_by_key(spark.range(400_000), "id", 0.00005).count()
    assert 5 <= kept <= 45


def test_cells_keep_their_width_towards_the_poles(spark):
    df = spark.createDataFrame([(60.0, 10.0 + i * 0.0003) for i in range(200)], "latitude double, longitude double")
    cells = clean.anonymise_position(df, 100).select("longitude").distinct().count()
    # 200 steps of 0.0003 degrees are 3,340 m at 60 degrees north
    assert 32 <= cells <= 36


def test_pages_that_cannot_be_read_are_not_lost(spark, tmp_path):
    for name, text in {"a": '{"data": [{"id": 1}]}', "b": '{"data": [', "c": '[{"id": 2}, {"id": 3}]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r.id for r in extract.json_records(spark, str(tmp_path), "id int").collect()) == [1, 2, 3]
    lost = extract.unreadable_pages(spark, str(tmp_path), "id int").collect()
    assert [(r.source[-6:], r.message) for r in lost] == [("b.json", '{"data": [')]


def test_large_pages_are_read_whole(spark, tmp_path):
    record = '{"id": %d, "text": "' + "x" * 1000 + '"}'
    with open(tmp_path / "page.json", "w") as page:
        page.write('{"data": [' + ", ".join(record % i for i in range(140_000)) + "]}")
    got = extract.json_records(spark, str(tmp_path / "page.json"), "id int, text string")
    assert got.agg(F.count("*"), F.max("id")).first() == (140_000, 139_999)
    assert extract.unreadable_pages(spark, str(tmp_path / "page.json"), "id int, text string").isEmpty()


def test_whole_tables_need_ranges(spark):
    with pytest.raises(ValueError, match="partition column"):
        extract.extract(spark, {"source_type": "jdbc", "source_table": "t"})


def test_a_rerun_without_rows_leaves_none(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "b", "2024-01-01")], "v int, q string, processing_date string")
    read = lambda: spark.read.schema(rows.schema).parquet(str(tmp_path)).count()
    for part in ([], ["q"]):
        layers.replace_day(rows, str(tmp_path), "processing_date", "2024-01-01", part)
        layers.replace_day(rows, str(tmp_path), "processing_date", "2024-01-02", part)
        assert read() == 4
        layers.replace_day(rows.limit(0), str(tmp_path), "processing_date", "2024-01-01", part)
        assert read() == 2


def test_copies_without_time_lose(spark):
    schema = "event_id string, user_id bigint, event_type string, timestamp timestamp, amount double, region string"
    at = datetime(2024, 1, 1)
    rows = [("e1", 1, "a", None, 1.0, "r"), ("e1", 1, "a", at, 1.0, "r"), ("e2", None, "a", at, 1.0, "r"), ("e2", 2, "b", at, 1.0, "r")]
    raw = spark.createDataFrame(rows, schema)
    for df in (raw, raw.repartition(4), raw.orderBy(F.desc("user_id"))):
        kept = clean.clean_app_events(df, "2024-01-01").collect()
        assert sorted((r.event_id, r.user_id) for r in kept) == [("e1", 1), ("e2", 2)]
    valid = F.col("user_id").isNotNull() & F.col("timestamp").isNotNull() & (F.col("amount") >= 0)
    assert gold.reconcile(raw, "event_id", valid).first().records_after == 2
    users = spark.createDataFrame([(1, None), (1, "ann")], "user_id bigint, name string")
    assert [r.name for r in clean.clean_users(users, "user_id", "name").collect()] == ["ANN"]


def test_unlisted_event_types_are_counted(spark):
    rows = [("2024-01-01", 1, "r", t, 2, 0.0, 0.0, 0.0, None, None) for t in ("click", "odd", None)]
    schema = (
        "processing_date string, user_id bigint, region string, event_type string, events bigint, amount_sum double, "
        "amount_max double, amount_min double, first_ts timestamp, last_ts timestamp"
    )
    row = gold.tourism_pivot(spark.createDataFrame(rows, schema), ["click", "view"]).first()
    assert (row.click, row.view, row.other) == (2, 0, 4)


def test_pages_beyond_the_limit_are_refused(entities):
    from strata.operators import recommend, serving

    for limit in (0, 101):
        with pytest.raises(ValueError):
            serving.list_tours(entities.tours(), limit=limit)
    with pytest.raises(ValueError):
        recommend.recommendations(entities.tour_events(), None, entities.tours(), limit=21)


def test_platform_regions_are_those_of_tours(spark):
    from strata.operators import serving

    tours = spark.createDataFrame([("A", 1.0, 2.0)], "region string, price double, rating double")
    events = spark.createDataFrame([("A",), ("B",)], "region string")
    row = serving.platform_metrics(tours, events).first()
    assert (row.regions, row.regions_count, row.total_events) == (["A"], 1, 2)


def test_replayed_letters_keep_types_and_one_count(spark):
    from strata.operators import dlq

    text = '{"id":1,"retry_count":1,"n":1.5,"o":{"retry_count":7,"t":[true,null]},"s":"x"}'
    rows = spark.createDataFrame([(text, 1)], "original_message string, retry_count int")
    value = dlq.replay(rows).first().value
    assert json.loads(value) == json.loads(text) | {"retry_count": 2} and value.count("retry_count") == 2


def test_null_keys_are_keys(spark):
    from strata.operators import timeseries, windows

    rows = [(k, datetime(2024, 1, 1 + i // 2, 12 * (i % 2)), float(i)) for k in ("a", None) for i in range(6)]
    samples = spark.createDataFrame(rows, "topic string, ts timestamp, value double")
    grown = timeseries.increases(samples, ["topic"]).groupBy("topic").agg(F.sum("delta").alias("d")).collect()
    assert {r.topic: r.d for r in grown} == {"a": 5.0, None: 5.0}
    numbered = windows.with_session(samples, "topic", "ts", 1800).where("session_no is null")
    assert numbered.isEmpty()


def test_clickstream_json_is_flattened(spark):
    click = {
        "anonymous_id": "anon_0123456789", "event": "Page Viewed", "timestamp": "2024-01-01T00:00:00Z",
        "properties": {"url": "https://x.example/a/b?q=1"}, "context": {"ip": "1.1.1.1", "campaign": {"source": "feed"}},
    }
    parsed = spark.createDataFrame([(json.dumps(click),)], "j string").select(F.from_json("j", schemas.CLICKSTREAM).alias("c"))
    row = clean.enrich_clicks(parsed.select("c.*")).first()
    assert (row.visitor, row.is_anonymous, row.host, row.path, row.search) == ("anon_0123456789", True, "x.example", "/a/b", "q=1")
    assert row.campaign_source == "feed" and row.screen_width is None


def test_external_payload_per_type(spark):
    rows = [
        ("openweather", "weather", '{"current":{"temp":30.5},"forecast":[{"date":"2024-01-02","temp_max":31}]}'),
        ("openweather", "weather", '{"current":{"temp":10}}'),
        ("google_maps", "maps", '{"place_id":"p","rating":4.5}'),
    ]
    df = spark.createDataFrame(rows, "source string, data_type string, data string").select(
        "source", "data_type", "data", F.struct(F.lit("Hanoi").alias("city"), F.lit("VN").alias("country")).alias("location"),
        F.lit("t").alias("timestamp"),
    )
    assert sorted((r.temp, r.forecast_date) for r in clean.weather(df).collect()) == [(10.0, None), (30.5, "2024-01-02")]
    assert clean.external(df, "maps").first().data.rating == 4.5


def test_unwrap_changes(spark):
    message = {"payload": {"op": "d", "ts_ms": 5, "before": {"id": "7"}, "after": None, "source": {"db": "d", "table": "t"}}}
    row = cdc.unwrap(spark.createDataFrame([(json.dumps(message), 3)], "value string, offset bigint")).first()
    assert (row.op, row.ts_ms, row.offset, row.table, row.image) == ("d", 5, 3, "t", {"id": "7"})


def test_apply_changes_upserts_and_deletes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key int, v string")
    changes = spark.createDataFrame(
        [(1, "u", 1, 1, "A"), (1, "u", 1, 2, "AA"), (2, "d", 1, 1, None), (4, "c", 1, 1, "D"), (3, "u", 2, 1, None), (5, "r", 1, 1, "E")],
        "key int, op string, ts_ms bigint, offset bigint, v string",
    )
    now = lambda **o: {r.key: r.v for r in cdc.apply_changes(base, changes, "key", ["v"], **o).collect()}
    assert now() == {1: "AA", 3: None, 4: "D"}
    assert now(include_snapshot=True) == {1: "AA", 3: None, 4: "D", 5: "E"}


def test_dead_letters_by_kind(spark, tmp_path):
    df = spark.createDataFrame([('{"id":1}', ["missing:a", "type:b"], 1)], "m string, errors array<string>, retries int")
    at = F.lit("2024-01-01").cast("timestamp")
    schema = dlq.letters(df, "m", "s", at, errors="errors", retry_count=F.col("retries"))
    step = dlq.letters(df, "m", "s", at, step="parse", error_type="KeyError", error_message="a")
    sent = dlq.producer_failures(df, "m", "topic_x", "timeout", at)
    every = schema.unionByName(step).unionByName(sent)
    dlq.write(every, str(tmp_path / "dlq"))
    got = {r.queue: r for r in spark.read.schema(schemas.DEAD_LETTER).parquet(str(tmp_path / "dlq")).collect()}
    assert got[dlq.SCHEMA].error.message == "Schema validation failed: missing:a; type:b" and got[dlq.SCHEMA].retry_count == 2
    assert got[dlq.PROCESSING].metadata == {"processing_step": "parse"} and got[dlq.PROCESSING].retry_count == 1
    assert got[dlq.FAILED].source == "topic_x"


def test_replay(spark):
    rows = [('{"id":1}', 1), ('{"id":2}', 3), ("broken", 0)]
    replayed = dlq.replay(spark.createDataFrame(rows, "original_message string, retry_count int"))
    assert {r.original_message: r.outcome for r in replayed.collect()} == {'{"id":1}': "retried", '{"id":2}': "skipped", "broken": "failed"}
    assert json.loads(dlq.resend(replayed, "t").first().value) == {"id": 1, "retry_count": 2}
    assert {r.outcome: r.messages for r in dlq.replay_stats(replayed).collect()} == {"retried": 1, "skipped": 1, "failed": 1}


def test_lineage_events_and_graph(spark):
    at = datetime(2024, 1, 1)
    event = metadata.lineage_event(
        spark, "transformation", at, job_name="j", source={"layer": "bronze", "tables": ["a", "b"]},
        destination={"layer": "silver", "table": "c"}, row_count_in=10, row_count_out=8,
    )
    start = metadata.lineage_event(spark, "job_start", at, job_name="j")
    every = event.unionByName(start)
    assert event.first().data_loss_percentage == 20.0
    edges = metadata.lineage_edges(every)
    assert sorted((r.from_table, r.to_table) for r in edges.collect()) == [("a", "c"), ("b", "c")]
    assert metadata.lineage_graph_nodes(edges).count() == 3
    assert {r.event_type: r.events for r in metadata.lineage_counts(every).collect()} == {"transformation": 1, "job_start": 1}


def test_cyclic_lineage_ends(spark):
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "id bigint, parent_id bigint")
    got = {(r.id, r.ancestor_id): r.depth for r in metadata.ancestors(loop).collect()}
    assert got == {(1, 2): 1, (2, 1): 1, (3, 2): 1, (1, 1): 2, (2, 2): 2, (3, 1): 2}
    assert {r.id: r.depth for r in metadata.downstream(loop, 2).collect()} == {1: 1, 3: 1, 2: 2}


def test_lineage_deeper_than_any_limit(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 71)], "id bigint, parent_id bigint")
    assert metadata.downstream(chain, 0).agg(F.max("depth")).first()[0] == 70


def test_declared_transforms_refuse_unknown_types(spark):
    with pytest.raises(ValueError):
        clean.transform_by_spec(spark.range(1), [{"type": "magic"}])


@pytest.mark.parametrize("mode, kept", [("drop", [1]), ("keep", [1, 2])])
def test_null_amounts(spark, mode, kept):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id int, amount double")
    assert [r.id for r in clean.non_negative(df, "amount", mode).collect()] == kept
    assert clean.non_negative(df.drop("amount")).count() == 3
