"""Pass marks and edge cases of the quality checks."""

import json
from datetime import datetime, timedelta

import pytest

from strata.functions import contracts
from strata.operators import quality
from pyspark.sql import functions as F

PEOPLE = "id int, name string, email string"
NOW = datetime(2024, 3, 1, 12)


def rows(spark, checks_on, checks):
    return {r.field: r for r in quality.evaluate(checks_on, checks).collect()}


def test_complete_rows_pass(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"u{i}@x") for i in (1, 2, 3)], PEOPLE)
    got = rows(spark, df, quality.completeness(df, ["id", "name", "email"]))
    assert all(r.passed and r.percent == 100.0 for r in got.values())


def test_null_and_empty_are_missing(spark):
    df = spark.createDataFrame([(1, "a", "a@x"), (2, None, "b@x"), (3, "c", "")], PEOPLE)
    got = rows(spark, df, quality.completeness(df, ["id", "name", "email"]))
    assert (got["name"].bad_records, got["email"].bad_records) == (1, 1)
    assert got["id"].passed and not got["name"].passed and not got["email"].passed


def test_empty_table_is_not_complete(spark):
    df = spark.createDataFrame([], PEOPLE)
    got = rows(spark, df, quality.completeness(df, ["id", "name"]))
    assert all(r.total_records == 0 and r.percent == 0 and not r.passed for r in got.values())


def test_absent_field_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1, "a", "a@x")], PEOPLE)
    assert rows(spark, df, quality.completeness(df, ["phone"]))["phone"].bad_records == 1


@pytest.mark.parametrize(
    "ids, emails, bad, passed",
    [
        ([1, 2, 3], ["a", "b", "c"], (0, 0), True),
        ([1, 2, 2, 3], ["u1", "u2", "u2", "u1"], (1, 2), False),
    ],
)
def test_uniqueness(spark, ids, emails, bad, passed):
    df = spark.createDataFrame(list(zip(ids, emails)), "id int, email string")
    got = {r.field: r for r in quality.uniqueness(df, ["id", "email"]).collect()}
    assert (got["id"].bad_records, got["email"].bad_records) == bad
    assert got["id"].passed == got["email"].passed == passed


def test_uniqueness_ignores_nulls_but_divides_by_all_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "id int")
    r = quality.uniqueness(df, ["id"]).first()
    assert r.bad_records == 1 and r.percent == 25.0


@pytest.mark.parametrize("ages, bad, percent", [([25, 30, 22], 0, 0.0), ([25, 15, 105, 30], 2, 50.0)])
def test_range(spark, ages, bad, percent):
    df = spark.createDataFrame(list(enumerate(ages)), "id int, age int")
    r = quality.evaluate(df, quality.in_range("age", 18, 100)).first()
    assert (r.bad_records, r.percent, r.passed) == (bad, percent, bad == 0)


def test_range_ignores_nulls_and_text(spark):
    df = spark.createDataFrame([(1, "17"), (2, "x"), (3, None), (4, "20")], "id int, age string")
    assert quality.evaluate(df, quality.in_range("age", 18, 100)).first().bad_records == 1


def test_examples_keep_ten(spark):
    df = spark.range(1000).withColumn("age", F.lit(1))
    kept = quality.examples(df, quality.in_range("age", 18, 100), "id")
    assert [r.record_id for r in kept.collect()] == list(range(10))


def typed(spark, records):
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "json string")
    expected = {"id": "int", "name": "str", "age": "int"}
    return {r.field: r for r in quality.evaluate(df, quality.same_types("json", expected)).collect()}


def test_types_match(spark):
    got = typed(spark, [{"id": 1, "name": "U", "age": 25}, {"id": 2, "name": "V", "age": 30.5}])
    assert all(r.passed and r.bad_records == 0 for r in got.values())


def test_text_number_is_a_mismatch(spark):
    got = typed(spark, [{"id": 1, "name": "U", "age": "twenty-five"}, {"id": "2", "name": "V", "age": 30}])
    assert got["age"].bad_records == 1 and got["id"].bad_records == 1 and not got["age"].passed


def test_type_check_over_no_rows_fails_and_is_not_recorded(spark):
    empty = spark.createDataFrame([], "json string")
    result = quality.evaluate(empty, quality.same_types("json", {"id": "int"}))
    assert not result.first().passed
    assert quality.checks_passed(result).count() == 0


@pytest.mark.parametrize("hours, stale, passed", [([0, 1, 2], 0, True), ([48, 36, 12], 2, False)])
def test_freshness(spark, hours, stale, passed):
    df = spark.createDataFrame([((NOW - timedelta(hours=h)).isoformat(),) for h in hours], "ts string")
    r = quality.evaluate(df, quality.fresh("ts", NOW.isoformat())).first()
    assert (r.bad_records, r.passed) == (stale, passed)


def test_freshness_span_counts_what_is_no_time(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("nonsense",), (None,)], "ts string")
    r = quality.freshness_span(df, "ts", NOW.isoformat()).first()
    assert r.unparsable == 1 and r.oldest == r.newest


def summarise(spark, data, age_bound=18):
    df = spark.createDataFrame(data, "id int, name string, age int")
    results = quality.evaluate(
        df, quality.completeness(df, ["id", "name"]) + quality.in_range("age", age_bound, 100)
    ).unionByName(quality.uniqueness(df, ["id"]))
    return quality.summary(quality.checks_passed(results)).first()


def test_summary_all_passed(spark):
    s = summarise(spark, [(1, "A", 25), (2, "B", 30)])
    assert (s.total_checks, s.passed, s.failed, s.success_rate, s.status) == (3, 3, 0, 100.0, "PASS")


def test_summary_some_failed(spark):
    s = summarise(spark, [(1, None, 15), (2, "B", 30)])
    assert s.failed == 2 and s.success_rate < 100 and s.status == "FAIL"


def test_table_checks_grades(spark):
    df = spark.createDataFrame([(1, "a")] * 2 + [(i, None if i < 60 else "b") for i in range(2, 100)], "id int, v string")
    got = {r.check: r.status for r in quality.table_checks(df, "t", {"r": {"type": "range", "column": "id", "max": 50}}).collect()}
    assert got == {"non_empty_dataset": "PASSED", "duplicate_rows": "WARNING", "null_values": "FAILED", "r": "FAILED"}


def test_table_checks_over_no_rows(spark):
    got = quality.table_checks(spark.createDataFrame([], "id int"), "t").collect()
    assert [(r.check, r.status) for r in got] == [("non_empty_dataset", "FAILED")]


def test_warning_lowers_the_score(spark):
    rows = [("t", "a", "PASSED", ""), ("t", "b", "WARNING", "")]
    df = spark.createDataFrame(rows, "dataset string, check string, status string, detail string")
    assert quality.score(df).first().quality_score == 50.0


def test_expected_columns_and_gate(spark):
    df = spark.createDataFrame([(1, 2)], "a int, extra int")
    result = quality.expected_columns(df, ["a", "b"], "t")
    assert {r.check: (r.status, r.detail) for r in result.collect()} == {
        "expected_columns_exist": ("FAILED", "b"),
        "no_extra_columns": ("WARNING", "extra"),
    }
    with pytest.raises(quality.QualityGateError, match="expected_columns_exist"):
        quality.gate(result)
    quality.gate(quality.expected_columns(df, ["a"], "t"))


def test_schema_changes(spark):
    old = spark.createDataFrame([], "a int, b string, c double").schema
    new = spark.createDataFrame([], "a bigint, b string, d string").schema
    got = {r.field: (r.change, r.breaking) for r in quality.schema_changes(spark, old, new).collect()}
    assert got == {"a": ("retyped", True), "c": ("removed", True), "d": ("added", False)}


def found(spark, record, contract):
    df = spark.createDataFrame([(record if isinstance(record, str) else json.dumps(record),)], "j string")
    return contracts.validate(df, "j", contract).first().errors


GOOD = {
    "event_id": "evt_0123456789", "user_id": 5, "session_id": "sess_0123456789", "event_type": "click",
    "timestamp": "2024-01-01T00:00:00Z", "device": {"type": "mobile", "os": "iOS"}, "location": {"country": "VN"},
}


def test_contract_accepts_a_good_event(spark):
    assert found(spark, GOOD, contracts.APP_EVENT) == []


@pytest.mark.parametrize(
    "change, code",
    [
        ({"event_id": "evt_1"}, "pattern:event_id"),
        ({"user_id": 0}, "minimum:user_id"),
        ({"user_id": "5"}, "type:user_id"),
        ({"user_id": 5.5}, "type:user_id"),
        ({"event_type": "jump"}, "enum:event_type"),
        ({"device": {"type": "mobile"}}, "missing:device.os"),
        ({"location": {"country": "VN", "latitude": 91}}, "maximum:location.latitude"),
        ({"amount": -1}, "minimum:amount"),
        ({"session_id": None}, "type:session_id"),
    ],
)
def test_contract_names_the_broken_rule(spark, change, code):
    assert found(spark, GOOD | change, contracts.APP_EVENT) == [code]


def test_contract_missing_object_does_not_report_its_fields(spark):
    assert found(spark, {k: v for k, v in GOOD.items() if k != "device"}, contracts.APP_EVENT) == ["missing:device"]


def test_unreadable_record(spark):
    assert found(spark, "{oops", contracts.APP_EVENT) == ["unreadable"]


@pytest.mark.parametrize(
    "kind, good, bad",
    [
        ("date-time", ["2024-02-29T10:00:00Z", "2024-01-01 10:00:00.5", "2024-01-01T10:00:00+07:00"], ["2024-01-01", "t", "2023-02-30T10:00:00Z"]),
        ("date", ["2024-02-29"], ["2023-02-29", "1.2.2024"]),
        ("uri", ["https://x.example/a?b=c", "mailto:a@b"], ["/a/b", "https://x y", ""]),
        ("ipv4", ["0.0.0.0", "255.10.1.99"], ["256.1.1.1", "1.2.3", "1.2.3.4.", "::1"]),
    ],
)
def test_formats(spark, kind, good, bad):
    contract = [contracts.Field("v", "string", True, format=kind)]
    for text in good:
        assert found(spark, {"v": text}, contract) == []
    for text in bad:
        assert found(spark, {"v": text}, contract) == ["format:v"]
    assert contracts.from_json_schema({"properties": {"v": {"type": "string", "format": kind}}})[0].format == kind


def test_contract_from_json_schema_and_avro(spark):
    schema = {
        "required": ["a"],
        "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": ["string", "null"]},
                       "c": {"type": "object", "required": ["d"], "properties": {"d": {"type": "boolean"}}}},
    }
    fields = contracts.from_json_schema(schema)
    assert [f.path for f in fields] == ["a", "b", "c", "c.d"]
    assert found(spark, {"a": 1, "b": None, "c": {"d": True}}, fields) == []
    assert found(spark, {"a": 0, "c": {}}, fields) == ["minimum:a", "missing:c.d"]
    avro = contracts.from_avro({"fields": [{"name": "x"}, {"name": "y", "default": None}]})
    df = spark.createDataFrame([('{"y":1}',), ('{"x":null}',)], "j string").select(F.parse_json("j").alias("r"))
    got = [r[0] for r in df.select(contracts.required_errors(F.col("r"), avro)).collect()]
    assert got == [["missing:x"], []]


def test_change_and_click_contracts(spark):
    change = {"source": {}, "payload": {"op": "x", "ts_ms": 1, "before": None, "after": {"id": 1},
              "source": {"connector": "mysql", "db": "d", "table": "t", "ts_ms": 1}}}
    assert found(spark, change, contracts.CHANGE_EVENT) == ["enum:payload.op"]
    click = {"anonymous_id": "anon_0123456789", "user_id": None, "event": "Page Viewed", "timestamp": "2024-01-01T00:00:00Z",
             "context": {"ip": "1.1.1.1", "user_agent": "x", "locale": "EN"}}
    assert found(spark, click, contracts.CLICKSTREAM) == ["pattern:context.locale"]
