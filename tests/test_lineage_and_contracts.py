"""Closure of lineage, alternatives of contracts and types of payloads."""

import json

import pytest
from pyspark.sql import functions as F

from strata.functions import contracts
from strata.operators import metadata, quality


def reach(edges):
    """{(a, b): steps} by walking from every node."""
    out = {}
    onward = {}
    for a, b in edges:
        onward.setdefault(a, set()).add(b)
    for start in onward:
        level, steps = {start}, 0
        while level:
            steps += 1
            level = {b for a in level for b in onward.get(a, ())} - {b for (s, b) in out if s == start}
            out |= {(start, b): steps for b in level}
    return out


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3), (3, 4), (1, 4), (4, 5)], [(1, 2), (2, 1)], [(1, 1), (1, 2)], [(1, 2), (2, 3), (3, 1), (3, 4), (5, 2)], [],
        [(k, k + 1) for k in range(17)] + [(3, 14), (9, 2)],
    ],
)
def test_closure_of_any_graph(spark, edges):
    frame = spark.createDataFrame([(a, b) for a, b in edges] + [(None, 1), (1, None)] + edges[:1], "a long, b long")
    got = {(r.a, r.b): r.depth for r in metadata.closure(frame, ["a"], ["b"]).collect()}
    assert got == reach(edges)


def test_a_path_of_a_thousand_nodes_takes_eleven_rounds(spark, monkeypatch):
    rounds = []
    cut = metadata.cut_lineage
    monkeypatch.setattr(metadata, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    edges = spark.range(999).select(
        F.lit("l").alias("from_layer"), F.col("id").alias("from_table"), F.lit("l").alias("to_layer"), (F.col("id") + 1).alias("to_table")
    )
    found = metadata.lineage_closure(edges)
    assert found.count() == 999 * 1000 // 2
    assert found.agg(F.max("depth")).first()[0] == 999
    assert len(rounds) <= 11


WEATHER = {"current": {"temp": 20, "humidity": 50}, "forecast": [{"date": "2024-01-02", "temp_min": 1.5}]}
PLACE = {"place_id": "x", "rating": 4.5}
POST = {"post_id": "p", "sentiment": "neutral", "engagement": {"likes": 3}}
RECORD = {"source": "twitter", "data_type": "social", "timestamp": "2024-01-01T00:00:00Z"}
SPOILED = {"current": 1, "rating": 7, "sentiment": "bad"}


@pytest.mark.parametrize(
    "data, code",
    [
        (WEATHER | {"rating": 7, "sentiment": "bad"}, []), (PLACE | {"current": 1, "text": 5}, []), (POST | {"current": 1, "name": 5}, []),
        (SPOILED, ["none:data"]), ({}, ["several:data"]), (WEATHER, ["several:data"]), (WEATHER | PLACE | POST, ["several:data"]),
        ({"forecast": [{"date": "2024-01-02"}, {"date": "x"}], "rating": 7, "sentiment": "bad"}, ["none:data"]),
        ({"forecast": [{"precipitation": -1}], "rating": 7, "sentiment": "bad"}, ["none:data"]),
        ({"forecast": [3], "rating": 7, "sentiment": "bad"}, ["none:data"]), ({"forecast": [], "rating": 7, "sentiment": "bad"}, []),
        ({"forecast": "soon", "rating": 7, "sentiment": "bad"}, ["none:data"]), ("text", ["type:data"]), (None, ["type:data"]),
    ],
)
def test_every_alternative(spark, data, code):
    df = spark.createDataFrame([(json.dumps(RECORD | {"data": data}),)], "j string")
    row = contracts.validate(df, "j", contracts.EXTERNAL, [contracts.EXTERNAL_DATA]).first()
    assert row.errors == code and row.is_valid == (not code)


def test_alternatives_from_a_schema(spark):
    schema = {
        "properties": {
            "kind": {"type": "string"},
            "body": {
                "type": "object",
                "properties": {
                    "data": {
                        "oneOf": [
                            {"properties": {"a": {"type": "integer"}}, "required": ["a"]},
                            {"properties": {"list": {"type": "array", "items": {"properties": {"b": {"type": "string"}}}}}, "required": ["list"]},
                        ]
                    }
                },
            },
        }
    }
    found = contracts.alternatives(schema)
    assert [c.path for c in found] == ["body.data"]
    assert [f.path for f in found[0].options[1]] == ["list", "list[].b"]
    cases = {'{"a":1}': [], '{"list":[{"b":"x"}]}': [], '{"a":1,"list":[]}': ["several:body.data"], '{"list":[{"b":2}]}': ["none:body.data"]}
    for data, code in cases.items():
        df = spark.createDataFrame([(f'{{"body":{{"data":{data}}}}}',)], "j string")
        assert contracts.validate(df, "j", contracts.from_json_schema(schema), found).first().errors == code


def test_types_of_payloads(spark):
    rows = ['{"a":1,"o":{"x":"t","y":null}}', '{"a":"1","o":{"x":2.5}}', '{"a":12345678901234567890123,"b":[{"c":1}],"o":[]}', '{"b":true}', "{oops", None, "[1]"]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    seen = {(r.path, r.type): r.seen for r in quality.observed_types(df, "j").collect()}
    assert seen == {
        ("a", "integer"): 2, ("a", "string"): 1, ("o", "object"): 2, ("o", "array"): 1, ("b", "array"): 1, ("b", "boolean"): 1,
        ("o.x", "string"): 1, ("o.x", "number"): 1, ("o.y", "null"): 1,
    }
    contract = [
        contracts.Field("a", "number"), contracts.Field("o", "object"), contracts.Field("o.y", "string", nullable=True), contracts.Field("o.z", "string"),
        contracts.Field("b", "boolean"), contracts.Field("b[].c", "integer"),
    ]
    got = {(r.path, r.type): (r.state, r.seen) for r in quality.type_drift(df, "j", contract).collect()}
    assert got == {
        ("a", "integer"): ("expected", 2), ("a", "string"): ("retyped", 1), ("o", "object"): ("expected", 2), ("o", "array"): ("retyped", 1),
        ("o.x", "string"): ("added", 1), ("o.x", "number"): ("added", 1), ("o.y", "null"): ("expected", 1), ("o.z", None): ("missing", 0),
        ("b", "array"): ("retyped", 1), ("b", "boolean"): ("expected", 1),
    }
