"""Schemas and addresses of nested documents, by literals."""

import json

import pytest
from pyspark.sql import functions as F

from geostrata.functions.documents import harvest
from geostrata.functions.schema import judged, skipped_keywords

SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["id", "size"],
    "properties": {
        "id": {"type": "string", "pattern": "^p[0-9]+$", "maxLength": 4},
        "size": {"type": "integer", "minimum": 1, "maximum": 50},
        "tags": {"type": "array", "items": {"enum": ["a", "b", 3, None, {"k": [1]}]}, "uniqueItems": True, "minItems": 1, "maxItems": 4},
        "span": {"$ref": "#/$defs/span"},
        "note": {"type": ["string", "null"], "minLength": 1},
        "frames": {"type": "array", "items": {"$ref": "#/$defs/span"}},
        "open": {"additionalProperties": {"type": "boolean"}, "maxProperties": 2},
        "form": {"allOf": [{"type": "object"}, {"if": {"properties": {"kind": {"const": "x"}}, "required": ["kind"]}, "then": {"required": ["x"]}, "else": {"not": {"required": ["x"]}}}]},
        "either": {"anyOf": [{"type": "boolean"}, {"multipleOf": 2.5}]},
    },
    "$defs": {
        "span": {
            "type": "object",
            "required": ["a", "b"],
            "properties": {"a": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 9}, "b": {"oneOf": [{"type": "string"}, {"minimum": 5, "type": "number"}, {"type": "integer"}]}},
        }
    },
}
BASE = {"id": "p1", "size": 3}
CASES = [
    ({}, []),
    ({"size": 3.0}, []),
    ({"size": 3.5}, ["/size type"]),
    ({"size": "3"}, ["/size type"]),
    ({"size": True}, ["/size type"]),
    ({"size": 51}, ["/size maximum"]),
    ({"size": 0}, ["/size minimum"]),
    ({"id": "q"}, ["/id pattern"]),
    ({"id": "p12345"}, ["/id maxLength"]),
    ({"id": None}, ["/id type"]),
    ({"extra": 1, "more": {}}, ["/extra additionalProperties", "/more additionalProperties"]),
    ({"tags": ["a", 3, None, {"k": [1]}]}, []),
    ({"tags": ["a", 3.0]}, []),
    ({"tags": ["a", "a"]}, ["/tags uniqueItems"]),
    ({"tags": []}, ["/tags minItems"]),
    ({"tags": ["a", "b", 3, None, "c"]}, ["/tags maxItems", "/tags/4 enum"]),
    ({"tags": {"a": 1}}, ["/tags type"]),
    ({"span": {"a": 1, "b": "x"}}, []),
    ({"span": {"a": 1, "b": 7.5}}, []),
    ({"span": {"a": 1, "b": 7}}, ["/span/b oneOf"]),
    ({"span": {"a": 1, "b": 2.5}}, ["/span/b oneOf"]),
    ({"span": {"a": 0}}, ["/span/b required", "/span/a exclusiveMinimum"]),
    ({"frames": [{"a": 1, "b": "x"}, {"a": 9, "b": "x"}, 5]}, ["/frames/1/a exclusiveMaximum", "/frames/2 type"]),
    ({"note": None}, []),
    ({"note": ""}, ["/note minLength"]),
    ({"open": {"a": True, "b": 1}}, ["/open/b type"]),
    ({"open": {"a": True, "b": True, "c": True}}, ["/open maxProperties"]),
    ({"form": {"kind": "x"}}, ["/form/x required"]),
    ({"form": {"kind": "y", "x": 1}}, ["/form not"]),
    ({"form": {"kind": "y"}}, []),
    ({"either": 7.5}, []),
    ({"either": 7}, ["/either anyOf"]),
]


def test_every_keyword_by_literals(spark):
    rows = [(i, json.dumps(BASE | more)) for i, (more, _) in enumerate(CASES)]
    rows += [(100, "[1]"), (101, "{broken"), (102, None), (103, '{"size": 3}')]
    df = spark.createDataFrame(rows, "i int, d string").repartition(3).select("i", judged(F.col("d"), SCHEMA).alias("j"))
    got = {r.i: (r.j.state, [f"{f.path} {f.rule}" for f in r.j.findings]) for r in df.collect()}
    for i, (more, want) in enumerate(CASES):
        assert (got[i][0], sorted(got[i][1])) == ("failed" if want else "passed", sorted(want)), more
    assert got[100] == ("failed", [" type"]) and got[101] == ("failed", [" parse"]) and got[102] == ("skipped", []) and got[103] == ("failed", ["/id required"])


def test_skipped_is_not_passed(spark):
    schema = {"properties": {"url": {"type": "string", "format": "uri"}, "at": {"prefixItems": []}}}
    assert skipped_keywords(schema) == ["format", "prefixItems"] and skipped_keywords(SCHEMA) == []
    rows = spark.createDataFrame([('{"url": "x"}',), ('{"url": 5}',)], "d string").select(judged(F.col("d"), schema).alias("j")).collect()
    assert [(r.j.state, r.j.skipped) for r in rows] == [("skipped", ["format", "prefixItems"]), ("failed", ["format", "prefixItems"])]


def test_a_schema_without_bound_is_an_error(spark):
    for schema in ({"$ref": "#"}, {"properties": {"a": {"$ref": "#/$defs/n"}}, "$defs": {"n": {"items": {"$ref": "#/$defs/n"}}}}, {"$ref": "other.json"}):
        with pytest.raises(ValueError):
            judged(F.lit("{}"), schema)


def test_harvest_walks_nested_documents(spark):
    docs = [
        ('{"b":"https://x.example/1","geometry":{"c":[{"u":"https://no.example"}],"s":"}","d":{"e":[[]]}},"a":["t } https://y.example/2 z","\\\\"]}', ["https://x.example/1", "https://y.example/2"]),
        ('{"k":[{"geometry":"https://no.example","d":"https:\\/\\/z.example/3"},{"geometry":["https://no.example",[{}]],"e":"https://z.example/3 https://q.example/a"}]}', ["https://z.example/3", "https://q.example/a"]),
        ('{"x":"geometry","y":"https://w.example","geometry":null,"z":"https://v.example"}', ["https://w.example", "https://v.example"]),
        ('{"https://key.example":1,"q":"say \\"https://in.example/5\\" now"}', ["https://in.example/5"]),
        ("{}", []),
        ('"https://s.example"', ["https://s.example"]),
        (None, None),
    ]
    got = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(docs)], "i int, d string").select("i", harvest(F.col("d")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [want for _, want in docs]
