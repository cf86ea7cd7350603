"""Compiled schemas on broken documents, each with the errors that it has."""

import json

from pyspark.sql import functions as F

from docloom.operators import schema as S

NODE = {
    "type": "object", "additionalProperties": False, "required": ["id", "type"],
    "properties": {
        "id": {"type": "string", "pattern": "^s[0-9]+$"}, "type": {"enum": ["page", "quiz"]}, "title": {"$ref": "#/$defs/title"}, "due": {"type": "string", "format": "date"},
        "content": {"type": "object"}, "weight": {"type": "number", "exclusiveMinimum": 0, "maximum": 10}, "tags": {"type": "array", "items": {"type": "string"}, "uniqueItems": True, "maxItems": 2},
        "when": {"oneOf": [{"type": "null"}, {"type": "integer"}, {"type": "number", "minimum": 5}]},
    },
    "allOf": [{"if": {"properties": {"type": {"const": "quiz"}}, "required": ["type"]}, "then": {"required": ["content"], "properties": {"content": {"$ref": "#/$defs/quiz"}}}}],
}
ROOT = {
    "type": "object", "additionalProperties": False, "required": ["nodes"],
    "properties": {"nodes": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/node"}}, "note": {"anyOf": [{"type": "string"}, {"type": "boolean"}]}},
    "$defs": {"node": NODE, "title": {"type": "string", "minLength": 1, "maxLength": 5}, "quiz": {"type": "object", "additionalProperties": False, "minProperties": 1, "properties": {"count": {"type": "integer", "minimum": 1}, "a/b": {"type": "string"}}}},
}
PAGE = {"id": "s1", "type": "page"}
CASES = [
    ({"nodes": [PAGE]}, []),
    ([], [("", "type")]),
    ({}, [("", "required")]),
    ({"nodes": []}, [("/nodes", "minItems")]),
    ({"nodes": [{**PAGE, "id": "x"}, {**PAGE, "title": ""}, {**PAGE, "title": "éééééé"}]}, [("/nodes/0/id", "pattern"), ("/nodes/1/title", "minLength"), ("/nodes/2/title", "maxLength")]),
    ({"nodes": [{"id": "s1"}, {"id": 5, "type": "poem"}, None]}, [("/nodes/0", "required"), ("/nodes/1/id", "type"), ("/nodes/1/type", "enum"), ("/nodes/2", "type")]),
    ({"nodes": [{**PAGE, "due": "2024-02-30"}, {**PAGE, "due": "2024-02-29"}]}, [("/nodes/0/due", "format")]),
    ({"nodes": [{**PAGE, "weight": 0}, {**PAGE, "weight": 10.5}, {**PAGE, "weight": "5"}, {**PAGE, "weight": 3}]}, [("/nodes/0/weight", "exclusiveMinimum"), ("/nodes/1/weight", "maximum"), ("/nodes/2/weight", "type")]),
    ({"nodes": [{**PAGE, "tags": ["a", "a"]}, {**PAGE, "tags": ["a", "b", 3]}]}, [("/nodes/0/tags", "uniqueItems"), ("/nodes/1/tags", "maxItems"), ("/nodes/1/tags/2", "type")]),
    ({"nodes": [{**PAGE, "when": 3}, {**PAGE, "when": 7}, {**PAGE, "when": None}, {**PAGE, "when": "x"}]}, [("/nodes/1/when", "oneOf"), ("/nodes/3/when", "oneOf")]),
    ({"nodes": [{"id": "s1", "type": "quiz"}, {"id": "s2", "type": "quiz", "content": {"count": 0}}, {"id": "s3", "type": "quiz", "content": {}}, {**PAGE, "content": {"any": 1}}]}, [("/nodes/0", "required"), ("/nodes/1/content/count", "minimum"), ("/nodes/2/content", "minProperties")]),
    ({"nodes": [{"id": "s2", "type": "quiz", "content": {"a/b": 1, "x": 2}}], "note": 4, "more": 1}, [("", "additionalProperties"), ("/note", "anyOf"), ("/nodes/0/content", "additionalProperties"), ("/nodes/0/content/a~1b", "type")]),
]


def frame(spark, documents):
    return spark.createDataFrame([(n, None if d is None else json.dumps(d)) for n, d in enumerate(documents)], "n int, j string").select("n", F.parse_json("j").alias("v"))


def test_errors_of_broken_documents(spark):
    rows = frame(spark, [d for d, _ in CASES]).select("n", S.errors(F.col("v"), ROOT).alias("e")).collect()
    for r in rows:
        assert sorted((e["path"], e["keyword"]) for e in r["e"]) == sorted(CASES[r["n"]][1]), CASES[r["n"]][0]


def test_extra_keys_are_stripped_or_all_stay(spark):
    quiz = {"id": "s2", "type": "quiz", "content": {"count": 1}}
    cases = [
        ({"nodes": [PAGE], "x": 1}, {"nodes": [PAGE]}, 1),
        ({"nodes": [{**PAGE, "y": {"z": 1}, "title": "T"}, {**quiz, "content": {"count": 1, "extra": [1], "more": None}}]}, {"nodes": [{**PAGE, "title": "T"}, quiz]}, 3),
        ({"nodes": [{**quiz, "content": {"number": 3}}]}, None, 0),  # a misnamed key: empty without it, so it is undone
        ({"nodes": [{**PAGE, "id": "x", "extra": 1}]}, None, 0),  # another error
        ({"nodes": [{**PAGE, "e": 1} for _ in range(50)]}, {"nodes": [PAGE] * 50}, 50),
        ({"nodes": [{**PAGE, "e": 1} for _ in range(51)]}, None, 0),
        ({"nodes": [{**PAGE, "content": {"free": 1}}]}, None, 0),  # valid as it is
        (None, None, 0),
    ]
    got = frame(spark, [c[0] for c in cases]).select("n", S.stripped(F.col("v"), ROOT).alias("s")).select("n", F.to_json("s.output").alias("output"), "s.errors", "s.removed").collect()
    for r in got:
        before, after, removed = cases[r["n"]]
        want = before if after is None else after
        assert (None if r["output"] is None else json.loads(r["output"])) == want and r["removed"] == removed, before
        assert (r["errors"] is None) == (before is None)
    assert {r["n"] for r in got if r["errors"]} == {2, 3, 5}
