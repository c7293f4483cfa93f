"""The schema compiler: what conforms, and each kind of problem by record and field."""

import json

import pytest
from evidex.operators import schema as S

RECORD = {
    "type": "object",
    "required": ["id", "usage", "confidence"],
    "additionalProperties": False,
    "$defs": {"source": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string", "pattern": "^https?://"}, "authority": {"type": "integer", "minimum": 0, "maximum": 100}}}},
    "properties": {
        "id": {"type": "string", "minLength": 1},
        "usage": {"enum": ["cite", "caution", "historical"]},
        "confidence": {"type": "number", "minimum": 0, "maximum": 1},
        "historical": {"type": "boolean"},
        "level": {"type": "integer", "exclusiveMaximum": 6},
        "version": {"anyOf": [{"type": "string"}, {"type": "null"}]},
        "tags": {"type": "array", "items": {"type": "string", "maxLength": 5}, "maxItems": 3},
        "sources": {"type": "array", "items": {"$ref": "#/$defs/source"}},
        "kind": {"const": "item"},
        "odd.name": {"type": ["string", "null"]},
    },
}
GOOD = {"id": "k1", "usage": "cite", "confidence": 0.8}


def found(spark, lines, schema=RECORD):
    rows = spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(lines)], "n int, line string")
    return sorted((r.n, r.record, r.field, r.problem) for r in S.problems(rows, "line", schema, ["n"]).collect())


def test_conforming(spark):
    full = GOOD | {"historical": False, "level": 5, "version": None, "tags": ["a", "b"], "sources": [{"url": "https://a.org", "authority": 3}], "kind": "item", "odd.name": None}
    assert found(spark, [GOOD, full, GOOD | {"level": 2.0, "confidence": 1, "version": "2", "tags": [], "sources": [{"url": "http://b"}]}]) == []


CASES = [
    (GOOD | {"usage": "trust me"}, "usage", "is not one of cite, caution, historical"),
    (GOOD | {"usage": None}, "usage", "is not one of cite, caution, historical"),
    (GOOD | {"confidence": "high"}, "confidence", "is not of type number"),
    (GOOD | {"confidence": 1.5}, "confidence", "is above 1"),
    (GOOD | {"confidence": -1}, "confidence", "is below 0"),
    ({k: v for k, v in GOOD.items() if k != "usage"}, "usage", "is missing"),
    (GOOD | {"id": ""}, "id", "is shorter than 1"),
    (GOOD | {"historical": 0}, "historical", "is not of type boolean"),
    (GOOD | {"level": 2.5}, "level", "is not of type integer"),
    (GOOD | {"level": 6}, "level", "is not below 6"),
    (GOOD | {"version": 3}, "version", "is none of what is allowed"),
    (GOOD | {"tags": ["ok", "too long", 5]}, "tags[1]", "is longer than 5"),
    (GOOD | {"tags": list("abcd")}, "tags", "has more than 3"),
    (GOOD | {"tags": "a"}, "tags", "is not of type array"),
    (GOOD | {"sources": [{"url": "https://a"}, {"url": "ftp://a"}]}, "sources[1].url", "does not match ^https?://"),
    (GOOD | {"sources": [{"authority": 101}]}, "sources[0].url", "is missing"),
    (GOOD | {"sources": ["x"]}, "sources[0]", "is not of type object"),
    (GOOD | {"kind": "other"}, "kind", "is not one of item"),
    (GOOD | {"extra": 1}, "extra", "is not declared"),
    (GOOD | {"odd.name": 4}, "odd.name", "is not of type string or null"),
    ([1], "", "is not of type object"),
]


def test_problems_by_record_and_field(spark):
    got = found(spark, [c for c, _, _ in CASES])
    for n, (line, field, problem) in enumerate(CASES):
        record = line.get("id") if isinstance(line, dict) else None
        assert (n, record, field, problem) in got, (n, field)
    assert {(f, p) for n, _, f, p in got if n == 11} == {("tags[1]", "is longer than 5"), ("tags[2]", "is not of type string")}
    assert {(f, p) for n, _, f, p in got if n == 15} == {("sources[0].url", "is missing"), ("sources[0].authority", "is above 100")}
    assert all(sum(g[0] == n for g in got) == 1 for n in range(len(CASES)) if n not in (11, 15))


def test_lines_that_are_no_records(spark):
    assert found(spark, ["{not json", None, ""]) == [(n, None, "", "is not valid JSON") for n in range(3)]
    assert found(spark, ["[]", "7", "null"], {"type": ["array", "null"], "items": {}}) == [(1, None, "", "is not of type array or null")]


def test_schemas_that_cannot_be_compiled(spark):
    for bad in ({"typo": 1}, {"type": "text"}, {"$defs": {"a": {"properties": {"x": {"$ref": "#/$defs/a"}}}}, "$ref": "#/$defs/a"}, {"additionalProperties": {"type": "string"}, "type": "object"}):
        with pytest.raises(ValueError):
            found(spark, ["{}"], bad)
