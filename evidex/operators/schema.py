"""A compiler from a declared schema to columns: every record's problems, each named by its field.

The schema is a JSON Schema: types, enums, constants, required and unknown fields, patterns, bounds of numbers, texts and
lists, nested objects and lists, alternatives, and references to its definitions. It becomes one expression over a parsed
record, so validation is one pass over the lines, within the JVM.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEMS = "array<struct<field:string,problem:string>>"
#: Keywords that say nothing about what is valid.
SILENT = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "format"}
KNOWN = {"type", "enum", "const", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "anyOf", "oneOf", "$ref"}


def _none() -> Column:
    return F.array().cast(PROBLEMS)


def _one(wrong: Column, field: Column, problem: Column | str) -> Column:
    """The problem, where `wrong` holds."""
    text = F.lit(problem) if isinstance(problem, str) else problem
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.struct(field.alias("field"), text.alias("problem")))).otherwise(_none())


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is(value: Column, kind: str) -> Column:
    k = _kind(value)
    whole = F.try_variant_get(value, "$", "decimal(38, 18)")
    tests = {
        "string": k == "STRING", "boolean": k == "BOOLEAN", "null": k == "VOID", "object": k.startswith("OBJECT"), "array": k.startswith("ARRAY"),
        "number": k.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "integer": (k == "BIGINT") | (k.rlike("^(DOUBLE|DECIMAL)") & (whole == F.floor(whole))),
    }
    if kind not in tests:
        raise ValueError(f"unknown type {kind}")
    return tests[kind]


def _child(value: Column, name: str) -> Column:
    """A field of an object; null where it is missing."""
    quote = "'" if "'" not in name else '"'
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def compiled(schema: dict, value: Column, field: Column | None = None, root: dict | None = None, within: tuple[str, ...] = ()) -> Column:
    """The problems of a variant `value` as an array of (field, problem); empty where it conforms. Fields are named by their
    path, places in lists in brackets. A keyword that the compiler doesn't know is an error, as is a recursive definition."""
    root = schema if root is None else root
    field = F.lit("") if field is None else field
    if unknown := set(schema) - KNOWN - SILENT:
        raise ValueError(f"unknown keywords {sorted(unknown)}")
    if ref := schema.get("$ref"):
        if ref in within:
            raise ValueError(f"{ref} is recursive")
        target = root
        for part in ref.removeprefix("#/").split("/"):
            target = target[part]
        return compiled(target, value, field, root, (*within, ref))
    for word in ("anyOf", "oneOf"):
        if word in schema:
            fits = [(F.size(compiled(s, value, field, root, within)) == 0).cast("int") for s in schema[word]]
            n = sum(fits[1:], fits[0])
            return _one(n == 0 if word == "anyOf" else n != 1, field, "is none of what is allowed" if word == "anyOf" else "is not just one of what is allowed")
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds is None:
        kinds = ["object"] if "properties" in schema or "required" in schema else ["array"] if "items" in schema else []
    right = F.lit(not kinds)
    for k in kinds:
        right = right | _is(value, k)
    parts: list[Column] = []
    plain = F.try_variant_get(value, "$", "string")
    if "enum" in schema or "const" in schema:
        allowed = schema.get("enum", [schema.get("const")])
        same = F.lit(False)
        for a in allowed:
            same = same | (F.coalesce(_is(value, "string") & (plain == a), F.lit(False)) if isinstance(a, str) else F.coalesce(F.to_json(value) == json.dumps(a), F.lit(False)))
        parts.append(_one(~same, field, "is not one of " + ", ".join(map(str, allowed))))
    if "pattern" in schema:
        parts.append(_one(_is(value, "string") & ~plain.rlike(schema["pattern"]), field, f"does not match {schema['pattern']}"))
    number, length = F.try_variant_get(value, "$", "double"), F.length(plain)
    list_ = F.when(_is(value, "array"), F.try_variant_get(value, "$", "array<variant>"))
    for word, test, kind, says in (
        ("minimum", lambda b: number < b, "number", "is below"), ("maximum", lambda b: number > b, "number", "is above"), ("exclusiveMinimum", lambda b: number <= b, "number", "is not above"), ("exclusiveMaximum", lambda b: number >= b, "number", "is not below"),
        ("minLength", lambda b: length < b, "string", "is shorter than"), ("maxLength", lambda b: length > b, "string", "is longer than"), ("minItems", lambda b: F.size(list_) < b, "array", "has fewer than"), ("maxItems", lambda b: F.size(list_) > b, "array", "has more than"),
    ):
        if word in schema:
            parts.append(_one(_is(value, kind) & test(schema[word]), field, f"{says} {schema[word]}"))
    is_object = _is(value, "object")
    properties = schema.get("properties", {})
    below = lambda name: F.when(field == "", F.lit(name)).otherwise(F.concat(field, F.lit(f".{name}")))
    for name in schema.get("required", []):
        parts.append(_one(is_object & _child(value, name).isNull(), below(name), "is missing"))
    for name, inner in properties.items():
        child = _child(value, name)
        parts.append(F.when(is_object & child.isNotNull(), compiled(inner, child, below(name), root, within)).otherwise(_none()))
    if "additionalProperties" in schema:
        others = F.array_except(F.when(is_object, F.json_object_keys(F.to_json(value))), F.array(*map(F.lit, properties)).cast("array<string>"))
        if schema["additionalProperties"] is False:
            each = F.transform(others, lambda n: F.struct(F.when(field == "", n).otherwise(F.concat_ws(".", field, n)).alias("field"), F.lit("is not declared").alias("problem")))
            parts.append(F.coalesce(each.cast(PROBLEMS), _none()))
        elif schema["additionalProperties"] is not True:
            raise ValueError("additionalProperties is true or false")
    if "items" in schema:
        each = F.transform(list_, lambda x, i: compiled(schema["items"], x, F.concat(field, F.lit("["), i.cast("string"), F.lit("]")), root, within))
        parts.append(F.coalesce(F.flatten(each), _none()))
    wrong_type = _one(~right, field, "is not of type " + " or ".join(kinds))
    return F.when(right, F.concat(_none(), *parts)).otherwise(wrong_type) if kinds else F.concat(_none(), *parts)


def problems(lines: DataFrame, text: str, schema: dict, keep: list[str], id: str = "id") -> DataFrame:
    """(keep, record, field, problem): a row a problem. `record` is the record's own `id` as text, null where it has none; a
    line that is no JSON, or null, has the one problem of not being valid. Conforming lines have no rows."""
    parsed = lines.select(*keep, F.try_parse_json(text).alias("_v"))
    name = F.when(_is(F.col("_v"), "object"), F.try_variant_get("_v", f"$['{id}']", "string"))
    invalid = F.array(F.struct(F.lit("").alias("field"), F.lit("is not valid JSON").alias("problem"))).cast(PROBLEMS)
    found = F.when(F.col("_v").isNull(), invalid).otherwise(compiled(schema, F.col("_v")))
    return parsed.select(*keep, name.alias("record"), F.explode(found).alias("_p")).select(*keep, "record", "_p.field", "_p.problem")
