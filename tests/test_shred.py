import json
import random

import pytest

from fieldloom.functions.jsontokens import nodes
from fieldloom.operators.shred import property_entities, property_members, schema_properties, shred
from fieldloom.plans.scratch import Scratch
from fieldloom.queries import problems


def brute(body):
    try:
        root = json.loads(body, parse_constant=lambda x: 1 / 0)
    except (ValueError, TypeError, ZeroDivisionError):
        return set()
    out = set()
    stack = [(root, "", "")]
    while stack:
        schema, prefix, parent = stack.pop()
        if not isinstance(schema, dict):
            continue
        if isinstance(schema.get("properties"), dict):
            for k, v in schema["properties"].items():
                path = f"{prefix}.{k}" if prefix else k
                out.add((path, parent))
                stack.append((v, path, path))
        if isinstance(schema.get("items"), dict):
            stack.append((schema["items"], prefix + "[]", parent))
        for c in ("allOf", "anyOf", "oneOf"):
            for x in schema.get(c) if isinstance(schema.get(c), list) else ():
                stack.append((x, prefix, parent))
    return out


def random_schema(r, depth):
    if depth == 0 or r.random() < 0.15:
        return r.choice([True, None, 3, "x", {}, [], {"type": "string", "maxLength": 5}])
    out = {}
    for k in r.sample(["properties", "items", "allOf", "oneOf", "type", "$defs", "default", "description"], r.randint(0, 4)):
        if k in ("properties", "$defs"):
            out[k] = {n: random_schema(r, depth - 1) for n in r.sample(["a", "b", "properties", "items", "allOf", "é.x"], r.randint(0, 3))}
        elif k in ("allOf", "oneOf"):
            out[k] = [random_schema(r, depth - 1) for _ in range(r.randint(0, 2))]
        elif k in ("items", "default"):
            out[k] = random_schema(r, depth - 1)
        else:
            out[k] = "t"
    return out


def deep(n):
    body = '{"type": "x"}'
    for i in range(n):
        body = f'{{"properties": {{"p{i % 3}": {body}}}}}' if i % 2 else f'{{"items": {body}}}'
    return body


def test_properties_equal_a_walk(spark):
    r = random.Random(11)
    bodies = [json.dumps(random_schema(r, 7)) for _ in range(60)]
    bodies += [None, "", "{", "null", "[]", "42", '{"properties": {"a": 1,}}', '{"properties": {"a": {"properties": {"old": 1}}, "a": {"properties": {"new": {}}}}}', deep(41), deep(300)]
    bodies += ['{"items": {"items": {"properties": {"x": {"items": {"items": {"properties": {"y": 1}}}}}}}}', '{"properties": {"properties": {"items": {"properties": {"properties": {}}}}}}']
    df = spark.createDataFrame([(f"s{i}", b, 1) for i, b in enumerate(bodies)], "schema_id string, body string, node int")
    scratch = Scratch(spark)
    table = scratch.cut(shred(df, "schema_id", "body"))
    got = {tuple(x) for x in schema_properties(table, scratch).select("schema_id", "path", "parent_path").collect()}
    assert got == {(f"s{i}", *x) for i, b in enumerate(bodies) for x in brute(b)}


def test_entities(spark):
    body = '{"properties": {"a": {"type": "string", "maxLength": 3, "items": {"properties": {"b": {"type": null, "description": "d\\u00e9"}}}}}}'
    df = spark.createDataFrame([("s", body), ("s", body), (None, body), ("t", None)], "schema_id string, body string")
    scratch = Scratch(spark)
    table = scratch.cut(shred(df, "schema_id", "body"))
    got = property_entities(table, schema_properties(table, scratch), ["type", "maxLength", "description"]).collect()
    one = {("a", "", "string", "3", None), ("a[].b", "a", None, None, "dé")}
    assert len(got) == 6 and {tuple(x)[1:] for x in got} == one


def test_entities_keep_business_keys_and_lists(spark, tmp_path):
    body = '{"properties": {"a": {"type": ["string", "null"], "x-atlas-business-key": "K", "x-atlas-ignore": true, "minItems": 2, "enum": ["x", {"y": 1}], "other": 5}}}'
    spark.createDataFrame([("s", body)], "schema_id string, body string").write.parquet(f"{tmp_path}/schema_doc.parquet")
    spark.createDataFrame([("s", "a")], "schema_id string, path string").write.parquet(f"{tmp_path}/field.parquet")
    (row,) = problems.p5_entities(spark, str(tmp_path)).collect()
    assert (row["x-atlas-business-key"], row["x-atlas-ignore"], row["minItems"], row["type"], row["registered"]) == ("K", "true", "2", None, True)
    got = [(r["path"], r["member"], r["scalar"]) for r in problems.p5_members(spark, str(tmp_path)).orderBy("member", "ordinal").collect()]
    assert got == [("a", "enum", "x"), ("a", "enum", None), ("a", "minItems", "2"), ("a", "other", "5"), ("a", "type", "string"), ("a", "type", "null"), ("a", "x-atlas-business-key", "K"), ("a", "x-atlas-ignore", "true")]


@pytest.mark.parametrize(
    ("text", "valid"),
    [("{}", 1), (" [1, 2.5e-3, -0] ", 1), ('"a\\u00e9\\n"', 1), ("true", 1), ("[1 2]", 0), ("[01]", 0), ("[1.]", 0), ("[.5]", 0), ('{"a" 1}', 0), ("{1: 2}", 0), ("[1,]", 0), ('["a\tb"]', 0), ('"\\x"', 0), ("nul", 0), ("NaN", 0), ("", 0), (" ", 0), ("[]]", 0), ("[", 0), ("﻿{}", 0), ("'a'", 0), ("1 2", 0), ("[}", 0), ("\x0b1", 0), ('{"a":1,}', 0), ('{,}', 0), ("truefalse", 0), ("1a", 0), ("[-]", 0), ("[" * 5000 + "]" * 5000, 1)],
)
def test_json_is_strict(text, valid):
    assert (nodes(text) is not None) == bool(valid)
