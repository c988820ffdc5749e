"""Compiled schemas against a walker over parsed values."""

import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from stratalens.functions import json_schema

#: Findings documents as the driver writes them.
SCHEMA = {
    "$defs": {"code": {"type": "string", "pattern": "^[A-Z]{2}[0-9]+$"}, "instance": {"type": "object", "additionalProperties": False, "required": ["instance_id", "primary"], "properties": {
        "instance_id": {"type": "string", "minLength": 3, "maxLength": 6}, "primary": {"type": "boolean"}, "issue_codes": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/code"}}}}},
    "type": "object", "additionalProperties": False, "required": ["schema_version", "findings", "input"],
    "properties": {
        "schema_version": {"const": "1.0"}, "generated_at": {"type": "string", "format": "date-time"}, "count": {"type": "integer", "minimum": 0, "maximum": 9}, "ratio": {"type": ["number", "null"], "minimum": 0.5},
        "input": {"type": "object", "required": ["cik"], "properties": {"cik": {"type": "string"}, "filed_date": {"type": "string", "format": "date"}}, "additionalProperties": {"type": "string"}},
        "findings": {"type": "array", "maxItems": 3, "items": {
            "type": "object", "required": ["pattern_id", "status"], "properties": {"pattern_id": {"enum": ["P001", "P002", 7, None]}, "status": {"type": "string"}, "instances": {"type": "array", "items": {"$ref": "#/$defs/instance"}}},
            "if": {"properties": {"status": {"const": "detected"}}, "required": ["status"]}, "then": {"required": ["instances"]}, "else": {"required": ["reason"]},
        }},
        "either": {"oneOf": [{"type": "string"}, {"type": "integer"}, {"minimum": 5}]}, "any": {"anyOf": [{"type": "string", "minLength": 2}, {"type": "array"}]}, "all": {"allOf": [{"type": "number"}, {"minimum": 2}]}, "no": {"not": {"type": "null"}},
    },
}


def walk(schema, v, path, root):
    if isinstance(schema, bool):
        return [] if schema else [(path, "false")]
    out = []
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and float(v).is_integer()}
    same = lambda a: type(a) is type(v) and a == v or number and isinstance(a, (int, float)) and not isinstance(a, bool) and a == v
    sub = lambda s, x=v, p=path: walk(s, x, p, root)
    if "$ref" in schema:
        out += sub(root["$defs"][schema["$ref"].rsplit("/", 1)[1]])
    if "type" in schema and not any(kinds[t] for t in ([schema["type"]] if isinstance(schema["type"], str) else schema["type"])):
        out.append((path, "type"))
    if "const" in schema and not same(schema["const"]):
        out.append((path, "const"))
    if "enum" in schema and not any(same(x) for x in schema["enum"]):
        out.append((path, "enum"))
    if kinds["string"]:
        out += [(path, "minLength")] * (len(v) < schema.get("minLength", 0)) + [(path, "maxLength")] * (len(v) > schema.get("maxLength", 1e9))
        if "pattern" in schema and not re.search(schema["pattern"], v):
            out.append((path, "pattern"))
        if "format" in schema:
            shape = r"^\d{4}-\d\d-\d\d$" if schema["format"] == "date" else r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
            try:
                good = bool(re.search(shape, v)) and bool(date.fromisoformat(v[:10]))
            except ValueError:
                good = False
            out += [(path, "format")] * (not good)
    if number:
        out += [(path, "minimum")] * (v < schema.get("minimum", v)) + [(path, "maximum")] * (v > schema.get("maximum", v))
    if kinds["object"]:
        out += [(f"{path}.{n}", "required") for n in schema.get("required", []) if n not in v]
        known = schema.get("properties", {})
        for n, x in v.items():
            if n in known:
                out += sub(known[n], x, f"{path}.{n}")
            elif schema.get("additionalProperties", True) is False:
                out.append((f"{path}.{n}", "additionalProperties"))
            else:
                out += sub(schema.get("additionalProperties", True), x, f"{path}.{n}")
    if kinds["array"]:
        out += [(path, "minItems")] * (len(v) < schema.get("minItems", 0)) + [(path, "maxItems")] * (len(v) > schema.get("maxItems", 1e9))
        if "items" in schema:
            for i, x in enumerate(v):
                out += sub(schema["items"], x, f"{path}[{i}]")
    for s in schema.get("allOf", []):
        out += sub(s)
    if "anyOf" in schema and all(sub(s) for s in schema["anyOf"]):
        out.append((path, "anyOf"))
    if "oneOf" in schema and sum(not sub(s) for s in schema["oneOf"]) != 1:
        out.append((path, "oneOf"))
    if "not" in schema and not sub(schema["not"]):
        out.append((path, "not"))
    if "if" in schema:
        out += sub(schema.get("else" if sub(schema["if"]) else "then", True))
    return out


def documents(n=250):
    rnd = random.Random(8)
    odd = lambda good: rnd.choice([good] * 5 + [None, 1, 1.0, 2.5, "", "x", True, [], {}, [1], {"a": 1}])

    def finding():
        instances = [{"instance_id": odd(rnd.choice(["abcd", "abcdefgh"])), "primary": odd(True), "issue_codes": odd([odd("AB12") for _ in range(rnd.randint(0, 3))])} for _ in range(rnd.randint(0, 2))]
        return {"pattern_id": odd("P001"), "status": odd(rnd.choice(["detected", "suppressed"])), "instances": odd(instances), "reason": "r"}

    out = []
    for _ in range(n):
        d = {"schema_version": odd("1.0"), "generated_at": odd(rnd.choice(["2024-01-01T00:00:00Z", "2024-02-30T00:00:00Z", "2024-01-01"])), "count": odd(rnd.choice([0, 9, 10, -1, 3.0])), "ratio": odd(rnd.choice([0.5, 0.4, None])),
             "input": odd({"cik": odd("1"), "filed_date": odd(rnd.choice(["2024-01-31", "2024-13-01"])), "extra": odd("text")}), "findings": odd([odd(finding()) for _ in range(rnd.randint(0, 4))]),
             "either": odd(6), "any": odd("ab"), "all": odd(3), "no": odd(1), "new": 1}
        for name in list(d):
            if rnd.random() < (0.9 if name == "new" else 0.12):
                del d[name]
        out.append(d)
    return out


def test_violations_equal_a_walker(spark):
    good = {"schema_version": "1.0", "input": {"cik": "1"}, "findings": [{"pattern_id": None, "status": "detected", "instances": [{"instance_id": "abc", "primary": False, "issue_codes": ["AB1"]}]}, {"pattern_id": 7, "status": "x", "reason": 1}]}
    docs = documents() + [good]
    texts = [json.dumps(d) for d in docs] + ["", "{", None, "[1]", "null", '"x"']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", json_schema.violations(F.col("t"), SCHEMA).alias("v")).collect()
    got = {r["i"]: sorted((x["path"], x["keyword"]) for x in r["v"]) for r in rows}
    want = {i: sorted(walk(SCHEMA, d, "$", SCHEMA)) for i, d in enumerate(docs)}
    n = len(docs)
    want |= {n: [("$", "parse")], n + 1: [("$", "parse")], n + 2: [("$", "parse")], n + 3: [("$", "type")], n + 4: [("$", "type")], n + 5: [("$", "type")]}
    assert got == want
    assert {k for v in want.values() for _, k in v} >= json_schema.KNOWN - {"$ref", "items", "properties", "allOf", "if", "then", "else"} and any(not v for v in want.values())


def test_schemas_that_cannot_be_compiled():
    for schema in ({"type": "string", "dependencies": {}}, {"$ref": "other.json"}, {"const": [1]}):
        with pytest.raises(ValueError):
            json_schema.Compiler(schema).compile(schema, F.lit("x"), F.lit("$"))


def test_a_text_is_parsed_once(spark):
    rows = spark.range(3).select(F.concat(F.lit('{"schema_version": '), F.col("id").cast("string"), F.lit("}")).alias("t"))
    found = rows.select(json_schema.violations(F.col("t"), SCHEMA).alias("v"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert all(("$.schema_version", "const") in [tuple(v) for v in r["v"]] for r in found.collect())
