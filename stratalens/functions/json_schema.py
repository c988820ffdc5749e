"""JSON schemas compiled to a Column: the violations of a JSON text, each with its path and keyword.

The text is parsed once to a variant; objects are maps of variants and arrays arrays of them, so that types are told apart as JSON has them. A schema becomes one
expression: properties and items nest, references into the schema's own definitions are put in place, conditions and alternatives count the violations of
their parts. A keyword that isn't known is an error when the schema is compiled, never a silent pass.

Defined results: null text and text that is no JSON have one violation, ``parse`` at ``$``; keywords of another type than a value's say nothing of it, as the
standard has it; repeated names in an object are no JSON here; a date or date-time is checked by its form and its calendar.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that say nothing of a value, and those that are compiled.
NOTES = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment"}
KNOWN = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "format", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref"}
VIOLATIONS = "array<struct<path:string,keyword:string>>"
#: The variant's own names of types, by JSON's.
TYPES = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"}
FORMATS = {"date": r"^\d{4}-\d{2}-\d{2}$", "date-time": r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$"}


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, as an aggregation over nothing: ``text.let`` takes the one element of a transformed array, and would work out
    that array's type for each row, which goes through all of f and, nested, through each f inside again."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, f)


def no_violations() -> Column:
    return F.array().cast(VIOLATIONS)


class Compiler:
    def __init__(self, schema: Mapping):
        self.root = schema

    def resolved(self, ref: str, open_: tuple[str, ...]) -> Mapping:
        if not ref.startswith("#/") or ref in open_:
            raise ValueError(f"reference {ref} isn't inside the schema, or leads to itself")
        out = self.root
        for part in ref[2:].split("/"):
            out = out[part.replace("~1", "/").replace("~0", "~")]
        return out

    def compile(self, schema: Mapping | bool, value: Column, path: Column, open_: tuple[str, ...] = ()) -> Column:
        if isinstance(schema, bool):
            return self.told("false", path) if schema is False else no_violations()
        # bound, as nothing is shared inside a lambda; the type of an object or array comes from its parts, since its schema would be that of all below it
        parts = F.struct(value.alias("value"), F.try_variant_get(value, "$", "map<string,variant>").alias("fields"), F.try_variant_get(value, "$", "array<variant>").alias("items"))
        kind = lambda p: F.when(p["fields"].isNotNull(), "OBJECT").when(p["items"].isNotNull(), "ARRAY").otherwise(F.coalesce(F.schema_of_variant(p["value"]), F.lit("VOID")))
        return bound(parts, lambda p: bound(kind(p), lambda k: self.rules(schema, p, k, path, open_)))

    @staticmethod
    def told(keyword: str, at: Column) -> Column:
        return F.array(F.struct(at.alias("path"), F.lit(keyword).alias("keyword"))).cast(VIOLATIONS)

    def rules(self, schema: Mapping | bool, parts: Column, kind: Column, path: Column, open_: tuple[str, ...]) -> Column:
        """The violations of a value that is taken apart already."""
        none = no_violations()
        one = lambda keyword, at=path: self.told(keyword, at)
        if isinstance(schema, bool):
            return none if schema else one("false")
        unknown = set(schema) - KNOWN - NOTES
        if unknown:
            raise ValueError(f"keywords that aren't compiled: {sorted(unknown)}")
        is_ = lambda name: kind.rlike(TYPES[name]) if name == "number" else kind == TYPES[name]
        text, number = F.try_variant_get(parts["value"], "$", "string"), F.try_variant_get(parts["value"], "$", "double")
        found: list[Column] = []
        fail = lambda wrong, keyword: found.append(F.when(wrong, one(keyword)).otherwise(none))
        inner = lambda s: self.rules(s, parts, kind, path, open_)
        clean = lambda s: F.size(inner(s)) == 0
        if "$ref" in schema:
            found.append(self.rules(self.resolved(schema["$ref"], open_), parts, kind, path, (*open_, schema["$ref"])))
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            whole = is_("number") & (number == F.floor(number))
            fail(~reduce(Column.__or__, (whole if n == "integer" else is_(n) for n in names)), "type")
        if "const" in schema:
            fail(~self.equals(schema["const"], is_, text, number), "const")
        if "enum" in schema:
            fail(~reduce(Column.__or__, (self.equals(v, is_, text, number) for v in schema["enum"])), "enum")
        if "minLength" in schema:
            fail(is_("string") & (F.char_length(text) < schema["minLength"]), "minLength")
        if "maxLength" in schema:
            fail(is_("string") & (F.char_length(text) > schema["maxLength"]), "maxLength")
        if "pattern" in schema:
            fail(is_("string") & ~text.rlike(schema["pattern"]), "pattern")
        if schema.get("format") in FORMATS:
            fits = text.rlike(FORMATS[schema["format"]])
            if schema["format"] != "uri":
                fits = fits & F.substring(text, 1, 10).try_cast("date").isNotNull()
            fail(is_("string") & ~fits, "format")
        if "minimum" in schema:
            fail(is_("number") & (number < schema["minimum"]), "minimum")
        if "maximum" in schema:
            fail(is_("number") & (number > schema["maximum"]), "maximum")
        found += self.object_rules(schema, parts["fields"], path, one, open_)
        found += self.array_rules(schema, parts["items"], path, one, open_)
        found += [inner(s) for s in schema.get("allOf", [])]
        if "anyOf" in schema:
            fail(~reduce(Column.__or__, (clean(s) for s in schema["anyOf"])), "anyOf")
        if "oneOf" in schema:
            fail(reduce(Column.__add__, (clean(s).cast("int") for s in schema["oneOf"])) != 1, "oneOf")
        if "not" in schema:
            fail(clean(schema["not"]), "not")
        if "if" in schema:
            found.append(F.when(clean(schema["if"]), inner(schema.get("then", True))).otherwise(inner(schema.get("else", True))))
        return F.concat(none, *found) if found else none

    @staticmethod
    def equals(want, is_, text: Column, number: Column) -> Column:
        if want is None:
            return is_("null")
        if isinstance(want, bool):
            return is_("boolean") & (text == str(want).lower())
        if isinstance(want, (int, float)):
            return is_("number") & (number == float(want))
        if isinstance(want, str):
            return is_("string") & (text == want)
        raise ValueError("constants are texts, numbers, booleans or null")

    def object_rules(self, schema: Mapping, fields: Column, path: Column, one, open_: tuple[str, ...]) -> list[Column]:
        if not {"required", "properties", "additionalProperties"} & set(schema):
            return []
        none = no_violations()
        out = [none]
        for name in schema.get("required", []):
            out.append(F.when(~F.map_contains_key(fields, F.lit(name)), one("required", F.concat(path, F.lit(f".{name}")))).otherwise(none))
        for name, s in schema.get("properties", {}).items():
            own = self.compile(s, F.try_element_at(fields, F.lit(name)), F.concat(path, F.lit(f".{name}")), open_)
            out.append(F.when(F.map_contains_key(fields, F.lit(name)), own).otherwise(none))
        rest = schema.get("additionalProperties", True)
        if rest is not True:
            names = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
            more = F.array_sort(F.array_except(F.map_keys(fields), names))
            if rest is False:
                out.append(F.transform(more, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("additionalProperties").alias("keyword"))))
            else:
                out.append(F.flatten(F.transform(more, lambda k: self.compile(rest, F.try_element_at(fields, k), F.concat(path, F.lit("."), k), open_))))
        return [F.when(fields.isNotNull(), F.concat(*out)).otherwise(none)]

    def array_rules(self, schema: Mapping, items: Column, path: Column, one, open_: tuple[str, ...]) -> list[Column]:
        if not {"items", "minItems", "maxItems"} & set(schema):
            return []
        none = no_violations()
        out = [none]
        if "minItems" in schema:
            out.append(F.when(F.size(items) < schema["minItems"], one("minItems")).otherwise(none))
        if "maxItems" in schema:
            out.append(F.when(F.size(items) > schema["maxItems"], one("maxItems")).otherwise(none))
        if "items" in schema:
            out.append(F.flatten(F.transform(items, lambda x, i: self.compile(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), open_))))
        return [F.when(items.isNotNull(), F.concat(*out)).otherwise(none)]


def violations(text: Column, schema: Mapping) -> Column:
    """array of (path, keyword) in the order of path and keyword; empty where the text is valid."""
    own = Compiler(schema)
    return bound(F.try_parse_json(text), lambda v: F.when(v.isNull(), own.told("parse", F.lit("$"))).otherwise(F.array_sort(own.compile(schema, v, F.lit("$")))))
