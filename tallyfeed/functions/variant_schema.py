"""A subset of JSON Schema, compiled to one expression over a Variant: no row leaves the JVM.

Keywords: type (object, string, integer), enum (of strings), pattern, minimum,
minProperties, required, properties, additionalProperties (false or a schema). The
first keyword of a value that fails says why, and what is inside it is not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORDS = {"type", "enum", "pattern", "minimum", "minProperties", "required", "properties", "additionalProperties"}
TYPES = ("object", "string", "integer")


def problems(schema: dict, value: Column, name: str | Column = "row") -> Column:
    """Why a variant does not fit the schema: an array of texts, empty if it fits."""
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"keywords outside the subset: {', '.join(sorted(unknown))}")
    if schema.get("type", "object") not in TYPES:
        raise ValueError(f"a type outside the subset: {schema['type']}")
    label = F.lit(name) if isinstance(name, str) else name
    say = lambda *parts: F.concat(F.lit("schema: "), label, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.schema_of_variant(value)
    members = F.when(kind.startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,variant>"))
    first = []
    if "type" in schema:
        first.append((~_is(schema["type"], kind, value), say(f" must be {schema['type']}")))
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    if "enum" in schema:
        first.append((~((kind == "STRING") & text.isin(*schema["enum"])), say(f" is none of {', '.join(schema['enum'])}")))
    if "pattern" in schema:
        # the end of a text, not the place before its last line feed
        ends = schema["pattern"].endswith("$") and not schema["pattern"].endswith("\\$")
        first.append(((kind == "STRING") & ~text.rlike(schema["pattern"][:-1] + r"\z" if ends else schema["pattern"]), say(f" must match {schema['pattern']}")))
    if "minimum" in schema:
        first.append((number < schema["minimum"], say(f" must be >= {schema['minimum']}")))
    if "minProperties" in schema:
        first.append((F.size(members) < schema["minProperties"], say(f" must have at least {schema['minProperties']} key")))
    inner = _members(schema, members, name, label)
    none = F.array().cast("array<string>")
    found = F.coalesce(inner, none) if inner is not None else none
    for condition, why in reversed(first):
        found = F.when(F.coalesce(condition, F.lit(True)), F.array(why)).otherwise(found)
    return found


def _is(kind: str, told: Column, value: Column) -> Column:
    if kind == "object":
        return told.startswith("OBJECT")
    if kind == "string":
        return told == "STRING"
    number = F.try_variant_get(value, "$", "double")
    return told.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number))


def _members(schema: dict, members: Column, name: str | Column, label: Column) -> Column | None:
    """The problems of an object's members; null if it is no object."""
    root = isinstance(name, str) and name == "row"
    under = lambda key: key if root else F.concat(label, F.lit("."), F.lit(key) if isinstance(key, str) else key)
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    known, parts = schema.get("properties", {}), []
    if schema.get("required"):
        parts.append(F.array_compact(F.array(*[F.when(~F.map_contains_key(members, key), F.concat(F.lit("schema: missing required field "), as_column(under(key)))) for key in schema["required"]])))
    for key, sub in known.items():
        parts.append(F.when(F.map_contains_key(members, key), problems(sub, F.try_element_at(members, F.lit(key)), under(key))).otherwise(F.array().cast("array<string>")))
    others = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*known)) if known else F.map_entries(members)
    more = schema.get("additionalProperties")
    if more is False:
        parts.append(F.transform(others, lambda e: F.concat(F.lit("schema: unknown field "), as_column(under(e["key"])))))
    elif isinstance(more, dict):
        parts.append(F.flatten(F.transform(others, lambda e: problems(more, e["value"], under(e["key"])))))
    return reduce(F.concat, parts) if parts else None
