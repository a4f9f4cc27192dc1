"""Arguments of tool calls against a schema: a JSON text is checked and stripped of what the schema doesn't name."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$[{json.dumps(name, ensure_ascii=False)}]", "variant")


def _object(value: Column, properties: dict) -> Column:
    """The named members as a JSON object, in the schema's order."""
    members = [F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), _kept(_member(value, name), rule)) for name, rule in properties.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members, F.lit(None).cast("string"))), ","), F.lit("}"))


def _kept(value: Column, rule: dict) -> Column:
    """A value as JSON text without members that the rule doesn't name; null if there is none, or if it, or an item of it, should be a list and isn't."""
    plain, items, members = F.to_json(value), rule.get("items"), rule.get("properties")
    if rule.get("type") == "array":
        if isinstance(items, dict):
            each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda item: _kept(item, items))
            plain = F.when(~F.exists(each, lambda item: item.isNull()), F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))
        return F.when(_is(value, "ARRAY"), plain)
    if rule.get("type") == "object" and members is not None:
        return F.when(_is(value, "OBJECT"), _object(value, members)).otherwise(plain)
    return plain


def checked_arguments(arguments: Column, schema: dict | None) -> Column:
    """A struct of a tool call's arguments (JSON text): error, names, arguments.

    * INVALID_TOOL_ARGUMENTS: null, no JSON, a name that repeats, or not an object;
    * UNKNOWN_TOOL_ARGUMENT: a name that the schema hasn't (the first one is named);
    * MISSING_TOOL_ARGUMENT: required names that are absent, or were dropped since they should be lists and aren't (all are named, in order);
    * else null, and the arguments as JSON text in the schema's order, without nested members that it doesn't name. A tool without a schema keeps every object.
    """
    value = F.try_parse_json(arguments)
    names = F.coalesce(F.map_keys(F.from_json(arguments, "map<string,string>")), F.array().cast("array<string>"))
    properties, required = (schema or {}).get("properties", {}), (schema or {}).get("required", [])
    nothing = F.array().cast("array<string>")
    unknown = F.slice(F.array_except(names, F.array(*map(F.lit, properties)).cast("array<string>")), 1, 1) if schema is not None else nothing
    absent = [F.when(_kept(_member(value, name), properties.get(name, {})).isNull(), name) for name in sorted(required)]
    missing = F.array_compact(F.array(*absent, F.lit(None).cast("string")))
    error = F.when(~_is(value, "OBJECT"), "INVALID_TOOL_ARGUMENTS").when(F.size(unknown) > 0, "UNKNOWN_TOOL_ARGUMENT").when(F.size(missing) > 0, "MISSING_TOOL_ARGUMENT")
    named = F.when(error == "UNKNOWN_TOOL_ARGUMENT", unknown).when(error == "MISSING_TOOL_ARGUMENT", missing).otherwise(nothing)
    kept = F.to_json(value) if schema is None else _object(value, properties)
    return F.struct(error.alias("error"), named.alias("names"), F.when(error.isNull(), kept).alias("arguments"))
