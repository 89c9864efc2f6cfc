"""Conformance of JSON documents to a subset of JSON Schema."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "title", "description"}
TYPES: dict[str, Callable[[Any], bool]] = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def _is_time(v: str) -> bool:
    try:
        dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
    except ValueError:
        return False
    return "T" in v


def _is_uri(v: str) -> bool:
    try:
        return bool(urlsplit(v).scheme and urlsplit(v).netloc)
    except ValueError:
        return False


FORMATS = {"date-time": _is_time, "uri": _is_uri}
#: keyword -> (types of value it applies to, whether the value breaks it)
CHECKS: dict[str, tuple[str, Callable[[Any, Any], bool]]] = {
    "minLength": ("string", lambda v, n: len(v) < n),
    "maxLength": ("string", lambda v, n: len(v) > n),
    "pattern": ("string", lambda v, p: re.search(p, v) is None),
    "format": ("string", lambda v, f: f in FORMATS and not FORMATS[f](v)),
    "minimum": ("number", lambda v, n: v < n),
    "maximum": ("number", lambda v, n: v > n),
    "minItems": ("array", lambda v, n: len(v) < n),
    "maxItems": ("array", lambda v, n: len(v) > n),
}
KEYWORDS = ANNOTATIONS | set(CHECKS) | {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "$ref"}


def unsupported(schema: Any, where: str = "#") -> list[str]:
    """Keywords that the validator would not enforce."""
    if not isinstance(schema, dict):
        return []
    out = [f"{where}/{k}" for k in schema if k not in KEYWORDS]
    for holder in ("properties", "$defs"):
        for name, sub in schema.get(holder, {}).items():
            out += unsupported(sub, f"{where}/{holder}/{name}")
    return out + unsupported(schema.get("items"), f"{where}/items") + unsupported(schema.get("additionalProperties"), f"{where}/additionalProperties")


def resolve(schema: dict, root: dict) -> dict:
    """Follow local references; what stands beside one holds as well."""
    while "$ref" in schema:
        at: Any = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            at = at[part]
        schema = at | {k: v for k, v in schema.items() if k != "$ref"}
    return schema


def breaches(value: Any, schema: dict, root: dict | None = None, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, keyword) of everything wrong; a wrong type hides what else is wrong with that value."""
    root = schema if root is None else root
    schema = resolve(schema, root)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(TYPES[k](value) for k in kinds):
        yield path, "type"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield path, "enum"
    if "const" in schema and value != schema["const"]:
        yield path, "const"
    for word, (kind, broken) in CHECKS.items():
        if word in schema and TYPES[kind](value) and broken(value, schema[word]):
            yield path, word
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                yield f"{path}/{name}", "required"
        for name, sub in value.items():
            if name in known:
                yield from breaches(sub, known[name], root, f"{path}/{name}")
            elif schema.get("additionalProperties") is False:
                yield f"{path}/{name}", "additionalProperties"
            elif isinstance(schema.get("additionalProperties"), dict):
                yield from breaches(sub, schema["additionalProperties"], root, f"{path}/{name}")
    if isinstance(value, list) and "items" in schema:
        for i, sub in enumerate(value):
            yield from breaches(sub, schema["items"], root, f"{path}/{i}")


_CLOCK = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)?$"
#: keyword -> whether a variant's text, number or list (as a column) breaks it; in the order and of the types of CHECKS
BREAKS: dict[str, Callable[[Column, Any], Column]] = {
    "minLength": lambda x, n: F.char_length(x) < n,
    "maxLength": lambda x, n: F.char_length(x) > n,
    "pattern": lambda x, p: ~x.rlike(p),
    "format": lambda x, f: ~COLUMN_FORMATS[f](x) if f in COLUMN_FORMATS else F.lit(False),
    "minimum": lambda x, n: x < n,
    "maximum": lambda x, n: x > n,
    "minItems": lambda x, n: F.size(x) < n,
    "maxItems": lambda x, n: F.size(x) > n,
}
COLUMN_FORMATS = {"date-time": lambda x: x.rlike(_CLOCK) & F.try_to_timestamp(F.substring(x, 1, 10)).isNotNull(), "uri": lambda x: x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")}


def _none() -> Column:
    return F.array().cast("array<struct<path:string,keyword:string>>")


def _as(v: Column, ddl: str) -> Column:
    return F.try_variant_get(v, "$", ddl)


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is of a JSON type."""
    told = F.schema_of_variant(v)
    number = told.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    x = _as(v, "double")
    return {
        "string": told == "STRING",
        "boolean": told == "BOOLEAN",
        "number": number,
        "integer": number & (F.rint(x) == x) & (F.abs(x) < float("inf")),
        "array": told.startswith("ARRAY"),
        "object": told.startswith("OBJECT"),
        "null": told == "VOID",
    }[kind]


def _equals(v: Column, value: Any) -> Column:
    """Whether a variant is that JSON value; lists and objects by their text with sorted keys."""
    if value is None:
        return _is(v, "null")
    if isinstance(value, bool):
        return _is(v, "boolean") & (_as(v, "boolean") == value)
    if isinstance(value, (int, float)):
        return _is(v, "number") & (_as(v, "double") == float(value))
    if isinstance(value, str):
        return _is(v, "string") & (_as(v, "string") == value)
    return F.to_json(v) == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _marks(*rules: tuple[Column, Column, str]) -> Column:
    """One entry for each (broken, path, keyword) that is broken."""
    return F.array_compact(F.array(*[F.when(broken, F.struct(path.alias("path"), F.lit(word).alias("keyword"))) for broken, path, word in rules]))


def compiled(v: Column, schema: dict, root: dict, path: Column, within: tuple[str, ...] = ()) -> Column:
    """array<struct<path, keyword>> of what is wrong with a variant: the rules of ``breaches`` as column expressions."""
    if "$ref" in schema:
        if schema["$ref"] in within:
            raise ValueError(f"a schema that holds itself has no end: {schema['$ref']}")
        within = (*within, schema["$ref"])
        schema = resolve(schema, root)
    at = lambda name: F.concat(path, F.lit("/"), name if isinstance(name, Column) else F.lit(name))
    parts, own = [], []
    if "enum" in schema:
        own.append((~reduce(Column.__or__, (_equals(v, x) for x in schema["enum"]), F.lit(False)), path, "enum"))
    if "const" in schema:
        own.append((~_equals(v, schema["const"]), path, "const"))
    ddl = {"string": "string", "number": "double", "array": "array<variant>"}
    own += [(_is(v, kind) & BREAKS[word](_as(v, ddl[kind]), schema[word]), path, word) for word, (kind, _) in CHECKS.items() if word in schema]
    parts += [_marks(*own)] if own else []

    known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
    members = _as(v, "map<string,variant>")
    inside = []
    absent = [(~F.map_contains_key(members, name), at(name), "required") for name in schema.get("required", [])]
    inside += [_marks(*absent)] if absent else []
    for name, sub in known.items():
        child = F.try_element_at(members, F.lit(name))
        inside.append(F.when(child.isNotNull(), compiled(child, sub, root, at(name), within)).otherwise(_none()))
    others = F.filter(F.map_keys(members), lambda k: ~k.isin(list(known))) if known else F.map_keys(members)
    if rest is False:
        inside.append(F.transform(others, lambda k: F.struct(at(k).alias("path"), F.lit("additionalProperties").alias("keyword"))))
    elif isinstance(rest, dict) and rest:
        inside.append(F.flatten(F.transform(others, lambda k: compiled(F.try_element_at(members, k), rest, root, at(k), within))))
    parts += [F.when(_is(v, "object"), F.concat(*inside)).otherwise(_none())] if inside else []
    if "items" in schema:
        each = F.transform(_as(v, "array<variant>"), lambda x, i: compiled(x, schema["items"], root, at(i.cast("string")), within))
        parts.append(F.when(_is(v, "array"), F.flatten(each)).otherwise(_none()))

    found = F.concat(*parts) if parts else _none()
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if not kinds:
        return found
    fits = reduce(Column.__or__, (_is(v, k) for k in kinds))
    return F.when(fits, found).otherwise(F.array(F.struct(path.alias("path"), F.lit("type").alias("keyword"))))


def schema_breaches(raw: Column, schema: dict) -> Column:
    """array<struct<path, keyword>> for JSON text, by column expressions over VARIANT.

    Null, empty and broken text, and text that names a key twice in one object, are one breach, ``json``. Patterns are
    Java's. A schema that refers to itself has no such expression and is refused.
    """
    if bad := unsupported(schema):
        raise ValueError(f"unsupported keywords: {', '.join(bad)}")
    v = F.try_parse_json(raw)
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("keyword")))
    return F.when(v.isNull(), broken).otherwise(compiled(v, schema, schema, F.lit("")))


def conforming(docs: DataFrame, raw_col: str, schema: dict) -> tuple[DataFrame, DataFrame]:
    """(documents without a breach, (date, path, keyword) of the others)."""
    seen = docs.withColumn("__b", schema_breaches(F.col(raw_col), schema))
    return seen.where(F.size("__b") == 0).drop("__b"), seen.select("date", F.explode("__b").alias("b")).select("date", "b.*")
