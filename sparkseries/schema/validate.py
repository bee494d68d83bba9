"""Validation of records (VARIANT columns) as plain columns, JSON Schema included."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Schema


def variant_of(value: Column) -> Column:
    """A struct, map or array column as VARIANT; JSON text goes through ``F.parse_json``.

    Null fields of a struct stay out, so that they count as absent.
    """
    return F.parse_json(F.to_json(value))


def _path(name: str) -> str:
    return f"$['{name}']" if re.search(r"\W", name) else f"$.{name}"


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, _path(name), "variant")


def kind(v: Column) -> Column:
    """string, int, float, bool, array, map, nil, binary; null where the key is missing."""
    t = F.schema_of_variant(v)
    number = F.when(t.startswith("DECIMAL"), F.when(F.floor(v.cast("double")) == v.cast("double"), F.when(t.endswith(",0)"), "int").otherwise("float")).otherwise("float"))
    return (
        F.when(t == "STRING", "string").when(t == "BIGINT", "int").when(t.isin("DOUBLE", "FLOAT"), "float").when(t == "BOOLEAN", "bool").when(t == "VOID", "nil").when(t == "BINARY", "binary")
        .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "map").when(t.startswith("DECIMAL"), number)
    )


def _accepts(type_: str, k: Column) -> Column:
    allowed = {"any": None, "number": ["int", "float"], "uint": ["int"]}.get(type_, [type_])
    if type_ not in ("string", "int", "uint", "float", "number", "bool", "binary", "array", "map", "nil", "any"):
        return F.lit(False)
    return F.lit(True) if allowed is None else k.isin(allowed)


def _number(v: Column, k: Column) -> Column:
    return F.when(k.isin("int", "float"), F.try_variant_get(v, "$", "double"))


def _shown(v: Column, k: Column) -> Column:
    """Scalars as text."""
    return F.when(~k.isin("array", "map", "nil"), F.try_variant_get(v, "$", "string"))


def _constraints_hold(v: Column, k: Column, number: Column, shown: Column, c: dict, lengths: bool) -> Column:
    """min, max (numbers), pattern (whole string), enum; with ``lengths`` also the length and item bounds."""
    ok = F.lit(True)
    text = F.when(k == "string", shown)
    if "min" in c:
        ok = ok & F.coalesce(number >= float(c["min"]), F.lit(True))
    if "max" in c:
        ok = ok & F.coalesce(number <= float(c["max"]), F.lit(True))
    if "pattern" in c:
        ok = ok & F.coalesce(text.rlike(f"^(?:{c['pattern']})$"), F.lit(True))
    if "enum" in c:
        ok = ok & F.coalesce(shown.isin([str(x) for x in c["enum"]]), F.lit(False))
    if lengths:
        n = F.when(k == "string", F.char_length(text)).when(k == "array", F.size(F.try_variant_get(v, "$", "array<variant>")))
        for low, high in (("minLength", "maxLength"), ("minItems", "maxItems")):
            if low in c:
                ok = ok & F.coalesce(n >= c[low], F.lit(True))
            if high in c:
                ok = ok & F.coalesce(n <= c[high], F.lit(True))
    return ok


def _messages(v: Column, schema: Schema, parts: list[tuple], check_optional: bool, lengths: bool) -> Column:
    """``parts``: per field its value, kind, number and text."""
    tests = []
    for f, (x, k, number, shown) in zip(schema.fields, parts):
        there = k.isNotNull()
        if f.required:
            tests.append(F.when(~there, F.lit(f"Missing required field: {f.name}")))
        if f.required or check_optional:
            fits = _accepts(f.type, k)
            tests.append(F.when(there & ~fits, F.lit(f"Invalid type for field '{f.name}': expected {f.type}")))
            if f.constraints:
                tests.append(F.when(there & fits & ~_constraints_hold(x, k, number, shown, f.constraints, lengths), F.lit(f"Constraint violation for field: {f.name}")))
    out = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    if schema.strategy == "STRICT":
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(f.name) for f in schema.fields]).cast("array<string>")))
        out = F.concat(out, F.coalesce(F.transform(unknown, lambda n: F.concat(F.lit("Unknown field: "), n)), F.array().cast("array<string>")))
    return F.when(kind(v) == "map", out).otherwise(F.array(F.lit("not a map")))


def errors(v: Column, schema: Schema, check_optional: bool = False, lengths: bool = False) -> Column:
    """Messages of what is wrong with a record, an empty array if nothing.

    Optional fields are checked only if ``check_optional``; unknown fields are an
    error under the STRICT strategy.
    """
    parts = []
    for f in schema.fields:
        x = _at(v, f.name)
        k = kind(x)
        parts.append((x, k, _number(x, k), _shown(x, k)))
    return _messages(v, schema, parts, check_optional, lengths)


def validate(df: DataFrame, column: str, schema: Schema, check_optional: bool = False, lengths: bool = False) -> DataFrame:
    """``df`` with ``errors`` and ``valid``.

    The fields' values, kinds and texts are columns of their own on the way, so each
    is taken out of the record once, however many tests look at it.
    """
    own, n = df.columns, len(schema.fields)
    staged = df.withColumns({f"_x{i}": _at(F.col(column), f.name) for i, f in enumerate(schema.fields)})
    staged = staged.withColumns({f"_k{i}": kind(F.col(f"_x{i}")) for i in range(n)})
    needed = [i for i, f in enumerate(schema.fields) if f.constraints]
    staged = staged.withColumns({f"_n{i}": _number(F.col(f"_x{i}"), F.col(f"_k{i}")) for i in needed} | {f"_s{i}": _shown(F.col(f"_x{i}"), F.col(f"_k{i}")) for i in needed})
    parts = [tuple(F.col(f"_{p}{i}") if i in needed or p in "xk" else None for p in "xkns") for i in range(n)]
    found = staged.withColumn("errors", _messages(F.col(column), schema, parts, check_optional, lengths))
    return found.select(*[F.col(f"`{c}`") for c in own if c not in ("errors", "valid")], "errors", (F.size("errors") == 0).alias("valid"))


def validation_stats(df: DataFrame) -> DataFrame:
    """One row: total, valid, invalid, errors."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.sum(F.size("errors")).cast("long").alias("errors"))


# -- JSON Schema ----------------------------------------------------------------------

#: Patterns of the string formats.
FORMATS = {
    "date-time": r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)",
    "date": r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])",
    "time": r"\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)?",
    "duration": r"P(?!$)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?",
    "email": r"[^@\s]+@[^@\s.]+(\.[^@\s.]+)+",
    "hostname": r"(?=.{1,253}$)[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*",
    "ipv4": r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)",
    "ipv6": r"([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)(?!.*::.*::)([0-9A-Fa-f]{0,4}:){1,7}[0-9A-Fa-f]{0,4}",
    "uri": r"[A-Za-z][A-Za-z0-9+.-]*:[^\s]*",
    "uri-reference": r"[^\s]*",
    "uuid": r"[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
    "json-pointer": r"(/([^~/]|~0|~1)*)*",
    "relative-json-pointer": r"(0|[1-9]\d*)(#|(/([^~/]|~0|~1)*)*)",
}


def matches_format(text: Column, format: str) -> Column:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}")
    return text.rlike(f"^(?:{FORMATS[format]})$")


#: JSON Schema type names and the kinds they accept.
_JSON_KINDS = {"null": ["nil"], "boolean": ["bool"], "object": ["map"], "array": ["array"], "number": ["int", "float"], "string": ["string"], "integer": ["int"]}


def json_schema_holds(v: Column, schema: dict | bool, root: dict | None = None, depth: int = 0) -> Column:
    """A JSON Schema compiled to a predicate over a VARIANT column.

    type, const, enum, length, pattern, format, range, multipleOf, items,
    uniqueItems, properties, required, patternProperties, additionalProperties,
    min/maxProperties, allOf/anyOf/oneOf/not, if/then/else and $ref (local, unrolled
    to eight levels).
    """
    if isinstance(schema, bool):
        return F.lit(schema)
    root = schema if root is None else root
    if "$ref" in schema:
        if depth >= 8:
            return F.lit(True)
        target = root
        for part in schema["$ref"].removeprefix("#").strip("/").split("/"):
            target = target[part.replace("~1", "/").replace("~0", "~")] if part else target
        return json_schema_holds(v, target, root, depth + 1)
    sub = lambda x, s: json_schema_holds(x, s, root, depth)
    k = kind(v)
    number = F.when(k.isin("int", "float"), F.try_variant_get(v, "$", "double"))
    text = F.when(k == "string", F.try_variant_get(v, "$", "string"))
    items = F.when(k == "array", F.try_variant_get(v, "$", "array<variant>"))
    entries = F.when(k == "map", F.try_variant_get(v, "$", "map<string,variant>"))
    fine = lambda c: F.coalesce(c, F.lit(True))  # noqa: E731  a keyword is silent about other kinds
    tests = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        tests.append(k.isin([x for n in names for x in _JSON_KINDS[n]]))
    canon = F.to_json(v)
    if "const" in schema:
        tests.append(canon == json.dumps(schema["const"], separators=(",", ":"), ensure_ascii=False))
    if "enum" in schema:
        tests.append(canon.isin([json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]))
    if "minLength" in schema:
        tests.append(fine(F.char_length(text) >= schema["minLength"]))
    if "maxLength" in schema:
        tests.append(fine(F.char_length(text) <= schema["maxLength"]))
    if "pattern" in schema:
        tests.append(fine(text.rlike(schema["pattern"])))
    if schema.get("format") in FORMATS:
        tests.append(fine(matches_format(text, schema["format"])))
    for key, op in (("minimum", lambda a, b: a >= b), ("maximum", lambda a, b: a <= b), ("exclusiveMinimum", lambda a, b: a > b), ("exclusiveMaximum", lambda a, b: a < b)):
        if key in schema and not isinstance(schema[key], bool):
            tests.append(fine(op(number, float(schema[key]))))
    if "multipleOf" in schema:
        r = number / float(schema["multipleOf"])
        tests.append(fine(F.abs(r - F.round(r)) < 1e-9))
    if "minItems" in schema:
        tests.append(fine(F.when(k == "array", F.size(items) >= schema["minItems"])))
    if "maxItems" in schema:
        tests.append(fine(F.when(k == "array", F.size(items) <= schema["maxItems"])))
    if "items" in schema:
        tests.append(fine(F.forall(items, lambda x: sub(x, schema["items"]))))
    if schema.get("uniqueItems"):
        shown = F.transform(items, lambda x: F.to_json(x))
        tests.append(fine(F.when(k == "array", F.size(F.array_distinct(shown)) == F.size(items))))
    for name in schema.get("required", ()):
        tests.append(fine(F.when(k == "map", kind(_at(v, name)).isNotNull())))
    for name, s in schema.get("properties", {}).items():
        x = _at(v, name)
        tests.append(F.when((k == "map") & kind(x).isNotNull(), sub(x, s)).otherwise(True))
    for pattern, s in schema.get("patternProperties", {}).items():
        holds = lambda e: ~e["key"].rlike(pattern) | sub(e["value"], s)  # noqa: B023, E731  used at once
        tests.append(fine(F.forall(F.map_entries(entries), holds)))
    if "additionalProperties" in schema:
        known = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        named = lambda n: F.array_contains(known, n) | F.lit(False)

        def rest(e):
            hit = named(e["key"])
            for p in schema.get("patternProperties", {}):
                hit = hit | e["key"].rlike(p)
            return hit | sub(e["value"], schema["additionalProperties"])

        tests.append(fine(F.forall(F.map_entries(entries), rest)))
    if "minProperties" in schema:
        tests.append(fine(F.when(k == "map", F.size(entries) >= schema["minProperties"])))
    if "maxProperties" in schema:
        tests.append(fine(F.when(k == "map", F.size(entries) <= schema["maxProperties"])))
    for s in schema.get("allOf", ()):
        tests.append(sub(v, s))
    count = lambda ss: sum((sub(v, s).cast("int") for s in ss), F.lit(0))
    if "anyOf" in schema:
        tests.append(count(schema["anyOf"]) >= 1)
    if "oneOf" in schema:
        tests.append(count(schema["oneOf"]) == 1)
    if "not" in schema:
        tests.append(~sub(v, schema["not"]))
    if "if" in schema:
        tests.append(F.when(sub(v, schema["if"]), sub(v, schema.get("then", True))).otherwise(sub(v, schema.get("else", True))))
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out
