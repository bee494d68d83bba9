"""Schemas as other texts: JSON Schema, GraphQL, OpenAPI, program code, documents; and a GraphQL executor."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import Field, Schema

# Type names of other languages.
JSON_TYPES = {"string": "string", "int": "integer", "uint": "integer", "float": "number", "number": "number", "bool": "boolean", "binary": "string", "array": "array", "map": "object", "nil": "null"}
GRAPHQL_TYPES = {"string": "String", "int": "Int", "uint": "Int", "float": "Float", "number": "Float", "bool": "Boolean", "binary": "Binary", "array": "[JSON]", "map": "JSON", "nil": "JSON", "any": "JSON"}
PYTHON_TYPES = {"string": "str", "int": "int", "uint": "int", "float": "float", "number": "float", "bool": "bool", "binary": "bytes", "array": "list", "map": "dict", "nil": "None", "any": "object"}
TYPESCRIPT_TYPES = {"string": "string", "int": "number", "uint": "number", "float": "number", "number": "number", "bool": "boolean", "binary": "Uint8Array", "array": "unknown[]", "map": "Record<string, unknown>", "nil": "null", "any": "unknown"}
CPP_TYPES = {"string": "std::string", "int": "int64_t", "uint": "uint64_t", "float": "double", "number": "double", "bool": "bool", "binary": "std::vector<uint8_t>", "array": "std::vector<Value>", "map": "std::map<std::string, Value>", "nil": "std::monostate", "any": "Value"}


def to_json_schema(s: Schema) -> dict:
    props = {}
    for f in s.fields:
        p: dict = {"type": JSON_TYPES[f.type]} if f.type in JSON_TYPES else {}
        c = f.constraints
        p |= {new: c[old] for old, new in (("min", "minimum"), ("max", "maximum"), ("pattern", "pattern"), ("enum", "enum"), ("minLength", "minLength"), ("maxLength", "maxLength"), ("minItems", "minItems"), ("maxItems", "maxItems")) if old in c}
        if f.type == "uint":
            p.setdefault("minimum", 0)
        if f.type == "binary":
            p["contentEncoding"] = "base64"
        if f.default is not None:
            p["default"] = f.default
        if f.description:
            p["description"] = f.description
        props[f.name] = p
    out = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": s.name, "type": "object", "properties": props, "required": [f.name for f in s.fields if f.required]}
    if s.strategy == "STRICT":
        out["additionalProperties"] = False
    if s.description:
        out["description"] = s.description
    return out


def from_json_schema(d: dict, name: str | None = None) -> Schema:
    back = {"string": "string", "integer": "int", "number": "float", "boolean": "bool", "array": "array", "object": "map", "null": "nil"}
    fields = []
    for n, p in d.get("properties", {}).items():
        t = p.get("type", "any")
        c = {old: p[new] for old, new in (("min", "minimum"), ("max", "maximum"), ("pattern", "pattern"), ("enum", "enum"), ("minLength", "minLength"), ("maxLength", "maxLength"), ("minItems", "minItems"), ("maxItems", "maxItems")) if new in p}
        kind = "binary" if p.get("contentEncoding") == "base64" else back.get(t, "any") if isinstance(t, str) else "any"
        fields.append(Field(n, kind, n in d.get("required", ()), p.get("default"), p.get("description", ""), c))
    return Schema(name or d.get("title", "schema"), fields=tuple(fields), description=d.get("description", ""), strategy="STRICT" if d.get("additionalProperties") is False else "FLEXIBLE")


def json_schema_of(struct: T.DataType) -> dict:
    """JSON Schema of a Spark type."""
    if isinstance(struct, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema_of(f.dataType) for f in struct}, "required": [f.name for f in struct if not f.nullable]}
    if isinstance(struct, T.ArrayType):
        return {"type": "array", "items": json_schema_of(struct.elementType)}
    if isinstance(struct, T.MapType):
        return {"type": "object", "additionalProperties": json_schema_of(struct.valueType)}
    for kinds, out in [((T.StringType,), {"type": "string"}), ((T.IntegralType,), {"type": "integer"}), ((T.NumericType,), {"type": "number"}), ((T.BooleanType,), {"type": "boolean"}), ((T.DateType,), {"type": "string", "format": "date"}), ((T.TimestampType, T.TimestampNTZType), {"type": "string", "format": "date-time"}), ((T.BinaryType,), {"type": "string", "contentEncoding": "base64"})]:
        if isinstance(struct, kinds):
            return out
    return {}


def json_schema_compatible(old: dict, new: dict) -> bool:
    """Whether every document of ``old`` passes ``new`` as far as names, types and required fields say."""
    o, n = old.get("properties", {}), new.get("properties", {})
    if any(r not in old.get("required", ()) for r in new.get("required", ())):
        return False
    for k, p in n.items():
        if k in o and o[k].get("type") != p.get("type") and not (o[k].get("type") == "integer" and p.get("type") == "number"):
            return False
    return new.get("additionalProperties", True) is not False or set(o) <= set(n)


def merge_json_schemas(schemas: list[dict], how: str = "allOf") -> dict:
    return {how: list(schemas)}


def to_openapi(schemas: list[Schema], title: str = "API", version: str = "1.0.0") -> dict:
    """Components and a collection path per schema."""
    paths = {f"/{s.name}": {"get": {"responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"type": "array", "items": {"$ref": f"#/components/schemas/{s.name}"}}}}}}}} for s in schemas}
    return {"openapi": "3.1.0", "info": {"title": title, "version": version}, "paths": paths, "components": {"schemas": {s.name: {k: v for k, v in to_json_schema(s).items() if k != "$schema"} for s in schemas}}}


def to_hal(record: dict, self_link: str, links: dict[str, str] | None = None) -> dict:
    return {**record, "_links": {"self": {"href": self_link}, **{k: {"href": v} for k, v in (links or {}).items()}}}


def to_json_ld(record: dict, context: str, type_: str) -> dict:
    return {"@context": context, "@type": type_, **record}


# -- program code and documents --------------------------------------------------------


def _class_name(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"\W|_", name) if p)


def generate(s: Schema, language: str) -> str:
    """A type definition in python, typescript or cpp."""
    name = _class_name(s.name)
    if language == "python":
        body = [f"    {f.name}: {PYTHON_TYPES[f.type]}" for f in s.fields if f.required] + [f"    {f.name}: {PYTHON_TYPES[f.type]} | None = None" for f in s.fields if not f.required]
        return "from dataclasses import dataclass\n\n\n@dataclass\nclass " + name + ":\n" + ("\n".join(body) or "    pass") + "\n"
    if language == "typescript":
        return f"export interface {name} {{\n" + "".join(f"  {f.name}{'' if f.required else '?'}: {TYPESCRIPT_TYPES[f.type]};\n" for f in s.fields) + "}\n"
    if language == "cpp":
        row = lambda f: f"  {CPP_TYPES[f.type]} {f.name};\n" if f.required else f"  std::optional<{CPP_TYPES[f.type]}> {f.name};\n"
        return f"struct {name} {{\n" + "".join(map(row, s.fields)) + "};\n"
    raise ValueError(f"unknown language {language}")


def document(s: Schema, format: str = "md") -> str:
    rows = [(f.name, f.type, "yes" if f.required else "no", json.dumps(f.default) if f.default is not None else "", json.dumps(f.constraints) if f.constraints else "", f.description) for f in s.fields]
    head = ("Field", "Type", "Required", "Default", "Constraints", "Description")
    if format == "md":
        lines = [f"# {s.name} {s.version}", "", s.description, "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)] + ["| " + " | ".join(r) + " |" for r in rows]
        return "\n".join(lines) + "\n"
    if format == "html":
        import html

        cell = lambda t, r: "<tr>" + "".join(f"<{t}>{html.escape(x)}</{t}>" for x in r) + "</tr>"
        return f"<h1>{html.escape(s.name)} {s.version}</h1><p>{html.escape(s.description)}</p><table>" + cell("th", head) + "".join(cell("td", r) for r in rows) + "</table>"
    raise ValueError(format)


# -- GraphQL ------------------------------------------------------------------------------


def to_graphql(s: Schema) -> str:
    """The type in schema definition language."""
    return f"type {_class_name(s.name)} {{\n" + "".join(f"  {f.name}: {GRAPHQL_TYPES[f.type]}{'!' if f.required else ''}\n" for f in s.fields) + "}\n"


def from_graphql(sdl: str) -> list[Schema]:
    back = {"String": "string", "ID": "string", "Int": "int", "Float": "float", "Boolean": "bool", "Binary": "binary", "JSON": "any"}
    out = []
    for name, body in re.findall(r"type\s+(\w+)[^{]*\{([^}]*)\}", sdl):
        fields = [Field(n, "array" if t.startswith("[") else back.get(t.rstrip("!"), "map"), t.endswith("!")) for n, t in re.findall(r"(\w+)\s*(?:\([^)]*\))?\s*:\s*(\[?[\w!]+\]?!?)", body)]
        out.append(Schema(name, fields=tuple(fields)))
    return out


def introspection(schemas: list[Schema]) -> dict:
    """A __schema document with the types and their fields."""
    def shape(f: Field) -> dict:
        inner = {"kind": "SCALAR", "name": GRAPHQL_TYPES[f.type].strip("[]"), "ofType": None}
        if GRAPHQL_TYPES[f.type].startswith("["):
            inner = {"kind": "LIST", "name": None, "ofType": inner}
        return {"kind": "NON_NULL", "name": None, "ofType": inner} if f.required else inner

    return {"__schema": {"queryType": {"name": "Query"}, "types": [{"kind": "OBJECT", "name": _class_name(s.name), "fields": [{"name": f.name, "type": shape(f)} for f in s.fields]} for s in schemas]}}


def relay_connection(s: Schema) -> str:
    n = _class_name(s.name)
    return f"type {n}Edge {{\n  cursor: String!\n  node: {n}!\n}}\n\ntype {n}Connection {{\n  edges: [{n}Edge!]!\n  pageInfo: PageInfo!\n}}\n"


@dataclass
class Selection:
    name: str
    alias: str
    arguments: dict = field(default_factory=dict)
    fields: list[Selection] = field(default_factory=list)


_LEX = re.compile(r'\s*(?:#[^\n]*\n\s*)*("(?:[^"\\]|\\.)*"|\$?\w+(?:\.\d+)?|-\d+(?:\.\d+)?|\.\.\.|[{}():,\[\]!=@])')


class GraphQLError(ValueError):
    pass


def parse_query(text: str, variables: dict | None = None) -> list[Selection]:
    """The selections of one query operation (no fragments)."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise GraphQLError(f"unexpected {text[at : at + 10]!r}")
        tokens.append(m.group(1))
        at = m.end()
    pos = 0

    def peek() -> str:
        return tokens[pos] if pos < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal pos
        got = peek()
        if not got or want and got != want:
            raise GraphQLError(f"expected {want or 'more'}, found {got or 'the end'}")
        pos += 1
        return got

    def value():
        t = take()
        if t.startswith("$"):
            if t[1:] not in (variables or {}):
                raise GraphQLError(f"no variable {t}")
            return variables[t[1:]]
        if t.startswith('"'):
            return json.loads(t)
        if t == "[":
            out = []
            while peek() != "]":
                out.append(value())
                if peek() == ",":
                    take()
            take("]")
            return out
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d+\.\d+", t):
            return float(t)
        return {"true": True, "false": False, "null": None}.get(t, t)

    def selections() -> list[Selection]:
        take("{")
        out = []
        while peek() != "}":
            name = alias = take()
            if not re.fullmatch(r"\w+", name):
                raise GraphQLError(f"unexpected {name}")
            if peek() == ":":
                take()
                name = take()
            s = Selection(name, alias)
            if peek() == "(":
                take()
                while peek() != ")":
                    key = take()
                    take(":")
                    s.arguments[key] = value()
                    if peek() == ",":
                        take()
                take(")")
            if peek() == "{":
                s.fields = selections()
            if peek() == ",":
                take()
            out.append(s)
        take("}")
        if not out:
            raise GraphQLError("empty selection")
        return out

    if peek() == "query":
        take()
        while peek() != "{":
            take()
    out = selections()
    if pos != len(tokens):
        raise GraphQLError(f"unexpected {peek()}")
    return out


def _select(x: Column, kind: T.DataType, fields: list[Selection]) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _select(e, kind.elementType, fields))
    if not isinstance(kind, T.StructType):
        raise GraphQLError("selection on a scalar")
    return F.struct(*[_field(x[s.name], kind, s) for s in fields])


def _field(x: Column, parent: T.StructType, s: Selection) -> Column:
    if s.name not in parent.names:
        raise GraphQLError(f"unknown field {s.name}")
    kind = parent[s.name].dataType
    if s.fields:
        x = _select(x, kind, s.fields)
    elif isinstance(kind, T.StructType):
        raise GraphQLError(f"{s.name} needs a selection")
    if isinstance(kind, T.ArrayType) and "first" in s.arguments:
        x = F.slice(x, 1, int(s.arguments["first"]))
    return x.alias(s.alias)


def validate_query(text: str, tables: dict[str, T.StructType], variables: dict | None = None) -> list[str]:
    """Messages of what is wrong with a query; empty if nothing."""
    try:
        for s in parse_query(text, variables):
            if s.name not in tables:
                raise GraphQLError(f"unknown table {s.name}")
            for f in s.fields:
                _field(F.lit(None), tables[s.name], f)
    except GraphQLError as e:
        return [str(e)]
    return []


def execute(text: str, tables: dict[str, DataFrame], variables: dict | None = None) -> dict[str, DataFrame]:
    """Each top selection as a table: arguments are equality filters, ``first`` a limit, ``orderBy`` a column."""
    out = {}
    for s in parse_query(text, variables):
        if s.name not in tables:
            raise GraphQLError(f"unknown table {s.name}")
        df = tables[s.name]
        args = dict(s.arguments)
        first, order = args.pop("first", None), args.pop("orderBy", None)
        for k, v in args.items():
            if k not in df.columns:
                raise GraphQLError(f"unknown argument {k}")
            df = df.filter(F.col(k).isin(v) if isinstance(v, list) else F.col(k).eqNullSafe(F.lit(v)))
        if order:
            df = df.orderBy(order)
        if first is not None:
            df = df.limit(int(first))
        out[s.alias] = df.select(*[_field(F.col(f.name), df.schema, f) for f in s.fields])
    return out


def resolve_reference(references: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Federation: the entities that references (key) name, in a join on the key."""
    return references.join(entities, key, "left")
