"""Schema queries: inference, validation, merging, differences, migration, JSON Schema and GraphQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.catalog import query, table
from ..schema import export, infer, validate
from ..schema.model import Field, Schema, SchemaBuilder, SchemaRegistry, Version, diff_tables, key_value_schema


def order_records(spark, sf):
    """Orders as VARIANT records; ``note`` is there for every third one only."""
    o = table(spark, sf, "orders")
    s = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("note"))
    return o.select("o_orderkey", validate.variant_of(s).alias("v"))


_RECORDS = "(SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS note FROM orders)"


@query(f"SELECT 'id' AS field, count(*) AS present, 1.0::DOUBLE AS presence FROM {_RECORDS} UNION ALL SELECT 'status', count(*), 1.0 FROM {_RECORDS} UNION ALL SELECT 'price', count(*), 1.0 FROM {_RECORDS} UNION ALL SELECT 'note', count(note), round(count(note) / count(*), 6) FROM {_RECORDS}")
def schema_infer_presence(spark, sf):
    return infer.field_facts(order_records(spark, sf), "v").select("field", "present", F.round("presence", 6).alias("presence"))


@query(f"SELECT 'id' AS field, min(id)::DOUBLE AS min, max(id)::DOUBLE AS max, NULL::INTEGER AS min_length, NULL::INTEGER AS max_length FROM {_RECORDS} UNION ALL SELECT 'price', min(price), max(price), NULL, NULL FROM {_RECORDS} UNION ALL SELECT 'status', NULL, NULL, min(length(status)), max(length(status)) FROM {_RECORDS} UNION ALL SELECT 'note', NULL, NULL, min(length(note)), max(length(note)) FROM {_RECORDS}")
def schema_infer_minmax(spark, sf):
    return infer.field_facts(order_records(spark, sf), "v").select("field", "min", "max", "min_length", "max_length")


@query(f"SELECT 'status' AS field, string_agg(DISTINCT status, ',' ORDER BY status) AS enum FROM {_RECORDS} UNION ALL SELECT 'note', string_agg(DISTINCT note, ',' ORDER BY note) FROM {_RECORDS} UNION ALL SELECT 'id', NULL UNION ALL SELECT 'price', NULL")
def schema_infer_enum(spark, sf):
    return infer.field_facts(order_records(spark, sf), "v").select("field", F.array_join("enum", ",").alias("enum"))


@query("SELECT * FROM (VALUES ('id', 'number', true), ('status', 'string', true), ('price', 'number', true), ('note', 'string', false)) t(name, type, required)")
def schema_infer_types(spark, sf):
    return infer.infer(order_records(spark, sf), "v").table(spark)


def _order_schema(strategy: str = "STRICT") -> Schema:
    return (
        SchemaBuilder("order").strategy(strategy).field("id", "int").field("status", "string").field("price", "number").optional_field("note", "string")
        .constraint("status", enum=["F", "O"]).constraint("price", min=1000.0, max=200000.0).build()
    )


_VALID = f"""SELECT id AS o_orderkey, CASE WHEN status NOT IN ('F', 'O') THEN 'Constraint violation for field: status;' ELSE '' END || CASE WHEN price < 1000 OR price > 200000 THEN 'Constraint violation for field: price;' ELSE '' END AS errors FROM {_RECORDS}"""


@query(_VALID)
def schema_validate_errors(spark, sf):
    out = validate.validate(order_records(spark, sf), "v", _order_schema())
    return out.select("o_orderkey", F.array_join(F.transform("errors", lambda e: F.concat(e, F.lit(";"))), "").alias("errors"))


@query(f"WITH e AS ({_VALID}) SELECT count(*) AS total, count(*) FILTER (errors = '') AS valid, count(*) FILTER (errors <> '') AS invalid, sum(length(errors) - length(replace(errors, ';', '')))::BIGINT AS errors FROM e")
def schema_validation_stats(spark, sf):
    return validate.validation_stats(validate.validate(order_records(spark, sf), "v", _order_schema()))


@query(f"SELECT id AS o_orderkey, CASE WHEN note IS NOT NULL THEN 'Unknown field: note' ELSE '' END AS errors FROM {_RECORDS}")
def schema_validate_unknown(spark, sf):
    s = _order_schema().without_field("note")
    s = Schema(s.name, fields=tuple(Field(f.name, f.type) for f in s.fields))
    return validate.validate(order_records(spark, sf), "v", s).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query(f"SELECT id AS o_orderkey, CASE WHEN note IS NULL THEN 'bare:1.0.0' WHEN true THEN 'order:1.0.0' END AS schema FROM {_RECORDS}")
def schema_registry_validate(spark, sf):
    reg = SchemaRegistry()
    reg.register(SchemaBuilder("order").field("id", "int").field("status", "string").field("price", "number").field("note", "string").build())
    reg.register(SchemaBuilder("bare").field("id", "int").field("status", "string").field("price", "number").build())
    reg.register(key_value_schema())
    return reg.validate(order_records(spark, sf)).select("o_orderkey", "schema")


@query("SELECT * FROM (VALUES ('id', 'number', true), ('name', 'string', false), ('email', 'string', false), ('age', 'int', false)) t(name, type, required)")
def schema_merge(spark, sf):
    rows = [(1, "id", "int", True), (1, "name", "string", True), (2, "id", "int", True), (2, "email", "string", True), (3, "id", "uint", True), (3, "name", "string", True), (3, "age", "int", True)]
    return infer.merge_tables(spark.createDataFrame(rows, "schema int, name string, type string, required boolean"), 3)


@query("SELECT * FROM (VALUES ('email', 'removed'), ('age', 'added'), ('id', 'type int -> string'), ('name', 'required true -> false')) t(name, change)")
def schema_diff(spark, sf):
    old = Schema("user", fields=(Field("id", "int"), Field("name", "string"), Field("email", "string")))
    new = Schema("user", Version(2), (Field("id", "string"), Field("name", "string", False), Field("age", "int", False)))
    return diff_tables(old.table(spark), new.table(spark))


@query("SELECT c_custkey AS id, c_name AS profile_name, c_mktsegment AS profile_segment, 0::INTEGER AS age FROM customer")
def schema_migrate(spark, sf):
    """From flat users to users with a profile."""
    reg = SchemaRegistry()
    reg.register(SchemaBuilder("user").version(1).build())
    reg.register(SchemaBuilder("user").version(2).build())
    reg.add_migration("user", Version(1), Version(2), lambda d: d.select("id", F.struct("name", "segment").alias("profile"), F.lit(0).alias("age")))
    flat = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return reg.migrate_to_latest(flat, "user", Version(1)).select("id", F.col("profile.name").alias("profile_name"), F.col("profile.segment").alias("profile_segment"), "age")


@query("SELECT * FROM (VALUES ('a', '1.10.0'), ('b', '2.0.1')) t(name, version)")
def schema_registry_latest(spark, sf):
    rows = [("a", "1.2.0", "{}"), ("a", "1.10.0", "{}"), ("b", "2.0.1", "{}"), ("b", "2.0.0", "{}")]
    return SchemaRegistry.latest(spark.createDataFrame(rows, "name string, version string, schema string")).select("name", "version")


@query(f"SELECT id AS o_orderkey, CASE WHEN regexp_full_match(note, '[12]-[A-Z]+') OR note IS NULL THEN '' ELSE 'Constraint violation for field: note' END AS errors FROM {_RECORDS}")
def schema_validate_pattern(spark, sf):
    s = SchemaBuilder("order").strategy("FLEXIBLE").field("id", "int").optional_field("note", "string").constraint("note", pattern="[12]-[A-Z]+").build()
    return validate.validate(order_records(spark, sf), "v", s, check_optional=True).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query(f"SELECT 'samples' AS fact, count(*) AS n FROM {_RECORDS} UNION ALL SELECT 'fields', 4 UNION ALL SELECT 'optional', 1 UNION ALL SELECT 'enums', 2")
def schema_infer_statistics(spark, sf):
    records = order_records(spark, sf)
    facts = infer.statistics(infer.infer(records, "v"), infer.field_facts(records, "v"))
    rows = [("samples", facts["samples_analyzed"]), ("fields", facts["fields_discovered"]), ("optional", facts["optional_fields"]), ("enums", facts["enum_fields"])]
    return spark.createDataFrame(rows, "fact string, n long")


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def variant_extract(spark, sf):
    v = F.parse_json("props")
    return table(spark, sf, "events").select("event_id", F.variant_get(v, "$.k", "bigint").alias("k"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT BETWEEN 10 AND 60 AND (props::JSON->>'k')::BIGINT % 2 = 0 OR (props::JSON->>'k')::BIGINT = 7 AS ok FROM events")
def json_schema_validate(spark, sf):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"anyOf": [{"type": "integer", "minimum": 10, "maximum": 60, "multipleOf": 2}, {"const": 7}]}}, "additionalProperties": False}
    return table(spark, sf, "events").select("event_id", validate.json_schema_holds(F.parse_json("props"), schema).alias("ok"))


def nested_customers(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")))).alias("orders"))
    c = table(spark, sf, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("account"), "orders")


@query("SELECT c_custkey AS id, c_name AS owner, min(o_orderkey) AS first_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def graphql_execute(spark, sf):
    q = "query($s: String) { customers(segment: $s) { id account { owner: name } orders(first: 1) { key } } }"
    out = export.execute(q, {"customers": nested_customers(spark, sf)}, {"s": "BUILDING"})["customers"]
    return out.select("id", F.col("account.owner").alias("owner"), F.try_element_at("orders", F.lit(1))["key"].alias("first_key"))


# -- schemas of the tables themselves, against what DuckDB says of their columns -----------------------

_TABLES = ("customer", "orders", "lineitem", "events", "documents", "embeddings")
_COLUMNS = " UNION ALL ".join(f"SELECT '{t}' AS tbl, column_name AS name, column_type AS kind FROM (DESCRIBE SELECT * FROM {t})" for t in _TABLES)


def _kinds(string: str, int_: str, float_: str, array: str, other: str) -> str:
    return f"CASE WHEN kind = 'VARCHAR' THEN '{string}' WHEN kind IN ('BIGINT', 'INTEGER') THEN '{int_}' WHEN kind IN ('DOUBLE', 'FLOAT') THEN '{float_}' WHEN kind LIKE '%[%' THEN '{array}' ELSE '{other}' END"


def table_schemas(spark, sf) -> dict[str, Schema]:
    return {t: Schema.from_spark(t, table(spark, sf, t).schema) for t in _TABLES}


@query(f"SELECT tbl, name, {_kinds('string', 'int', 'float', 'array', 'any')} AS type, false AS required FROM ({_COLUMNS})")
def schema_serialise(spark, sf):
    """Written as JSON, read back, registered, and looked up again."""
    reg = SchemaRegistry()
    for s in table_schemas(spark, sf).values():
        reg.register(Schema.from_json(s.to_json()))
    rows = [(t, f.name, f.type, f.required) for t in _TABLES for f in reg.get(t).fields]
    return spark.createDataFrame(rows, "tbl string, name string, type string, required boolean")


@query(f"SELECT tbl, name, {_kinds('string', 'integer', 'number', 'array', 'none')} AS type, {_kinds('string', 'int', 'float', 'array', 'any')} AS back FROM ({_COLUMNS})")
def schema_json_schema_export(spark, sf):
    """As JSON Schema, and back."""
    rows = []
    for t, s in table_schemas(spark, sf).items():
        made = export.to_json_schema(s)
        back = export.from_json_schema(made)
        rows += [(t, k, p.get("type", "none"), back[k].type) for k, p in made["properties"].items()]
    return spark.createDataFrame(rows, "tbl string, name string, type string, back string")


@query(f"SELECT tbl, '  ' || name || ': ' || {_kinds('String', 'Int', 'Float', '[JSON]', 'JSON')} AS line FROM ({_COLUMNS})")
def schema_graphql_export(spark, sf):
    rows = [(t, line) for t, s in table_schemas(spark, sf).items() for line in export.to_graphql(s).splitlines() if line.startswith("  ")]
    return spark.createDataFrame(rows, "tbl string, line string")


_CODE = {"typescript": ("'  ' || name || '?: ' || ", ("string", "number", "number", "unknown[]", "unknown"), "';'"), "python": ("'    ' || name || ': ' || ", ("str", "int", "float", "list", "object"), "' | None = None'"), "cpp": ("'  std::optional<' || ", ("std::string", "int64_t", "double", "std::vector<Value>", "Value"), "'> ' || name || ';'")}


@query(" UNION ALL ".join(f"SELECT '{lang}' AS language, tbl, {head}{_kinds(*kinds)} || {tail} AS line FROM ({_COLUMNS})" for lang, (head, kinds, tail) in _CODE.items()))
def schema_generate_code(spark, sf):
    rows = [(lang, t, line) for lang in _CODE for t, s in table_schemas(spark, sf).items() for line in export.generate(s, lang).splitlines() if line.startswith("  ")]
    return spark.createDataFrame(rows, "language string, tbl string, line string")


@query(
    f"""WITH c AS ({_COLUMNS}), k AS (SELECT tbl, count(*) AS n FROM c GROUP BY tbl)
    SELECT c.tbl, c.name AS dropped, strategy, CASE strategy WHEN 'FLEXIBLE' THEN true WHEN 'STRICT' THEN false ELSE c.name = f.name END AS compatible
    FROM c JOIN (SELECT tbl, min(name) AS name FROM c GROUP BY tbl) f USING (tbl), (SELECT unnest(['STRICT', 'ADDITIVE', 'BACKWARD_COMPATIBLE', 'FLEXIBLE']) AS strategy)"""
)
def schema_compatibility(spark, sf):
    """Every table without one of its columns, read under a schema that requires all but the first by name."""
    rows = []
    for t, s in table_schemas(spark, sf).items():
        first = min(f.name for f in s.fields)
        for strategy in ("STRICT", "ADDITIVE", "BACKWARD_COMPATIBLE", "FLEXIBLE"):
            new = Schema(t, Version(2), tuple(Field(f.name, f.type, f.name != first) for f in s.fields), strategy=strategy)
            rows += [(t, f.name, strategy, new.is_compatible_with(s.without_field(f.name))) for f in s.fields]
    return spark.createDataFrame(rows, "tbl string, dropped string, strategy string, compatible boolean")


@query(
    """SELECT event_id, event_id % 2 = 0 AS is_date_time, event_id % 300 <= 255 AS is_ipv4, event_id % 3 = 0 AS is_email, event_id % 5 <> 0 AS is_uuid, event_id % 7 <> 0 AS is_date, event_id % 4 <> 0 AS is_pointer, event_id % 6 <> 0 AS is_ipv6 FROM events"""
)
def json_schema_formats(spark, sf):
    """Texts that are of a format by a rule on the id, judged by JSON Schemas."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    n = k.cast("string")
    digest = F.md5(n)
    texts = {
        "date-time": F.when(k % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH.mm")),
        "ipv4": F.concat((k % 300).cast("string"), F.lit(".0.0.1")),
        "email": F.concat(F.lit("u"), n, F.when(k % 3 == 0, F.lit("@example.org")).otherwise(F.lit("@example"))),
        "uuid": F.concat_ws("-", digest.substr(1, 8), digest.substr(9, 4), digest.substr(13, 4), digest.substr(17, 4), F.when(k % 5 != 0, digest.substr(21, 12)).otherwise(digest.substr(21, 11))),
        "date": F.when(k % 7 != 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM")),
        "json-pointer": F.concat(F.when(k % 4 != 0, F.lit("/")).otherwise(F.lit("~")), n),
        "ipv6": F.concat(F.lit("2001:db8::"), F.hex(k % 65536), F.when(k % 6 != 0, F.lit("")).otherwise(F.lit("::1"))),
    }
    judged = [validate.json_schema_holds(F.parse_json(F.to_json(F.struct(t.alias("x")))), {"properties": {"x": {"type": "string", "format": f}}}).alias(f"is_{f.replace('-', '_').replace('json_', '')}") for f, t in texts.items()]
    return e.select("event_id", *judged)
