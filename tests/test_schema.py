import pytest
from pyspark.sql import functions as F

from sparkseries.schema import export, infer, model, validate
from sparkseries.schema.model import Field, Schema, SchemaBuilder, SchemaRegistry, Version


def records(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").select("i", F.parse_json("j").alias("v"))


def checked(spark, rows, schema, **options):
    return {r.i: list(r.errors) for r in validate.validate(records(spark, rows), "v", schema, **options).collect()}


def test_validation_messages(spark):
    s = SchemaBuilder("p").field("age", "int").field("email", "string").field("status", "string").optional_field("note", "string").constraint("age", min=0, max=150).constraint("email", pattern="[a-z]+@[a-z]+\\.com").constraint("status", enum=["active", "inactive"]).build()
    rows = ['{"age":30,"email":"a@b.com","status":"active"}', '{"age":200,"email":"a@b.com","status":"active"}', '{"age":1.5,"email":"nope","status":"gone"}', '{"email":null,"extra":1,"note":5}', "[1]"]
    got = checked(spark, rows, s)
    assert got[0] == []
    assert got[1] == ["Constraint violation for field: age"]
    assert got[2] == ["Invalid type for field 'age': expected int", "Constraint violation for field: email", "Constraint violation for field: status"]
    assert got[3] == ["Missing required field: age", "Invalid type for field 'email': expected string", "Missing required field: status", "Unknown field: extra"]
    assert got[4] == ["not a map"]
    assert "Invalid type for field 'note': expected string" in checked(spark, rows, s, check_optional=True)[3]


def test_every_type(spark):
    rows = ['{"s":"x","i":1,"f":1.5,"e":1e300,"b":true,"a":[1],"m":{"k":1},"n":null}']
    good = {"s": "string", "i": "int", "f": "float", "e": "float", "b": "bool", "a": "array", "m": "map", "n": "nil"}
    s = Schema("x", fields=tuple(Field(k, t) for k, t in good.items()))
    assert checked(spark, rows, s)[0] == []
    anything = Schema("x", fields=tuple(Field(k, "any") for k in good))
    assert checked(spark, rows, anything)[0] == []
    assert checked(spark, rows, Schema("x", fields=(Field("i", "number"), Field("f", "number"), Field("e", "uint"), Field("q", "bad")), strategy="FLEXIBLE"))[0] == ["Invalid type for field 'e': expected uint", "Missing required field: q"]


def test_inference(spark):
    rows = ['{"id":1,"name":"Alice","tags":["a"]}', '{"id":2,"name":"Bob","tags":[]}', '{"id":2.5,"name":"Bob","mixed":1}', '{"id":4,"name":"Al","mixed":"x"}']
    s = infer.infer(records(spark, rows), "v")
    assert [(f.name, f.type, f.required) for f in s.fields] == [("id", "number", True), ("mixed", "any", False), ("name", "string", True), ("tags", "array", False)]
    assert s["name"].constraints == {"minLength": 2, "maxLength": 5, "enum": ["Al", "Alice", "Bob"]} and s["id"].constraints == {"min": 1.0, "max": 4.0} and s["tags"].constraints == {"minItems": 0, "maxItems": 1}
    assert all(not e for e in checked(spark, rows, s).values())  # what is inferred accepts its source
    threshold = infer.infer(records(spark, rows), "v", options=infer.InferenceOptions(required_threshold=0.5, merge_numeric_types=False, max_enum_values=2))
    assert threshold["mixed"].required and threshold["id"].type == "any" and "enum" not in threshold["name"].constraints
    stats = infer.statistics(s, infer.field_facts(records(spark, rows), "v"))
    assert (stats["samples_analyzed"], stats["fields_discovered"], stats["optional_fields"], stats["enum_fields"]) == (4, 4, 2, 1)
    assert infer.infer(records(spark, rows).limit(0), "v").fields == ()


def test_merge_diff_and_compatibility():
    a = Schema("u", fields=(Field("id", "int"), Field("name", "string")))
    b = Schema("u", Version(1, 1), (Field("id", "float"), Field("age", "int", False)))
    m = infer.merge([a, b])
    assert [(f.name, f.type, f.required) for f in m.fields] == [("id", "number", True), ("name", "string", False), ("age", "int", False)]
    assert a.diff(b) == ["Version changed: 1.0.0 -> 1.1.0", "Field 'id' type changed: int -> float", "Field added: age", "Field removed: name"]
    from dataclasses import replace

    more = replace(a, version=Version(1, 1)).with_field(Field("age", "int", False, 0))
    assert not more.is_compatible_with(a)
    assert replace(more, strategy="ADDITIVE").is_compatible_with(a) and replace(more, strategy="FLEXIBLE").is_compatible_with(b)
    assert not replace(more.with_field(Field("x", "int")), strategy="BACKWARD_COMPATIBLE").is_compatible_with(a)
    assert replace(more.with_field(Field("x", "int", True, 3)), strategy="BACKWARD_COMPATIBLE").is_compatible_with(a)
    assert Schema.from_json(more.to_json()) == more and Schema.from_spark("u", more.to_spark()).fields == more.fields
    assert Version.parse("1.10.0") > Version.parse("1.9.3")
    with pytest.raises(ValueError):
        Version.parse("1.2")


def test_registry(spark, tmp_path):
    reg = SchemaRegistry()
    assert reg.register(model.time_series_schema()) and not reg.register(model.time_series_schema())
    reg.register(SchemaBuilder("time_series").version(1, 10).build())
    reg.register(model.document_schema())
    assert reg.get("time_series").version == Version(1, 10) and reg.versions("time_series") == [Version(), Version(1, 10)] and reg.get("none") is None
    reg.save(spark, str(tmp_path / "r"))
    back = SchemaRegistry.load(spark, str(tmp_path / "r"))
    assert back.get("document") == model.document_schema() and back.versions("time_series") == reg.versions("time_series")
    df = spark.range(3)
    with pytest.raises(ValueError):
        reg.migrate(df, "time_series", Version(), Version(1, 10))
    reg.add_migration("time_series", Version(), Version(1, 10), lambda d: d.withColumn("x", F.lit(1)))
    assert reg.can_migrate("time_series", Version(), Version(1, 10)) and reg.migrate_to_latest(df, "time_series", Version()).columns == ["id", "x"]
    reg.remove("time_series", Version(1, 10))
    assert reg.get("time_series").version == Version()


CASES = [
    ({"type": "integer"}, ["1"], ["1.5", '"a"', "null"]),
    ({"type": ["string", "null"], "minLength": 2, "maxLength": 3}, ['"ab"', "null"], ['"a"', '"abcd"', "1"]),
    ({"const": {"a": [1, None]}}, ['{"a":[1,null]}'], ['{"a":[1]}']),
    ({"enum": [1, "x", None]}, ["1", '"x"', "null"], ["2"]),
    ({"minimum": 2, "exclusiveMaximum": 5, "multipleOf": 0.5}, ["2", "4.5", '"text"'], ["1", "5", "2.3"]),
    ({"pattern": "^a+$"}, ['"aa"', "1"], ['"ab"']),
    ({"type": "array", "items": {"type": "integer"}, "minItems": 1, "uniqueItems": True}, ["[1,2]"], ["[]", "[1,1]", '["a"]', "{}"]),
    ({"required": ["a"], "properties": {"a": {"type": "string"}}, "additionalProperties": False}, ['{"a":"x"}', "[]"], ["{}", '{"a":1}', '{"a":"x","b":1}']),
    ({"patternProperties": {"^n_": {"type": "number"}}, "maxProperties": 2}, ['{"n_a":1,"z":"q"}'], ['{"n_a":"x"}', '{"a":1,"b":1,"c":1}']),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, ["1", "2.5"], ["3"]),
    ({"anyOf": [{"type": "string"}, {"minimum": 2}], "not": {"const": 7}}, ['"a"', "3"], ["1", "7"]),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}, ['{"k":1,"x":0}', '{"k":2,"y":0}'], ['{"k":1}', '{"k":2}']),
    ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}, "v": {"type": "integer"}}, "required": ["v"]}}}, ['{"v":1,"next":{"v":2}}'], ['{"v":1,"next":{"v":"x"}}', '{"next":{"v":1}}']),
    ({"format": "ipv4"}, ['"1.2.3.4"', "5"], ['"1.2.3.400"']),
    ({"format": "uuid"}, ['"123e4567-e89b-12d3-a456-426614174000"'], ['"123"']),
    ({"format": "date-time"}, ['"2024-01-02T03:04:05Z"'], ['"2024-01-02"']),
    ({"format": "email"}, ['"a@b.co"'], ['"a@b"', '"a b@c.d"']),
    (True, ["1"], []),
    (False, [], ["1"]),
]


def test_json_schema(spark):
    for schema, good, bad in CASES:
        rows = good + bad
        out = records(spark, rows).select("i", validate.json_schema_holds(F.col("v"), schema).alias("ok")).collect()
        got = {r.i: r.ok for r in out}
        assert [got[i] for i in range(len(rows))] == [True] * len(good) + [False] * len(bad), schema


def test_exports():
    s = SchemaBuilder("user_record").description("A <user>").field("id", "int").optional_field("tags", "array").constraint("id", min=1).build()
    j = export.to_json_schema(s)
    assert j["properties"]["id"] == {"type": "integer", "minimum": 1} and j["required"] == ["id"] and j["additionalProperties"] is False
    assert [(f.name, f.type, f.required, f.constraints) for f in export.from_json_schema(j).fields] == [("id", "int", True, {"min": 1}), ("tags", "array", False, {})]
    assert export.to_graphql(s) == "type UserRecord {\n  id: Int!\n  tags: [JSON]\n}\n"
    assert [(f.name, f.type, f.required) for f in export.from_graphql(export.to_graphql(s))[0].fields] == [("id", "int", True), ("tags", "array", False)]
    scope: dict = {}
    exec(export.generate(s, "python"), scope)
    assert scope["UserRecord"](id=1).tags is None
    assert "tags?: unknown[];" in export.generate(s, "typescript") and "std::optional" in export.generate(s, "cpp")
    assert "| id | int | yes |" in export.document(s) and "&lt;user&gt;" in export.document(s, "html")
    with pytest.raises(ValueError):
        export.generate(s, "rust")
    assert export.to_openapi([s])["components"]["schemas"]["user_record"]["required"] == ["id"]
    assert export.json_schema_compatible({"properties": {"a": {"type": "integer"}}, "required": ["a"]}, {"properties": {"a": {"type": "number"}}, "required": ["a"]})
    assert not export.json_schema_compatible({"properties": {"a": {"type": "string"}}}, {"properties": {"a": {"type": "number"}}})
    assert export.introspection([s])["__schema"]["types"][0]["fields"][0]["type"]["kind"] == "NON_NULL" and "UserRecordConnection" in export.relay_connection(s)
    assert export.to_hal({"a": 1}, "/x")["_links"]["self"]["href"] == "/x" and export.to_json_ld({"a": 1}, "c", "T")["@type"] == "T"


def test_graphql(spark):
    df = spark.createDataFrame([(1, ("x", 2), [(1, "a"), (2, "b")]), (2, ("y", 3), [])], "id int, s struct<a:string,b:int>, l array<struct<k:int,v:string>>")
    out = export.execute("{ rows(id: 1) { id inner: s { a } l { v } } }", {"rows": df})["rows"].collect()
    assert [(r.id, r.inner.a, [x.v for x in r.l]) for r in out] == [(1, "x", ["a", "b"])]
    assert export.execute("{ rows(first: 1, orderBy: id) { id } }", {"rows": df})["rows"].count() == 1
    assert export.execute("query q($i: [Int]) { rows(id: $i) { id } }", {"rows": df}, {"i": [1, 2]})["rows"].count() == 2
    for bad in ("{ rows { nope } }", "{ none { id } }", "{ rows { s } }", "{ rows { id", "{ rows(id: $x) { id } }", "{ rows { id { a } } }"):
        assert export.validate_query(bad, {"rows": df.schema}), bad
    assert export.validate_query("{ rows { id s { a b } } }", {"rows": df.schema}) == []
