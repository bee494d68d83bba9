"""Schema inference over a table of records: one aggregate per field, no records on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .model import Field, Schema
from .validate import kind


@dataclass(frozen=True)
class InferenceOptions:
    infer_constraints: bool = True
    sample_size: int | None = None
    required_threshold: float = 0.95
    max_enum_values: int = 10
    merge_numeric_types: bool = True
    max_fields: int = 10_000


def field_facts(df: DataFrame, column: str, options: InferenceOptions = InferenceOptions()) -> DataFrame:
    """(field, presence, types, distinct values if few, min, max, lengths, items) per field of a VARIANT column."""
    if options.sample_size is not None:
        df = df.limit(options.sample_size)
    records = df.select(F.try_variant_get(column, "$", "map<string,variant>").alias("m")).filter("m is not null")
    entries = records.select(F.explode("m").alias("field", "v")).withColumn("kind", kind(F.col("v")))
    number = F.when(F.col("kind").isin("int", "float"), F.try_variant_get("v", "$", "double"))
    text = F.when(F.col("kind") == "string", F.try_variant_get("v", "$", "string"))
    items = F.when(F.col("kind") == "array", F.size(F.try_variant_get("v", "$", "array<variant>")))
    entries = entries.select("field", "kind", number.alias("number"), text.alias("text"), items.alias("items"))
    facts = entries.groupBy("field").agg(
        F.count(F.lit(1)).alias("present"), F.array_sort(F.collect_set("kind")).alias("types"), F.min("number").alias("min"), F.max("number").alias("max"),
        F.min(F.char_length("text")).alias("min_length"), F.max(F.char_length("text")).alias("max_length"), F.min("items").alias("min_items"), F.max("items").alias("max_items"),
    )
    # Distinct texts, no more than one over the limit per field.
    few = entries.filter("text is not null").select("field", "text").distinct()
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("field").orderBy("text"))).filter(F.col("_n") <= options.max_enum_values + 1)
    few = few.groupBy("field").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    total = records.agg(F.count(F.lit(1)).alias("records"))
    out = facts.join(few, "field", "left").join(F.broadcast(total))  # one row
    enum = F.when(F.size("texts") <= options.max_enum_values, F.col("texts"))
    return out.select("field", "present", "records", (F.col("present") / F.col("records")).alias("presence"), "types", enum.alias("enum"), "min", "max", "min_length", "max_length", "min_items", "max_items")


def merged_type(types: list[str], options: InferenceOptions = InferenceOptions()) -> str:
    numeric = {"int", "uint", "float", "number"}
    if options.merge_numeric_types and types and set(types) <= numeric:
        return "number"
    return types[0] if len(types) == 1 else "any"


def infer(df: DataFrame, column: str, name: str = "InferredSchema", options: InferenceOptions = InferenceOptions()) -> Schema:
    """A schema from the facts; one row per field comes to the driver, ``options.max_fields`` at most."""
    fields = []
    facts = field_facts(df, column, options).orderBy("field").limit(options.max_fields + 1).collect()
    if len(facts) > options.max_fields:
        raise ValueError(f"more than {options.max_fields} fields: keys of these records are data, not names")
    for r in facts:
        c: dict = {}
        type_ = merged_type(list(r["types"]), options)
        if options.infer_constraints:
            if type_ == "string":
                c = {"minLength": r["min_length"], "maxLength": r["max_length"]} | ({"enum": list(r["enum"])} if r["enum"] else {})
            elif type_ in ("number", "int", "float"):
                c = {"min": r["min"], "max": r["max"]}
            elif type_ == "array":
                c = {"minItems": r["min_items"], "maxItems": r["max_items"]}
        fields.append(Field(r["field"], type_, r["presence"] >= options.required_threshold, None, "", c))
    return Schema(name, fields=tuple(fields))


def statistics(schema: Schema, facts: DataFrame) -> dict:
    rows = facts.collect()
    return {
        "samples_analyzed": rows[0]["records"] if rows else 0, "fields_discovered": len(rows), "optional_fields": sum(not f.required for f in schema.fields),
        "enum_fields": sum("enum" in f.constraints for f in schema.fields), "field_types": {f.name: f.type for f in schema.fields}, "field_presence_ratio": {r["field"]: r["presence"] for r in rows},
    }


def merge(schemas: list[Schema], name: str = "MergedSchema", options: InferenceOptions = InferenceOptions()) -> Schema:
    """Union of the fields; required only if all schemas have and require it."""
    order = list(dict.fromkeys(f.name for s in schemas for f in s.fields))
    fields = []
    for n in order:
        found = [f for s in schemas if (f := s.get(n))]
        types = list(dict.fromkeys(f.type for f in found))
        type_ = types[0] if len(types) == 1 else merged_type(types, options)
        fields.append(Field(n, type_, len(found) == len(schemas) and all(f.required for f in found)))
    return Schema(name, fields=tuple(fields))


def merge_tables(fields: DataFrame, n_schemas: int) -> DataFrame:
    """The same on field tables (schema, name, type, required): (name, type, required)."""
    numeric = F.array(*[F.lit(x) for x in ("float", "int", "number", "uint")])
    g = fields.groupBy("name").agg(F.count_distinct("schema").alias("n"), F.array_sort(F.collect_set("type")).alias("types"), F.min(F.col("required").cast("int")).alias("r"))
    type_ = F.when(F.size("types") == 1, F.col("types")[0]).when(F.size(F.array_except("types", numeric)) == 0, F.lit("number")).otherwise("any")
    return g.select("name", type_.alias("type"), ((F.col("n") == n_schemas) & (F.col("r") == 1)).alias("required"))
