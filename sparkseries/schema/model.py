"""Schema model, builder, versions, compatibility, differences, migration and registry.

Records are rows with a VARIANT column (``variant_of`` makes one from a struct or
JSON text), because "required" means that a key is present, whatever its value.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ("string", "int", "uint", "float", "number", "bool", "binary", "array", "map", "nil", "any")
STRATEGIES = ("STRICT", "ADDITIVE", "BACKWARD_COMPATIBLE", "FLEXIBLE")


@dataclass(frozen=True, order=True)
class Version:
    major: int = 1
    minor: int = 0
    patch: int = 0

    @classmethod
    def parse(cls, text: str) -> Version:
        parts = text.split(".")
        if len(parts) != 3 or not all(p.isdigit() for p in parts):
            raise ValueError(f"not a version: {text}")
        return cls(*map(int, parts))

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"


def version_key(version: Column) -> Column:
    """A column of version texts as a struct that orders them."""
    part = lambda i: F.split(version, r"\.")[i].cast("int")
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "any"
    required: bool = True
    default: object = None
    description: str = ""
    constraints: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Schema:
    name: str
    version: Version = Version()
    fields: tuple[Field, ...] = ()
    description: str = ""
    strategy: str = "STRICT"
    metadata: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def with_field(self, f: Field) -> Schema:
        return replace(self, fields=tuple(x for x in self.fields if x.name != f.name) + (f,))

    def without_field(self, name: str) -> Schema:
        return replace(self, fields=tuple(x for x in self.fields if x.name != name))

    # -- texts --------------------------------------------------------------------
    def to_dict(self) -> dict:
        return {
            "name": self.name, "version": str(self.version), "description": self.description, "evolution": self.strategy, "metadata": self.metadata,
            "fields": [{"name": f.name, "type": f.type, "required": f.required, "default": f.default, "description": f.description, "constraints": f.constraints} for f in self.fields],
        }

    @classmethod
    def from_dict(cls, d: dict) -> Schema:
        fields = tuple(Field(x["name"], x.get("type", "any"), x.get("required", True), x.get("default"), x.get("description", ""), x.get("constraints") or {}) for x in d.get("fields", ()))
        return cls(d["name"], Version.parse(d.get("version", "1.0.0")), fields, d.get("description", ""), d.get("evolution", "STRICT"), d.get("metadata") or {})

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        return cls.from_dict(json.loads(text))

    def to_spark(self) -> T.StructType:
        """Spark types; requiredness, defaults and constraints go to the fields' metadata."""
        kinds = {"string": T.StringType(), "int": T.LongType(), "uint": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType(), "bool": T.BooleanType(), "binary": T.BinaryType(), "array": T.ArrayType(T.VariantType()), "map": T.MapType(T.StringType(), T.VariantType()), "nil": T.NullType(), "any": T.VariantType()}
        return T.StructType([T.StructField(f.name, kinds[f.type], True, {"required": f.required, "default": json.dumps(f.default), "constraints": json.dumps(f.constraints), "description": f.description}) for f in self.fields])

    @classmethod
    def from_spark(cls, name: str, struct: T.StructType) -> Schema:
        def kind(t: T.DataType) -> str:
            for types, out in [((T.StringType,), "string"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"), ((T.FloatType, T.DoubleType, T.DecimalType), "float"), ((T.BooleanType,), "bool"), ((T.BinaryType,), "binary"), ((T.ArrayType,), "array"), ((T.MapType, T.StructType), "map"), ((T.NullType,), "nil")]:
                if isinstance(t, types):
                    return out
            return "any"

        return cls(name, fields=tuple(Field(f.name, kind(f.dataType), f.metadata.get("required", not f.nullable), json.loads(f.metadata.get("default", "null")), f.metadata.get("description", ""), json.loads(f.metadata.get("constraints", "{}"))) for f in struct))

    # -- evolution ------------------------------------------------------------------
    def is_compatible_with(self, old: Schema) -> bool:
        """Whether data of ``old`` may be read under this schema, by this schema's strategy."""
        if self.strategy == "ADDITIVE":
            return all(old.get(f.name) is not None and old[f.name].type == f.type for f in self.fields if f.required)
        if self.strategy == "BACKWARD_COMPATIBLE":
            return all(old.get(f.name) is not None for f in self.fields if f.required and f.default is None)
        return self.strategy == "FLEXIBLE"

    def diff(self, new: Schema) -> list[str]:
        out = [] if self.version == new.version else [f"Version changed: {self.version} -> {new.version}"]
        for f in new.fields:
            mine = self.get(f.name)
            if mine is None:
                out.append(f"Field added: {f.name}")
                continue
            if mine.type != f.type:
                out.append(f"Field '{f.name}' type changed: {mine.type} -> {f.type}")
            if mine.required != f.required:
                out.append(f"Field '{f.name}' required changed: {int(mine.required)} -> {int(f.required)}")
        return out + [f"Field removed: {f.name}" for f in self.fields if new.get(f.name) is None]

    def table(self, spark: SparkSession) -> DataFrame:
        """The fields as rows (name, type, required)."""
        return spark.createDataFrame([(f.name, f.type, f.required) for f in self.fields], "name string, type string, required boolean")


def diff_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change): added, removed, type or required changed, by a full outer join of two field tables."""
    o, n = (t.select("name", *[F.col(c).alias(f"{p}_{c}") for c in ("type", "required")]) for t, p in ((old, "old"), (new, "new")))
    both = o.join(n, "name", "full_outer")
    changes = F.array_compact(
        F.array(
            F.when(F.col("old_type").isNull(), F.lit("added")),
            F.when(F.col("new_type").isNull(), F.lit("removed")),
            F.when(F.col("old_type") != F.col("new_type"), F.concat(F.lit("type "), "old_type", F.lit(" -> "), "new_type")),
            F.when(F.col("old_required") != F.col("new_required"), F.concat(F.lit("required "), F.col("old_required").cast("string"), F.lit(" -> "), F.col("new_required").cast("string"))),
        )
    )
    return both.select("name", F.explode(changes).alias("change"))


class SchemaBuilder:
    def __init__(self, name: str):
        self._s = Schema(name)

    def version(self, major: int, minor: int = 0, patch: int = 0) -> SchemaBuilder:
        self._s = replace(self._s, version=Version(major, minor, patch))
        return self

    def description(self, text: str) -> SchemaBuilder:
        self._s = replace(self._s, description=text)
        return self

    def field(self, name: str, type: str, required: bool = True) -> SchemaBuilder:
        self._s = self._s.with_field(Field(name, type, required))
        return self

    def optional_field(self, name: str, type: str, default: object = None) -> SchemaBuilder:
        self._s = self._s.with_field(Field(name, type, False, default))
        return self

    def constraint(self, name: str, **constraints) -> SchemaBuilder:
        f = self._s[name]
        at = self._s.fields.index(f)
        new = replace(f, constraints={**f.constraints, **constraints})
        self._s = replace(self._s, fields=self._s.fields[:at] + (new,) + self._s.fields[at + 1 :])
        return self

    def strategy(self, name: str) -> SchemaBuilder:
        if name not in STRATEGIES:
            raise ValueError(name)
        self._s = replace(self._s, strategy=name)
        return self

    def metadata(self, **values) -> SchemaBuilder:
        self._s = replace(self._s, metadata={**self._s.metadata, **values})
        return self

    def build(self) -> Schema:
        return self._s


def time_series_schema() -> Schema:
    return SchemaBuilder("time_series").description("Time series data schema").field("timestamp", "int").field("value", "float").optional_field("tags", "map", {}).constraint("timestamp", min=0).build()


def key_value_schema() -> Schema:
    return SchemaBuilder("key_value").description("Key-value store schema").field("key", "string").field("value", "any").optional_field("ttl", "int", 0).optional_field("metadata", "map", {}).build()


def document_schema() -> Schema:
    return SchemaBuilder("document").description("Document store schema").field("id", "string").field("content", "map").optional_field("created_at", "int").optional_field("updated_at", "int").optional_field("version", "int", 1).build()


def table_schema(columns: list[Field]) -> Schema:
    return Schema("table", fields=tuple(columns), description="Table schema with custom columns")


Migration = Callable[[DataFrame], DataFrame]


class SchemaRegistry:
    """Schemas by name and version, with migrations between versions (direct edges only)."""

    def __init__(self) -> None:
        self._schemas: dict[str, dict[Version, Schema]] = {}
        self._migrations: dict[tuple[str, Version, Version], Migration] = {}

    def register(self, schema: Schema) -> bool:
        """False if this name and version is known already."""
        versions = self._schemas.setdefault(schema.name, {})
        if schema.version in versions:
            return False
        versions[schema.version] = schema
        return True

    def get(self, name: str, version: Version | None = None) -> Schema | None:
        versions = self._schemas.get(name, {})
        return (versions[max(versions)] if versions else None) if version is None else versions.get(version)

    def versions(self, name: str) -> list[Version]:
        return sorted(self._schemas.get(name, {}))

    def remove(self, name: str, version: Version | None = None) -> None:
        if version is None:
            self._schemas.pop(name, None)
        else:
            self._schemas.get(name, {}).pop(version, None)

    def clear(self) -> None:
        self._schemas.clear()

    def add_migration(self, name: str, old: Version, new: Version, f: Migration) -> None:
        self._migrations[name, old, new] = f

    def can_migrate(self, name: str, old: Version, new: Version) -> bool:
        return old == new or (name, old, new) in self._migrations

    def migrate(self, df: DataFrame, name: str, old: Version, new: Version) -> DataFrame:
        if old == new:
            return df
        if (name, old, new) not in self._migrations:
            raise ValueError(f"no migration of {name} from {old} to {new}")
        return df.transform(self._migrations[name, old, new])

    def migrate_to_latest(self, df: DataFrame, name: str, old: Version) -> DataFrame:
        return self.migrate(df, name, old, max(self._schemas[name]))

    def validate(self, df: DataFrame, column: str = "v") -> DataFrame:
        """``df`` with ``schema``: name:version of the first registered schema that accepts the record, else null."""
        from .validate import errors

        tests = [F.when(F.size(errors(F.col(column), s)) == 0, F.lit(f"{n}:{v}")) for n, vs in sorted(self._schemas.items()) for v, s in sorted(vs.items())]
        return df.withColumn("schema", F.coalesce(*tests) if tests else F.lit(None).cast("string"))

    def catalog(self, spark: SparkSession) -> DataFrame:
        """(name, version, schema JSON) for storing; ``latest`` picks per name."""
        rows = [(n, str(v), s.to_json()) for n, vs in self._schemas.items() for v, s in vs.items()]
        return spark.createDataFrame(rows, "name string, version string, schema string")

    @staticmethod
    def latest(catalog: DataFrame) -> DataFrame:
        return catalog.groupBy("name").agg(F.max_by(F.struct("version", "schema"), version_key(F.col("version"))).alias("s")).select("name", "s.version", "s.schema")

    def save(self, spark: SparkSession, path: str) -> None:
        self.catalog(spark).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SchemaRegistry:
        out = cls()
        for r in spark.read.parquet(path).collect():
            out.register(Schema.from_json(r["schema"]))
        return out
