"""Command line: schemas and conversions.

    python -m sparkseries.cli infer data.json
    python -m sparkseries.cli validate schema.json data.json
    python -m sparkseries.cli diff old.json new.json
    python -m sparkseries.cli doc schema.json --format html
    python -m sparkseries.cli generate schema.json --language typescript
    python -m sparkseries.cli export schema.json --to jsonschema
    python -m sparkseries.cli convert source-folder target-folder --format wire

Data files are JSON, MessagePack or the binary format; results go to standard output.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from .schema import export
from .schema.model import Schema


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _schema(path: str) -> Schema:
    with open(path, encoding="utf-8") as f:
        return Schema.from_json(f.read())


def _records(spark, path: str):
    """A table with a VARIANT column v."""
    from pyspark.sql import functions as F

    from .schema.validate import kind as kind_of
    from .schema.validate import variant_of
    from .sources.formats import detect_format, read

    kind = detect_format(path)
    if kind == "json":
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        rows = F.when(kind_of(F.col("v")) == "array", F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
        return whole.select(F.explode(rows).alias("v"))
    df = read(spark, path, kind)
    return df.select(variant_of(F.struct(*df.columns)).alias("v"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkseries", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, places in {"infer": ["data"], "validate": ["schema", "data"], "diff": ["old", "new"], "doc": ["schema"], "generate": ["schema"], "export": ["schema"], "convert": ["source", "target"]}.items():
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        if name in ("doc", "convert"):
            c.add_argument("--format", default="md" if name == "doc" else "wire")
        if name == "generate":
            c.add_argument("--language", default="python")
        if name == "export":
            c.add_argument("--to", default="jsonschema", choices=["jsonschema", "graphql", "openapi"])
    a = p.parse_args(args)
    if a.command == "diff":
        print("\n".join(_schema(a.old).diff(_schema(a.new))))
    elif a.command == "doc":
        print(export.document(_schema(a.schema), a.format))
    elif a.command == "generate":
        print(export.generate(_schema(a.schema), a.language))
    elif a.command == "export":
        s = _schema(a.schema)
        print({"jsonschema": lambda: json.dumps(export.to_json_schema(s), indent=2), "graphql": lambda: export.to_graphql(s), "openapi": lambda: json.dumps(export.to_openapi([s]), indent=2)}[a.to]())
    elif a.command == "infer":
        from .schema.infer import infer

        print(json.dumps(infer(_records(_session(), a.data), "v").to_dict(), indent=2))
    elif a.command == "validate":
        from .schema.validate import validate, validation_stats

        stats = validation_stats(validate(_records(_session(), a.data), "v", _schema(a.schema))).first().asDict()
        print(json.dumps(stats))
        return int(stats["invalid"] > 0)
    elif a.command == "convert":
        from .sources.formats import convert_folder

        ends = {"json": "json", "wire": "spw", "msgpack": "msgpack", "csv": "csv"}
        os.makedirs(a.target, exist_ok=True)
        failed = 0
        for r in convert_folder(_session(), a.source, a.format).toLocalIterator():
            name = os.path.basename(r["path"])
            if r["error"]:
                failed += 1
                print(f"{name}: {r['error']}", file=sys.stderr)
                continue
            with open(os.path.join(a.target, f"{name.rsplit('.', 1)[0]}.{ends[a.format]}"), "wb") as f:
                f.write(bytes(r["output"]))
        return int(failed > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
