"""Other formats: detection, reading, writing and conversion of whole folders."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scratch import ship_package
from . import wire
from .datasource import _fs, from_spark, register, rows_of, values_of

# File endings.
ENDINGS = {"json": "json", "csv": "csv", "tsv": "csv", "yaml": "yaml", "yml": "yaml", "msgpack": "msgpack", "mp": "msgpack", "xml": "xml", "cbor": "cbor", "parquet": "parquet", "spw": "wire"}


def detect_format(name: str, head: bytes = b"") -> str | None:
    """By the file's ending, else by its first bytes."""
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if end in ENDINGS:
        return ENDINGS[end]
    head = head.lstrip()
    if head[:4] == wire.MAGIC:
        return "wire"
    return {b"{": "json", b"[": "json", b"<": "xml"}.get(head[:1])


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A table from any of the formats; ``schema`` may be given as an option."""
    format = format or detect_format(path)
    schema = options.pop("schema", None)
    if format in ("wire", "msgpack"):
        register(spark)
        r = spark.read.format("sparkseries")
    elif format == "json":
        r = spark.read.format("json").option("multiLine", options.pop("multiLine", None) or not _one_object_a_line(spark, path))
    elif format == "csv":
        r = spark.read.format("csv").option("header", options.pop("header", True)).option("inferSchema", schema is None)
        if path.endswith(".tsv"):
            r = r.option("sep", "\t")
    elif format == "xml":
        r = spark.read.format("xml").option("rowTag", options.pop("rowTag", "row"))
    elif format == "yaml":
        return _yaml(spark, path)
    elif format == "parquet":
        r = spark.read.format("parquet")
    else:
        raise ValueError(f"cannot read {format}")
    return (r.schema(schema) if schema else r).options(**options).load(path)


def _one_object_a_line(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not empty holds a whole JSON object; files that do so are split among tasks."""
    row = spark.read.text(path).filter(F.trim("value") != "").first()
    try:
        return row is not None and isinstance(json.loads(row[0]), dict)
    except ValueError:
        return False


def _yaml(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text column per document: YAML if a parser is installed, JSON (a subset) otherwise."""
    ship_package(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "value": [json.dumps(_load_yaml(bytes(c).decode())) for c in f["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, value string")


def _load_yaml(text: str):
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def write(df: DataFrame, path: str, format: str | None = None, mode: str = "errorifexists", **options) -> None:
    format = format or detect_format(path)
    if format in ("wire", "msgpack"):
        register(df.sparkSession)
        if mode == "errorifexists":
            mode = "append"
        w = df.write.format("sparkseries").option("tabular", "false" if format == "msgpack" else "true")
    elif format in ("json", "parquet", "csv"):
        w = df.write.format(format)
        if format == "csv":
            w = w.option("header", options.pop("header", True))
    elif format == "xml":
        w = df.write.format("xml").option("rowTag", options.pop("rowTag", "row"))
    elif format == "yaml":
        df.select(F.concat(F.lit("- "), F.to_json(F.struct(*df.columns))).alias("value")).write.mode(mode).text(path)
        return
    else:
        raise ValueError(f"cannot write {format}")
    w.mode(mode).options(**options).save(path)


def to_wire(value: Column, **options) -> Column:
    """Encode a column of any type (structs become maps) as binary, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda x: wire.encode(json.loads(x), **options))

    return run(F.to_json(F.struct(value.alias("v"))))


def encode_rows(df: DataFrame, out: str = "data", **options) -> DataFrame:
    """(data): each row as one encoded map."""
    ship_package(df.sparkSession)
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({out: [wire.encode({k: from_spark(_plain(v)) for k, v in zip(names, row)}, **options) for row in f.itertuples(index=False, name=None)]})

    return df.mapInPandas(run, f"{out} binary")


def _plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, pd.Timestamp):
        return wire.Timestamp(v.value // 1_000_000_000, v.value % 1_000_000_000)
    if hasattr(v, "item") and not isinstance(v, (bytes, str)) and getattr(v, "shape", ()) == ():
        return v.item()
    return v.tolist() if hasattr(v, "tolist") else v


def decode_rows(df: DataFrame, column: str, schema: str, framed: bool = False) -> DataFrame:
    """Rows of all encoded values of a binary column, with an ``error`` column for bytes that are no value."""
    ship_package(df.sparkSession)
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .datasource import to_spark

        names = [f.name for f in kinds]
        for f in frames:
            rows = []
            for data in f[column]:
                try:
                    for r in rows_of(values_of(bytes(data), framed, set(names))):
                        rows.append([to_spark(r.get(k.name), k.dataType) for k in kinds] + [None])
                except wire.WireError as e:
                    rows.append([None] * len(names) + [str(e)])
            yield pd.DataFrame(rows, columns=names + ["error"], dtype=object)

    return df.select(column).mapInPandas(run, f"{schema}, error string")


def convert_folder(spark: SparkSession, source: str, target_format: str) -> DataFrame:
    """(path, format, output, error): every file converted by itself; one bad file fails alone.

    json, msgpack and wire files to json, msgpack, wire or csv bytes.
    """
    ship_package(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                data = bytes(content)
                kind = detect_format(path, data)
                try:
                    out.append((path, kind, _convert(data, kind, target_format), None))
                except Exception as e:  # a file's failure is its result
                    out.append((path, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "format", "output", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "content").mapInPandas(run, "path string, format string, output binary, error string")


def transform_files(spark: SparkSession, source: str, target: str, f: Callable[[object, int], object], compress: str | None = None) -> DataFrame:
    """(path, values, error): every value of every file of ``source`` through ``f(value, index)``, framed, into a file of
    the same name below ``target``.  A file is written whole or not at all; one bad file fails alone."""
    ship_package(spark)

    def one(path: str, data: bytes) -> int:
        made = [f(v, i) for i, v in enumerate(wire.decode_all(data))]
        fs, folder = _fs(target)
        fs.create_dir(folder, recursive=True)
        name = path.rsplit("/", 1)[-1]
        with fs.open_output_stream(f"{folder}/_{name}.tmp") as sink:
            sink.write(wire.frames(made, compress=compress))
        fs.move(f"{folder}/_{name}.tmp", f"{folder}/{name}")
        return len(made)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    out.append((path, one(path, bytes(content)), None))
                except Exception as e:  # a file's failure is its result
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "values", "error"])

    return spark.read.format("binaryFile").load(source).select("path", "content").mapInPandas(run, "path string, values long, error string")


def convert_stream(spark: SparkSession, source: str, target: str, target_format: str, schema: str, checkpoint: str) -> StreamingQuery:
    """New files of ``source`` in the binary format, appended to ``target`` in another one; goes on from ``checkpoint``."""
    register(spark)

    def add(batch: DataFrame, _: int) -> None:
        write(batch, target, target_format, mode="append")

    stream = spark.readStream.format("sparkseries").schema(schema).load(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _convert(data: bytes, kind: str | None, target: str) -> bytes:
    if kind == "json":
        value = json.loads(data)
    elif kind in ("wire", "msgpack"):
        value = wire.decode(data)
    else:
        raise ValueError(f"cannot convert from {kind}")
    if target == "json":
        return json.dumps(value, default=_jsonable, sort_keys=True).encode()
    if target in ("wire", "msgpack"):
        return wire.encode(value, tabular=target == "wire")
    if target == "csv":
        import csv
        import io

        rows = value if isinstance(value, list) else [value]
        sink = io.StringIO()
        w = csv.DictWriter(sink, sorted({k for r in rows for k in r}))
        w.writeheader()
        w.writerows(rows)
        return sink.getvalue().encode()
    raise ValueError(f"cannot convert to {target}")


def _jsonable(v):
    if isinstance(v, wire.Timestamp):
        return v.seconds + v.nanos / 1e9 if v.nanos else v.seconds
    if isinstance(v, wire.Extension):
        return v.data.hex()
    if isinstance(v, wire.Vector):
        return list(v.values)
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    return str(v)
