"""Spark data source for the binary format: batch read and write, streaming read.

Register with ``register(spark)``, then ``spark.read.format("sparkseries")``.

Options: ``path`` (a file or folder), ``framed`` (values behind four-byte lengths),
``compress`` (writing), ``tabular`` (writing; off gives plain MessagePack),
``rows_per_value`` (rows of a table value when writing).  Column pruning: a read
schema with fewer columns skips the others' bytes.  Files over ``split_bytes`` (64 MB
by default) are split between values that tell their size: frames, tables, texts and
binaries; the heads of these values are all that planning reads of them.
"""

from __future__ import annotations

import datetime as dt
import decimal
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..plans.scratch import ship_package
from . import wire

SUFFIX = ".spw"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def list_files(uri: str, by_time: bool = False) -> list[str]:
    """Files below a folder by name, or by the time of their last change."""
    fs, path = _fs(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [uri]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    found = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return [prefix + f.path for f in sorted(found, key=lambda f: (f.mtime_ns or 0, f.path) if by_time else (0, f.path))]


def read_bytes(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def values_of(data: bytes, framed: bool, columns: set[str] | None, tables: bool = False) -> Iterator[object]:
    yield from wire.read_frames(data, columns, tables) if framed else wire.decode_all(data, columns, tables)


def rows_of(values: Iterator[object]) -> Iterator[dict]:
    """Maps are rows, lists of maps are tables, anything else is a row with one field ``value``."""
    for v in values:
        if isinstance(v, dict):
            yield v
        elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
            yield from v
        elif isinstance(v, list) and not v:
            continue
        else:
            yield {"value": v}


def to_spark(v, kind: T.DataType):
    """A decoded value as Spark takes it for a column of type ``kind``."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(to_spark(v.get(f.name), f.dataType) for f in kind) if isinstance(v, dict) else None
    if isinstance(kind, T.ArrayType):
        items = v.values if isinstance(v, wire.Vector) else v
        return [to_spark(x, kind.elementType) for x in items]
    if isinstance(kind, T.MapType):
        return {k: to_spark(x, kind.valueType) for k, x in v.items()}
    if isinstance(v, wire.Timestamp):
        d = v.to_datetime()
        return d.astimezone(dt.timezone.utc).replace(tzinfo=None) if isinstance(kind, T.TimestampNTZType) else d
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else str(v)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(v))
    return v


def from_spark(v):
    """A Spark value as the format takes it: rows are maps, decimals are texts."""
    if isinstance(v, T.Row):
        return {k: from_spark(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): from_spark(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [from_spark(x) for x in v]
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v


def infer_type(v) -> T.DataType:
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, infer_type(x)) for k, x in v.items()])
    if isinstance(v, list):
        return T.ArrayType(infer_type(v[0]) if v else T.StringType())
    if isinstance(v, wire.Vector):
        return T.ArrayType(T.DoubleType() if v.double else T.FloatType())
    for t, s in [(bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (bytes, T.BinaryType()), (wire.Timestamp, T.TimestampType()), (dt.date, T.DateType())]:
        if isinstance(v, t):
            if t is int and not -(1 << 63) <= v < 1 << 63:
                return T.DecimalType(38, 0)
            return s
    return T.StringType()


class _Part(InputPartition):
    """Bytes [start, end) of a file, all of it where end is None."""

    def __init__(self, uri: str | None, start: int = 0, end: int | None = None):
        self.value, self.start, self.end = uri, start, end


SPLIT_BYTES = 64 << 20


def _size_by_head(head: bytes, framed: bool) -> int | None:
    """Bytes of the value or frame that begins with ``head``; None if its head does not say."""
    if framed:
        return 4 + int.from_bytes(head[:4], "big") if len(head) >= 4 else None
    m = head[0]
    for first, wide, more in ((0xC4, 1, 0), (0xC7, 1, 1), (0xD9, 1, 0)):  # binaries, extensions (with a type byte), texts
        k = m - first
        if 0 <= k < 3:
            wide <<= k
            return 1 + wide + more + int.from_bytes(head[1 : 1 + wide], "big") if len(head) > wide else None
    return None


def split_file(uri: str, framed: bool, limit: int = SPLIT_BYTES) -> list[_Part]:
    """Parts of about ``limit`` bytes that begin and end between values; what no head measures stays in one part."""
    fs, path = _fs(uri)
    total = fs.get_file_info(path).size
    if total <= limit:
        return [_Part(uri)]
    parts, start, at = [], 0, 0
    with fs.open_input_file(path) as f:
        while at < total:
            f.seek(at)
            size = _size_by_head(f.read(6), framed)
            if size is None or at + size > total:
                break
            at += size
            if at - start >= limit:
                parts.append(_Part(uri, start, at))
                start = at
    if start < total:
        parts.append(_Part(uri, start, total))
    return parts


#: Types whose columns pass between Spark and the format as Arrow arrays.
PLAIN = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.ByteType: pa.int8(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}


def is_plain(schema: T.StructType) -> bool:
    return len(schema) > 0 and all(type(f.dataType) in PLAIN for f in schema)


def _array(values: list, kind: T.DataType) -> pa.Array:
    try:
        return pa.array(values, PLAIN[type(kind)])
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):  # values of other types than the column's
        return pa.array([to_spark(v, kind) for v in values], PLAIN[type(kind)])


def _batches(values: Iterator[object], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Tables column by column; other values are gathered to tables first."""
    names = [f.name for f in schema]
    held: list[dict] = []

    def gathered() -> wire.Table:
        return wire.Table(names, [[r.get(n) for r in held] for n in names], len(held))

    def batch(t: wire.Table) -> pa.RecordBatch:
        found = dict(zip(t.names, t.columns))
        return pa.RecordBatch.from_arrays([_array(found[f.name], f.dataType) if f.name in found else pa.nulls(t.n_rows, PLAIN[type(f.dataType)]) for f in schema], names)

    for v in values:
        if isinstance(v, wire.Table):
            yield batch(v)
            continue
        held.extend(rows_of(iter([v])))
        if len(held) >= 10_000:
            yield batch(gathered())
            held = []
    if held:
        yield batch(gathered())


def _read(part: _Part, framed: bool, schema: T.StructType) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
    names = {f.name for f in schema}
    fs, path = _fs(part.value)
    with fs.open_input_file(path) as f:
        f.seek(part.start)
        data = f.read() if part.end is None else f.read(part.end - part.start)
    if is_plain(schema):
        yield from _batches(values_of(data, framed, names, tables=True), schema)
        return
    for row in rows_of(values_of(data, framed, names)):
        yield tuple(to_spark(row.get(f.name), f.dataType) for f in schema)


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        framed, limit = self.options.get("framed", "false") == "true", int(self.options.get("split_bytes", SPLIT_BYTES))
        return [p for f in list_files(self.options["path"]) for p in split_file(f, framed, limit)] or [_Part(None)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from _read(partition, self.options.get("framed", "false") == "true", self.schema)


class _StreamReader(DataSourceStreamReader):
    """Offsets count files in the order of their last change: a file must not change once it is there."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def _files(self) -> list[str]:
        try:
            return list_files(self.options["path"], by_time=True)
        except FileNotFoundError:
            return []

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._files())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(f) for f in self._files()[start["files"] : end["files"]]]

    def read(self, partition) -> Iterator[tuple]:
        yield from _read(partition, self.options.get("framed", "false") == "true", self.schema)

    def commit(self, end: dict) -> None:
        pass


class _Message(WriterCommitMessage):
    def __init__(self, temporary: str | None, final: str | None):
        self.temporary, self.final = temporary, final


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, rows) -> WriterCommitMessage:
        size = int(self.options.get("rows_per_value", "10000"))

        def values() -> Iterator[list]:
            held: list = []
            for row in rows:
                held.append(from_spark(row))
                if len(held) >= size:
                    yield held
                    held = []
            if held:
                yield held

        return self._store(values())

    def _store(self, values: Iterator) -> WriterCommitMessage:
        o = self.options
        framed, keep = o.get("framed", "false") == "true", {"tabular": o.get("tabular", "true") == "true"}
        fs, folder = _fs(o["path"])
        name = uuid.uuid4().hex
        temporary, final = f"{folder}/_tmp-{name}", f"{folder}/part-{name}{SUFFIX}"
        fs.create_dir(folder, recursive=True)
        wrote = False
        with fs.open_output_stream(temporary) as sink:
            for v in values:
                # Unframed values follow each other; a compressed one would hide where the next begins.
                sink.write(wire.frames([v], compress=o.get("compress"), **keep) if framed else wire.encode(v, **keep))
                wrote = True
        if not wrote:
            fs.delete_file(temporary)
            return _Message(None, None)
        return _Message(temporary, final)

    def commit(self, messages) -> None:
        fs, folder = _fs(self.options["path"])
        if self.overwrite:
            for f in list_files(self.options["path"]):
                _, path = _fs(f)
                fs.delete_file(path)
        for m in messages:
            if m and m.temporary:
                fs.move(m.temporary, m.final)

    def abort(self, messages) -> None:
        fs, _ = _fs(self.options["path"])
        for m in messages:
            if m and m.temporary:
                fs.delete_file(m.temporary)


class _ArrowWriter(_Writer, DataSourceArrowWriter):
    """The same for tables of plain types, column by column."""

    def write(self, batches) -> WriterCommitMessage:
        size = int(self.options.get("rows_per_value", "10000"))

        def values() -> Iterator[wire.Table]:
            held: list[pa.RecordBatch] = []
            n = 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= size:
                    whole = pa.Table.from_batches(held)
                    for at in range(0, n - n % size, size):
                        yield as_table(whole.slice(at, size))
                    held, n = whole.slice(n - n % size).to_batches(), n % size
            if n:
                yield as_table(pa.Table.from_batches(held))

        def as_table(t: pa.Table) -> wire.Table:
            return wire.Table(t.column_names, [c.to_pylist() for c in t.columns], t.num_rows)

        return self._store(values())


class WireSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkseries"

    def schema(self) -> T.StructType:
        framed = self.options.get("framed", "false") == "true"
        merged: dict[str, T.DataType] = {}
        for f in list_files(self.options["path"])[:1]:
            for _, row in zip(range(1000), rows_of(values_of(read_bytes(f), framed, None))):
                for k, v in row.items():
                    if v is not None:
                        new = infer_type(v)
                        merged[k] = new if merged.get(k, new) == new else (T.DoubleType() if {type(merged[k]), type(new)} == {T.LongType, T.DoubleType} else T.StringType())
                    elif k not in merged:
                        merged.setdefault(k, None)
        return T.StructType([T.StructField(k, t or T.StringType()) for k, t in sorted(merged.items())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return (_ArrowWriter if is_plain(schema) else _Writer)(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(WireSource)
