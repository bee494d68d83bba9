"""The binary format: a MessagePack superset with columnar tables and typed extensions.

Values: None, bool, int, float, str, bytes, list, dict (string keys, written
sorted), datetime / Timestamp, date, Decimal-free big integers, Vector, Extension.
A list of two or more dicts with equal keys is written column by column
(extension -10) unless ``tabular=False``.
"""

from __future__ import annotations

import datetime as dt
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the format.
MAGIC = b"\x42\x54\x4f\x4e"
EXT_TIMESTAMP, EXT_DATE, EXT_DATETIME, EXT_BIGINT, EXT_FLOATS, EXT_DOUBLES, EXT_TABLE = -1, -2, -3, -4, -5, -6, -10
ALGORITHMS = {"NONE": 255, "ZLIB": 0, "LZ4": 1, "ZSTD": 2, "BROTLI": 3, "SNAPPY": 4}
COLUMN_CODES = {type(None): 0, bool: 1, int: 2, float: 4, str: 5}
MAX_DEPTH = 512


class WireError(ValueError):
    """Bytes that are not a value of the format."""


@dataclass(frozen=True)
class Timestamp:
    """Seconds and nanoseconds since the epoch with an optional offset in minutes (order ignores the offset)."""

    seconds: int
    nanos: int = 0
    offset: int | None = None

    def __lt__(self, other: Timestamp) -> bool:
        return (self.seconds, self.nanos) < (other.seconds, other.nanos)

    def to_micros(self) -> int:
        return self.seconds * 1_000_000 + self.nanos // 1000

    @classmethod
    def from_micros(cls, micros: int) -> Timestamp:
        return cls(micros // 1_000_000, micros % 1_000_000 * 1000)

    @classmethod
    def from_datetime(cls, d: dt.datetime) -> Timestamp:
        off = d.utcoffset()
        utc = d.replace(tzinfo=dt.timezone.utc) if off is None else d.astimezone(dt.timezone.utc)
        gap = utc - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        return cls(gap.days * 86400 + gap.seconds, gap.microseconds * 1000, None if off is None else int(off.total_seconds() // 60))

    def to_datetime(self) -> dt.datetime:
        d = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=self.to_micros())
        return d if self.offset is None else d.astimezone(dt.timezone(dt.timedelta(minutes=self.offset)))


@dataclass(frozen=True)
class Extension:
    type: int
    data: bytes


@dataclass(frozen=True)
class Vector:
    """Floats of 4 (double=False) or 8 bytes."""

    values: tuple[float, ...]
    double: bool = False


def type_name(v) -> str:
    """Name of a value's dynamic type."""
    names = [(type(None), "nil"), (bool, "bool"), (int, "int"), (float, "float"), (str, "string"), ((bytes, bytearray), "binary"), ((list, tuple), "array"), (dict, "map"), ((Timestamp, dt.datetime), "timestamp"), (dt.date, "date"), (Vector, "vector"), (Extension, "extension")]
    return next((n for t, n in names if isinstance(v, t)), "unknown")


def is_tabular(v) -> bool:
    """Two or more maps with the same keys."""
    return isinstance(v, list) and len(v) >= 2 and all(isinstance(r, dict) for r in v) and bool(v[0]) and all(r.keys() == v[0].keys() for r in v)


@dataclass
class Table:
    """A list of maps with the same keys, as columns."""

    names: list[str]
    columns: list[list]
    n_rows: int

    def rows(self) -> list[dict]:
        return [dict(zip(self.names, row)) for row in zip(*self.columns)] if self.columns else [{} for _ in range(self.n_rows)]


class Encoder:
    def __init__(self, tabular: bool = True):
        self.tabular, self.out = tabular, bytearray()

    def _sized(self, n: int, fix: tuple[int, int] | None, marks: list[tuple[int, str]]) -> None:
        """The shortest header for a length: a fixed form below a limit, then 1, 2 or 4 bytes."""
        if fix and n < fix[1]:
            self.out.append(fix[0] | n)
            return
        for mark, code in marks:
            if n < 1 << 8 * struct.calcsize(code):
                self.out.append(mark)
                self.out += struct.pack(">" + code, n)
                return
        raise WireError("value too long")

    def put(self, v) -> None:
        out = self.out
        if v is None:
            out.append(0xC0)
        elif v is True or v is False:
            out.append(0xC3 if v else 0xC2)
        elif isinstance(v, int):
            self._int(v)
        elif isinstance(v, float):
            out.append(0xCB)
            out += struct.pack(">d", v)
        elif isinstance(v, str):
            raw = v.encode("utf-8", "surrogatepass")
            self._sized(len(raw), (0xA0, 32), [(0xD9, "B"), (0xDA, "H"), (0xDB, "I")])
            out += raw
        elif isinstance(v, (bytes, bytearray)):
            self._sized(len(v), None, [(0xC4, "B"), (0xC5, "H"), (0xC6, "I")])
            out += v
        elif isinstance(v, Table):
            if self.tabular and v.n_rows > 1 and v.columns:
                self._table(v.names, v.columns, v.n_rows)
            else:
                self.put(v.rows())
        elif isinstance(v, Vector):
            code = "d" if v.double else "f"
            self._ext(EXT_DOUBLES if v.double else EXT_FLOATS, struct.pack(f">{len(v.values)}{code}", *v.values))
        elif isinstance(v, Extension):
            self._ext(v.type, v.data)
        elif isinstance(v, (list, tuple)):
            if self.tabular and is_tabular(v):
                names = list(v[0])
                self._table(names, [[r[n] for r in v] for n in names], len(v))
            else:
                self._sized(len(v), (0x90, 16), [(0xDC, "H"), (0xDD, "I")])
                for x in v:
                    self.put(x)
        elif isinstance(v, dict):
            self._sized(len(v), (0x80, 16), [(0xDE, "H"), (0xDF, "I")])
            for k in sorted(v):
                self.put(str(k))
                self.put(v[k])
        elif isinstance(v, Timestamp):
            data = struct.pack(">qI", v.seconds, v.nanos)
            self._ext(EXT_TIMESTAMP, data if v.offset is None else data + struct.pack(">h", v.offset))
        elif isinstance(v, dt.datetime):
            self.put(Timestamp.from_datetime(v))
        elif isinstance(v, dt.date):
            self._ext(EXT_DATE, struct.pack(">q", (v - dt.date(1970, 1, 1)).days * 86_400_000))
        else:
            raise WireError(f"cannot write {type(v).__name__}")

    def _int(self, v: int) -> None:
        out = self.out
        if 0 <= v < 128 or -32 <= v < 0:
            out.append(v & 0xFF)
            return
        forms = [(0xCC, "B"), (0xCD, "H"), (0xCE, "I"), (0xCF, "Q")] if v >= 0 else [(0xD0, "b"), (0xD1, "h"), (0xD2, "i"), (0xD3, "q")]
        for mark, code in forms:
            bits = 8 * struct.calcsize(code)
            if v < 1 << bits if v >= 0 else v >= -(1 << (bits - 1)):
                out.append(mark)
                out += struct.pack(">" + code, v)
                return
        self._ext(EXT_BIGINT, v.to_bytes((v.bit_length() + 8) // 8, "big", signed=True))

    def _ext(self, kind: int, data: bytes) -> None:
        n = len(data)
        if n in (1, 2, 4, 8, 16):
            self.out.append(0xD4 + (1, 2, 4, 8, 16).index(n))
        else:
            self._sized(n, None, [(0xC7, "B"), (0xC8, "H"), (0xC9, "I")])
        self.out += struct.pack(">b", kind)
        self.out += data

    def _table(self, names: list[str], columns: list[list], n_rows: int) -> None:
        by_name = sorted(zip(names, columns), key=lambda x: x[0])
        head = bytearray(struct.pack(">III", 1, len(names), n_rows))
        for n, _ in by_name:
            raw = n.encode()
            head += struct.pack(">I", len(raw)) + raw
        head += bytes(COLUMN_CODES.get(type(column[0]), 0) for _, column in by_name)
        for _, column in by_name:
            cells = column_bytes(column)
            if cells is None:
                one = Encoder(self.tabular)
                for x in column:
                    one.put(x)
                cells = one.out
            head += struct.pack(">I", len(cells)) + cells
        self._ext(EXT_TABLE, bytes(head))


# Marks and sizes of integers, and the range that each is the shortest form for.
_INTS = [("u1", 0xCC, 128, 1 << 8), ("u2", 0xCD, 1 << 8, 1 << 16), ("u4", 0xCE, 1 << 16, 1 << 32), ("u8", 0xCF, 1 << 32, 1 << 63), ("i1", 0xD0, -128, -32), ("i2", 0xD1, -(1 << 15), -128), ("i4", 0xD2, -(1 << 31), -(1 << 15)), ("i8", 0xD3, -(1 << 63), -(1 << 31))]


def column_bytes(column: list) -> bytes | None:
    """The cells of a column of one plain type, encoded together; None for any other column."""
    kinds = set(map(type, column))
    if len(kinds) != 1:
        return None
    kind = kinds.pop()
    if kind is float:
        out = np.empty(len(column), [("mark", "u1"), ("v", ">f8")])
        out["mark"], out["v"] = 0xCB, column
        return out.tobytes()
    if kind is bool:
        return bytes(0xC3 if x else 0xC2 for x in column)
    if kind is str:
        raws = [x.encode("utf-8", "surrogatepass") for x in column]
        return b"".join([_string_head(len(x)) + x for x in raws])
    if kind is int and -(1 << 63) <= min(column) and max(column) < 1 << 63:
        v = np.array(column, np.int64)
        size = np.ones(len(v), np.int64)
        found = []
        for code, mark, low, high in _INTS:
            hit = np.flatnonzero((v >= low) & (v <= high - 1))
            if len(hit):
                size[hit] = 1 + int(code[1])
                found.append((code, mark, hit))
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint8)
        out[at] = v & 0xFF  # right where the value is its own byte; the others are written now
        for code, mark, hit in found:
            out[at[hit]] = mark
            cells = v[hit].astype(">" + code).view(np.uint8).reshape(len(hit), -1)
            for b in range(cells.shape[1]):
                out[at[hit] + 1 + b] = cells[:, b]
        return out.tobytes()
    return None


def _string_head(n: int) -> bytes:
    if n < 32:
        return bytes([0xA0 | n])
    if n < 1 << 8:
        return bytes([0xD9, n])
    return struct.pack(">BH", 0xDA, n) if n < 1 << 16 else struct.pack(">BI", 0xDB, n)


def column_values(cells: memoryview, n: int) -> list | None:
    """The ``n`` values of a column whose cells are all of one form or all strings; None for any other column."""
    if not n:
        return None
    mark = cells[0] if len(cells) else 0xC1
    raw = np.frombuffer(cells, np.uint8)
    code = {0xCB: ">f8", 0xCC: ">u1", 0xCD: ">u2", 0xCE: ">u4", 0xCF: ">u8", 0xD0: ">i1", 0xD1: ">i2", 0xD2: ">i4", 0xD3: ">i8"}.get(mark)
    if code:
        width = 1 + int(code[2])
        if len(raw) != n * width or (raw[::width] != mark).any():
            return None
        return np.frombuffer(cells, [("mark", "u1"), ("v", code)])["v"].tolist()
    if len(raw) == n and ((raw < 0x80) | (raw >= 0xE0)).all():
        return raw.view(np.int8).tolist()
    if len(raw) == n and ((raw == 0xC2) | (raw == 0xC3)).all():
        return (raw == 0xC3).tolist()
    if 0xA0 <= mark < 0xC0 or 0xD9 <= mark <= 0xDB:
        data, out, at = bytes(cells), [], 0
        try:
            for _ in range(n):
                m = data[at]
                at += 1
                if 0xA0 <= m < 0xC0:
                    size = m & 31
                elif 0xD9 <= m <= 0xDB:
                    wide = 1 << (m - 0xD9)
                    size = int.from_bytes(data[at : at + wide], "big")
                    at += wide
                else:
                    return None
                out.append(data[at : at + size].decode())
                at += size
        except (IndexError, UnicodeDecodeError):
            return None
        return out if at == len(data) else None
    return None


class Decoder:
    """Reads values from a buffer; ``columns`` limits what tables are decoded to (others are skipped unread).

    With ``tables`` a table that is no part of another value comes as a Table.
    """

    def __init__(self, data: bytes, columns: set[str] | None = None, tables: bool = False):
        self.data, self.at, self.columns, self.tables = memoryview(data), 0, columns, tables

    def _take(self, n: int) -> memoryview:
        if n < 0 or self.at + n > len(self.data):
            raise WireError(f"truncated at byte {self.at}")
        part = self.data[self.at : self.at + n]
        self.at += n
        return part

    def _unpack(self, code: str):
        return struct.unpack(">" + code, self._take(struct.calcsize(">" + code)))[0]

    def get(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise WireError("nested too deeply")
        m = self._unpack("B")
        if m < 0x80:
            return m
        if m >= 0xE0:
            return m - 256
        if m < 0x90:
            return self._map(m & 15, depth)
        if m < 0xA0:
            return self._array(m & 15, depth)
        if m < 0xC0:
            return self._str(m & 31)
        if m in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[m]
        if m == 0xC1:
            raise WireError("0xc1 is no value")
        if m <= 0xC6:
            return bytes(self._take(self._unpack("BHI"[m - 0xC4])))
        if m <= 0xC9:
            return self._ext(self._unpack("BHI"[m - 0xC7]), depth)
        if m <= 0xCB:
            return float(self._unpack("fd"[m - 0xCA]))
        if m <= 0xD3:
            return self._unpack("BHIQbhiq"[m - 0xCC])
        if m <= 0xD8:
            return self._ext(1 << (m - 0xD4), depth)
        if m <= 0xDB:
            return self._str(self._unpack("BHI"[m - 0xD9]))
        if m <= 0xDD:
            return self._array(self._unpack("HI"[m - 0xDC]), depth)
        return self._map(self._unpack("HI"[m - 0xDE]), depth)

    def _str(self, n: int) -> str:
        raw = bytes(self._take(n))
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise WireError(f"string is not UTF-8: {e}") from None

    def _array(self, n: int, depth: int) -> list:
        if n > len(self.data) - self.at:
            raise WireError("array longer than the buffer")
        return [self.get(depth + 1) for _ in range(n)]

    def _map(self, n: int, depth: int) -> dict:
        if n > len(self.data) - self.at:
            raise WireError("map longer than the buffer")
        out = {}
        for _ in range(n):
            k = self.get(depth + 1)
            if not isinstance(k, str):
                raise WireError("map keys must be strings")
            out[k] = self.get(depth + 1)
        return out

    def _ext(self, n: int, depth: int):
        kind, data = self._unpack("b"), bytes(self._take(n))
        if kind == EXT_TIMESTAMP:
            if n in (4, 8):
                return Timestamp(struct.unpack(">I" if n == 4 else ">q", data)[0])
            if n in (12, 14):
                s, ns = struct.unpack_from(">qI", data)
                return Timestamp(s, ns, struct.unpack_from(">h", data, 12)[0] if n == 14 else None)
            raise WireError("timestamp of odd size")
        if kind == EXT_DATE and n == 8:
            return dt.date(1970, 1, 1) + dt.timedelta(days=struct.unpack(">q", data)[0] // 86_400_000)
        if kind == EXT_DATETIME and n == 8:
            ns = struct.unpack(">q", data)[0]
            return Timestamp(ns // 1_000_000_000, ns % 1_000_000_000)
        if kind == EXT_BIGINT:
            return int.from_bytes(data, "big", signed=True)
        if kind in (EXT_FLOATS, EXT_DOUBLES):
            code, size = ("f", 4) if kind == EXT_FLOATS else ("d", 8)
            return Vector(struct.unpack(f">{n // size}{code}", data), kind == EXT_DOUBLES)
        if kind == EXT_TABLE:
            table = self._columns(data)
            return table if self.tables and depth == 0 else table.rows()
        return Extension(kind, data)

    def _columns(self, data: bytes) -> Table:
        d = Decoder(data, self.columns)
        version, n_cols, n_rows = d._unpack("I"), d._unpack("I"), d._unpack("I")
        if version != 1:
            raise WireError("unknown table version")
        names = [d._str(d._unpack("I")) for _ in range(n_cols)]
        d._take(n_cols)
        if n_cols and n_rows > len(data):
            raise WireError("more rows than bytes")
        wanted, columns = [], []
        for name in names:
            cell = d._take(d._unpack("I"))
            if self.columns is not None and name not in self.columns:
                continue
            values = column_values(cell, n_rows)
            if values is None:
                c = Decoder(cell, None)
                values = [c.get() for _ in range(n_rows)]
                if c.at != len(cell):
                    raise WireError("column size differs")
            wanted.append(name)
            columns.append(values)
        return Table(wanted, columns, n_rows)


def encode(v, *, tabular: bool = True, compress: str | None = None, level: int | None = None, least: int = 256) -> bytes:
    """Bytes of a value; compressed behind a header if that saves 5 % and the value has ``least`` bytes."""
    e = Encoder(tabular)
    e.put(v)
    raw = bytes(e.out)
    if compress and compress.upper() != "NONE" and len(raw) >= least:
        from .compression import compress_bytes, select_best_algorithm

        name = select_best_algorithm(raw) if compress.upper() == "AUTO" else compress.upper()
        if name != "NONE":
            packed = compress_bytes(raw, name, level)
            if len(packed) < 0.95 * len(raw):
                return MAGIC + struct.pack(">BBHII", 1, ALGORITHMS[name], 0, len(packed), len(raw)) + packed
    return raw


def unwrap(data: bytes) -> bytes:
    """The plain bytes behind a compression header (or ``data`` itself)."""
    if len(data) < 16 or data[:4] != MAGIC:
        return data
    from .compression import decompress_bytes

    version, code, _, packed, size = struct.unpack_from(">BBHII", data, 4)
    names = {v: k for k, v in ALGORITHMS.items()}
    if version != 1 or code not in names or len(data) < 16 + packed:
        raise WireError("bad compression header")
    try:
        raw = decompress_bytes(data[16 : 16 + packed], names[code], size)
    except Exception as e:  # each codec has its own errors for torn or false bytes
        raise WireError(f"cannot decompress: {e}") from None
    if len(raw) != size:
        raise WireError("decompressed size differs")
    return raw


def decode(data: bytes, columns: set[str] | None = None, tables: bool = False):
    """The one value that ``data`` holds."""
    d = Decoder(unwrap(data), columns, tables)
    v = d.get()
    if d.at != len(d.data):
        raise WireError(f"{len(d.data) - d.at} bytes left over")
    return v


def decode_all(data: bytes, columns: set[str] | None = None, tables: bool = False) -> Iterator[object]:
    """Values that follow each other without framing."""
    d = Decoder(unwrap(data), columns, tables)
    while d.at < len(d.data):
        yield d.get()


def frames(values, **options) -> bytes:
    """Each value behind its length in four bytes."""
    parts = [encode(v, **options) for v in values]
    return b"".join(struct.pack(">I", len(p)) + p for p in parts)


def read_frames(data: bytes, columns: set[str] | None = None, tables: bool = False) -> Iterator[object]:
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise WireError("truncated frame")
        n = struct.unpack_from(">I", data, at)[0]
        if at + 4 + n > len(data):
            raise WireError("truncated frame")
        yield decode(data[at + 4 : at + 4 + n], columns, tables)
        at += 4 + n


def write_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it)."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("bad varint")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
