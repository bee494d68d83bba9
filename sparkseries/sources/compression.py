"""Compression of binary values and columns: presets, choice of an algorithm, estimates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import ship_package

# Numeric levels of the presets.
LEVELS = {
    "ZLIB": {"FASTEST": 1, "FAST": 3, "BALANCED": 6, "HIGH": 7, "MAXIMUM": 9},
    "LZ4": {"FASTEST": 0, "FAST": 1, "BALANCED": 4, "HIGH": 9, "MAXIMUM": 12},
    "ZSTD": {"FASTEST": 1, "FAST": 3, "BALANCED": 5, "HIGH": 9, "MAXIMUM": 19},
    "BROTLI": {"FASTEST": 0, "FAST": 2, "BALANCED": 6, "HIGH": 9, "MAXIMUM": 11},
    "SNAPPY": {},
}
# Fixed values: (algorithm, level, least size, adaptive) of the profiles.
PROFILES = {"realtime": ("LZ4", 1, 128, True), "network": ("ZSTD", 3, 256, True), "storage": ("BROTLI", 9, 64, False), "streaming": ("LZ4", 0, 512, True)}
# Estimated ratio = a + b * distinct bytes / 256.
ESTIMATES = {"NONE": (1.0, 0.0), "LZ4": (0.7, 0.25), "ZLIB": (0.5, 0.4), "ZSTD": (0.45, 0.45), "BROTLI": (0.4, 0.5), "SNAPPY": (0.75, 0.2)}


def numeric_level(algorithm: str, preset: str) -> int:
    levels = LEVELS.get(algorithm.upper(), {})
    return levels.get(preset.upper(), levels.get("BALANCED", 0))


def compress_bytes(data: bytes, algorithm: str, level: int | None = None) -> bytes:
    name = algorithm.upper()
    if name == "NONE":
        return data
    if name == "ZLIB":
        return zlib.compress(data, 6 if level is None else level)
    if name == "ZSTD":
        return zstandard.ZstdCompressor(level=3 if level is None else level).compress(data)
    return _codec(name, level).compress(data, asbytes=True)


def decompress_bytes(data: bytes, algorithm: str, size: int = 1 << 30) -> bytes:
    """The bytes that ``data`` stands for; more than ``size`` of them, or a torn end, is an error."""
    name = algorithm.upper()
    if name == "NONE":
        return data
    if name == "ZLIB":
        d = zlib.decompressobj()
        out = d.decompress(data, size + 1)
        if len(out) <= size and not d.eof:
            raise ValueError("compressed bytes end too early")
    elif name == "ZSTD":
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    elif name == "SNAPPY":
        n = _snappy_length(data)
        out = pa.decompress(data, n, "snappy", asbytes=True) if n <= size else b" " * (size + 1)
    else:
        _codec(name, None)
        stream = pa.CompressedInputStream(pa.BufferReader(data), name.lower())
        out = stream.read(size + 1)
    if len(out) > size:
        raise ValueError(f"more than {size} bytes")
    return out


def _codec(name: str, level: int | None) -> pa.Codec:
    """LZ4 (frames), Brotli and Snappy (raw) come with Arrow."""
    if name not in ("LZ4", "BROTLI", "SNAPPY"):
        raise ValueError(f"unknown algorithm {name}")
    return pa.Codec(name.lower(), compression_level=level if level and name != "SNAPPY" else None)


def _snappy_length(data: bytes) -> int:
    """The length that stands at the beginning as a varint."""
    n = shift = 0
    for x in data[:5]:
        n |= (x & 0x7F) << shift
        if x < 0x80:
            return n
        shift += 7
    raise ValueError("no length")


def select_best_algorithm(data: bytes, prefer_speed: bool = False) -> str:
    """NONE below 128 bytes; LZ4 for speed, and below 64 KB where the bytes vary much; else ZSTD."""
    if len(data) < 128:
        return "NONE"
    if prefer_speed:
        return "LZ4"
    return "LZ4" if len(data) < 65_536 and not highly_compressible(data) else "ZSTD"


def highly_compressible(data: bytes) -> bool:
    """Fewer than 128 different bytes in the first 1024 (of 256 at least)."""
    return len(data) >= 256 and len(set(data[:1024])) < 128


def estimate_ratio(data: bytes, algorithm: str) -> float:
    if len(data) < 64:
        return 1.0
    a, b = ESTIMATES.get(algorithm.upper(), (1.0, 0.0))
    return a + b * len(set(data[:1024])) / 256


def _udf(df_spark, f, kind: str):
    ship_package(df_spark)

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else f(bytes(x)))

    return run


def compress_column(df: DataFrame, column: str, algorithm: str = "ZSTD", preset: str = "BALANCED", out: str | None = None) -> DataFrame:
    """Replace (or add as ``out``) a binary column by its compressed bytes, in Arrow batches."""
    level = numeric_level(algorithm, preset)
    return df.withColumn(out or column, _udf(df.sparkSession, lambda x: compress_bytes(x, algorithm, level), "binary")(column))


def decompress_column(df: DataFrame, column: str, algorithm: str = "ZSTD", out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, _udf(df.sparkSession, lambda x: decompress_bytes(x, algorithm), "binary")(column))


def compress_by_profile(df: DataFrame, column: str, profile: str) -> DataFrame:
    """``df`` with ``packed`` and ``algorithm`` of a binary column: values below the profile's least size stay as they
    are, adaptive profiles choose by the bytes, the others take their own codec."""
    own, level, least, adaptive = PROFILES[profile.lower()]
    ship_package(df.sparkSession)

    @F.pandas_udf("packed binary, algorithm string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = []
            for x in s:
                data = b"" if x is None else bytes(x)
                name = "NONE" if len(data) < least else select_best_algorithm(data, own == "LZ4") if adaptive else own
                out.append((None if x is None else compress_bytes(data, name, level if name == own else None), name))
            yield pd.DataFrame(out, columns=["packed", "algorithm"])

    both = df.withColumn("_packed", run(column))
    return both.withColumns({"packed": F.col("_packed.packed"), "algorithm": F.col("_packed.algorithm")}).drop("_packed")


def decompress_by_name(df: DataFrame, column: str, algorithm: str, out: str) -> DataFrame:
    """``df`` with ``out``: the bytes of ``column``, each by the algorithm named in its row."""
    ship_package(df.sparkSession)

    @F.pandas_udf("binary")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, names in parts:
            yield pd.Series([None if x is None else decompress_bytes(bytes(x), n) for x, n in zip(data, names)], dtype=object)

    return df.withColumn(out, run(column, algorithm))


def profile_column(df: DataFrame, column: str) -> DataFrame:
    """size, different bytes in the first 1024, chosen algorithm and estimated ratio of a binary column - no Python.

    The bytes are looked at as pairs of hex digits.
    """
    head = F.hex(F.substring(column, 1, 1024))
    n = F.least(F.octet_length(column), F.lit(1024))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(head, i * 2 - 1, 2))
    unique = F.when(n == 0, 0).otherwise(F.size(F.array_distinct(pairs)))
    size = F.octet_length(column)
    varied = (size < 256) | (F.col("distinct_bytes") >= 128)
    algorithm = F.when(size < 128, "NONE").when((size < 65_536) & varied, "LZ4").otherwise("ZSTD")
    ratio = F.when(size < 64, F.lit(1.0)).otherwise(_estimate(algorithm, F.col("distinct_bytes")))
    return df.withColumns({"size": size, "distinct_bytes": unique}).withColumns({"algorithm": algorithm, "estimated_ratio": ratio})


def _estimate(algorithm: Column, unique: Column) -> Column:
    out = F.lit(1.0)
    for name, (a, b) in ESTIMATES.items():
        out = F.when(algorithm == name, F.lit(a) + F.lit(b) * unique / 256).otherwise(out)
    return out
