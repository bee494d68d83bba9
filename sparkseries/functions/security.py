"""Signatures and checks of binary values."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import ship_package
from ..sources import wire


def hmac_sha256(payload: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a binary column out of ``sha2`` alone, so it stays in the JVM."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, payload), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def verify(payload: Column, signature: Column, key: bytes) -> Column:
    return F.coalesce(hmac_sha256(payload, key) == signature, F.lit(False))


def sign_bytes(payload: bytes, key: bytes) -> bytes:
    return hmac.new(key, payload, hashlib.sha256).digest()


def verify_bytes(payload: bytes, signature: bytes, key: bytes) -> bool:
    """In constant time."""
    return hmac.compare_digest(sign_bytes(payload, key), signature)


def types_allowed(kinds: Column, allowed: list[str]) -> Column:
    """An array of type names against an allow-list."""
    return F.size(F.array_except(kinds, F.array(*[F.lit(a) for a in allowed]))) == 0


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 1 << 30
    max_depth: int = 100
    max_ratio: float = 1000.0
    max_string: int = 1 << 28
    max_items: int = 1 << 26
    allow_nan: bool = True


def check_bytes(data: bytes, limits: Limits = Limits()) -> dict:
    """valid, errors, and counts of a value's parts (depth is that of the value itself)."""
    errors: list[str] = []
    stats = {"total": 0, "max_depth": 0, "strings": 0, "binaries": 0, "arrays": 0, "maps": 0, "longest_string": 0}
    if not data:
        errors.append("empty")
    if len(data) > limits.max_bytes:
        errors.append("too large")
    if data[:4] == wire.MAGIC and len(data) >= 16:
        packed, size = int.from_bytes(data[8:12], "big"), int.from_bytes(data[12:16], "big")
        if packed == 0 or size / packed > limits.max_ratio or size > limits.max_bytes:
            errors.append("zip bomb")
    if not errors:
        try:
            values = list(wire.decode_all(data))
        except (wire.WireError, RecursionError) as e:
            errors.append(str(e))
            values = []

        def walk(v, depth: int) -> None:
            stats["total"] += 1
            stats["max_depth"] = max(stats["max_depth"], depth)
            if isinstance(v, str):
                stats["strings"] += 1
                stats["longest_string"] = max(stats["longest_string"], len(v))
                if len(v) > limits.max_string:
                    errors.append("string too long")
            elif isinstance(v, bytes):
                stats["binaries"] += 1
            elif isinstance(v, float) and not limits.allow_nan and (v != v or v in (float("inf"), float("-inf"))):
                errors.append("not a finite number")
            elif isinstance(v, list):
                stats["arrays"] += 1
                if len(v) > limits.max_items:
                    errors.append("array too long")
                for x in v:
                    walk(x, depth + 1)
            elif isinstance(v, dict):
                stats["maps"] += 1
                for x in v.values():
                    walk(x, depth + 1)

        for v in values:
            walk(v, 0)
        if stats["max_depth"] > limits.max_depth:
            errors.append("nested too deeply")
    return {"valid": not errors, "errors": errors, **stats}


def quick_check(data: Column) -> Column:
    """Not empty and not starting with the one byte that no value has."""
    return (F.octet_length(data) > 0) & (F.hex(F.substring(data, 1, 1)) != "C1")


def validate_column(df: DataFrame, column: str, limits: Limits = Limits()) -> DataFrame:
    """``df`` with ``check``: struct<valid, errors, total, max_depth, strings, binaries, arrays, maps, longest_string>."""
    ship_package(df.sparkSession)
    shape = "valid boolean, errors array<string>, total long, max_depth long, strings long, binaries long, arrays long, maps long, longest_string long"

    @F.pandas_udf(shape)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([check_bytes(bytes(x) if x is not None else b"", limits) for x in s])

    return df.withColumn("check", run(column))
