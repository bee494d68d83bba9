"""Scalar functions: timestamps, decimals, money, percentages, text checks, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- timestamps ------------------------------------------------------------------------


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def to_seconds(ts: Column) -> Column:
    return to_micros(ts).cast("double") / 1e6


def from_micros(n: Column) -> Column:
    return F.timestamp_micros(n)


def from_millis(n: Column) -> Column:
    return F.timestamp_millis(n)


def split_timestamp(ts: Column, offset_minutes: Column | None = None) -> Column:
    """struct<seconds, nanos, tz_offset>: floor division, so negative times split rightly."""
    m = to_micros(ts)
    seconds = F.floor(m / F.lit(1_000_000)).cast("long")
    seconds = (m - F.pmod(m, F.lit(1_000_000))) / 1_000_000
    return F.struct(seconds.cast("long").alias("seconds"), (F.pmod(m, F.lit(1_000_000)) * 1000).cast("int").alias("nanos"), (offset_minutes if offset_minutes is not None else F.lit(None)).cast("smallint").alias("tz_offset"))


# -- decimals --------------------------------------------------------------------------


def decimal(x: Column, precision: int = 38, scale: int = 10) -> Column:
    """Null where the text or number does not fit."""
    return x.try_cast(f"decimal({precision},{scale})")


def from_cents(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")


def to_cents(x: Column) -> Column:
    return (x * 100).cast("long")


def truncate(x: Column, scale: int) -> Column:
    """Toward zero."""
    return F.when(x < 0, F.ceil(x, F.lit(scale))).otherwise(F.floor(x, F.lit(scale)))


def normalize(x: Column) -> Column:
    """The decimal's text without trailing zeros."""
    s = x.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def multiply_and_round(a: Column, b: Column, scale: int) -> Column:
    return F.bround(a * b, scale)


def divide_and_round(a: Column, b: Column, scale: int) -> Column:
    """Null on division by zero."""
    return F.bround(F.try_divide(a, b), scale)


def is_integer(x: Column) -> Column:
    return x == F.floor(x)


# -- money and percentages ----------------------------------------------------------------

#: Signs and digits of currencies.
CURRENCIES = {"USD": ("$", 2), "EUR": ("€", 2), "GBP": ("£", 2), "JPY": ("¥", 0)}


def currency(x: Column, code: str = "USD") -> Column:
    """Rounded half to even to the currency's digits."""
    return F.bround(x.cast("decimal(38,10)"), CURRENCIES.get(code, ("", 2))[1])


def format_currency(x: Column, code: str = "USD") -> Column:
    sign, digits = CURRENCIES.get(code, (code + " ", 2))
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(sign), F.format_number(F.abs(currency(x, code)), digits))


def as_decimal(percent: Column) -> Column:
    return (percent / F.lit(100).cast("decimal(3,0)")).cast("decimal(38,10)")


def as_basis_points(percent: Column) -> Column:
    return (percent * 100).cast("long")


def apply_percentage(percent: Column, x: Column) -> Column:
    return x * percent / F.lit(100).cast("decimal(3,0)")


# -- checks ------------------------------------------------------------------------------


def valid_int(x: Column, bits: int = 64) -> Column:
    n = x.try_cast("decimal(38,0)")
    return F.coalesce(n.between(F.lit(-(2 ** (bits - 1))).cast("decimal(38,0)"), F.lit(2 ** (bits - 1) - 1).cast("decimal(38,0)")), F.lit(False))


def valid_float(x: Column) -> Column:
    """Neither NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def valid_timestamp(seconds: Column) -> Column:
    """1970 to 2100."""
    return F.coalesce(seconds.between(0, 4_102_444_800), F.lit(False))


def valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def sanitize_utf8(data: Column) -> Column:
    """Bad sequences become U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


# -- vectors -----------------------------------------------------------------------------


def _double(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_similarity(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
