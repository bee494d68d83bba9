"""Column codecs as window expressions: delta, run length, dictionary, delta of deltas, XOR.

All take a table with an order column that is unique within the optional keys.
Series are independent; one long column without keys has a single order, so give
it keys (for example file or block numbers) to spread it over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def delta_encode(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = (), out: str = "delta") -> DataFrame:
    """x[i] - x[i-1], the first against 0."""
    return df.withColumn(out, F.col(value) - F.lag(value, 1, 0).over(_w(keys, order)))


def delta_decode(df: DataFrame, delta: str, order: str, keys: tuple[str, ...] = (), out: str = "value") -> DataFrame:
    return df.withColumn(out, F.sum(delta).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def delta_delta_encode(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = (), out: str = "delta2") -> DataFrame:
    first = delta_encode(df, value, order, keys, "_d")
    return delta_encode(first, "_d", order, keys, out).drop("_d")


def delta_delta_decode(df: DataFrame, delta2: str, order: str, keys: tuple[str, ...] = (), out: str = "value") -> DataFrame:
    return delta_decode(delta_decode(df, delta2, order, keys, "_d"), "_d", order, keys, out).drop("_d")


def xor_encode(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = (), out: str = "xor") -> DataFrame:
    """x[i] xor x[i-1] of a long column (bits of a double: see tscodecs), the first against 0."""
    return df.withColumn(out, F.col(value).bitwiseXOR(F.lag(value, 1, 0).over(_w(keys, order))))


def run_islands(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = (), out: str = "run") -> DataFrame:
    """Number the runs of equal consecutive values from 0 (nulls equal each other)."""
    w = _w(keys, order)
    begins = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    return df.withColumn("_b", begins).withColumn(out, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_b")


def rle_encode(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, run, value, length) per run."""
    return run_islands(df, value, order, keys).groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"))


def rle_decode(runs: DataFrame, value: str, keys: tuple[str, ...] = (), out: str = "pos") -> DataFrame:
    """One row per element; ``out`` counts from 0 within the keys."""
    w = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("length").over(w), F.lit(0))
    return runs.withColumn("_f", first).select(*keys, value, "_f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("_i")).select(*keys, (F.col("_f") + F.col("_i")).alias(out), value)


def dictionary(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, code, value): distinct values numbered by first appearance (codes count within the keys)."""
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return firsts.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1).cast("long").alias("code"), value)


def dictionary_encode(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with ``code``, dictionary)."""
    words = dictionary(df, value, order, keys)
    right = words.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "code", F.col(value).alias("_v"))
    cond = F.col(value).eqNullSafe(F.col("_v"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(right, cond).drop("_v", *[f"_k{i}" for i in range(len(keys))]), words


def dictionary_decode(rows: DataFrame, words: DataFrame, value: str, keys: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    right = words.select(*keys, "code", F.col(value).alias(out or value))
    return rows.join(right, [*keys, "code"])
