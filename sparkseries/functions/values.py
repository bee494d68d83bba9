"""Dynamic values: type tests, equality, encoded size, tabular test, bridges to pandas and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import ship_package
from ..schema.validate import kind
from ..sources import wire


def type_of(v: Column) -> Column:
    """Type name of a VARIANT: nil, bool, int, float, string, binary, array, map."""
    return kind(v)


def equals(a: Column, b: Column) -> Column:
    """Typed equality of two VARIANT columns: the same kind and the same content (JSON's 1 and 1.0 are one number)."""
    same = kind(a).eqNullSafe(kind(b)) & F.to_json(a).eqNullSafe(F.to_json(b))
    return F.coalesce(same, F.lit(False))


def size_of(df: DataFrame, column: str, out: str = "encoded_size") -> DataFrame:
    """``df`` with the bytes a JSON text column's value takes in the binary format."""
    import json

    ship_package(df.sparkSession)

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else len(wire.encode(json.loads(x))))

    return df.withColumn(out, run(column))


def is_tabular(df: DataFrame, column: str) -> DataFrame:
    """One row (tabular): two or more maps, all with the same keys, in a VARIANT column."""
    keys = F.array_join(F.array_sort(F.map_keys(F.try_variant_get(column, "$", "map<string,variant>"))), "\x00")
    facts = df.select(keys.alias("k"), F.coalesce(kind(F.col(column)) == "map", F.lit(False)).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.max("k").alias("b"), F.min(F.col("m").cast("int")).alias("m"))
    return facts.select(((F.col("n") >= 2) & (F.col("m") == 1) & (F.col("a") == F.col("b"))).alias("tabular"))


def from_numpy(spark: SparkSession, array: np.ndarray, name: str = "values") -> DataFrame:
    """Rows of a one- or two-dimensional array with their index; two dimensions give arrays."""
    if array.ndim == 1:
        return spark.createDataFrame(pd.DataFrame({"index": np.arange(len(array)), name: array}))
    return spark.createDataFrame(pd.DataFrame({"index": np.arange(len(array)), name: [r.tolist() for r in array]}))


def to_numpy(df: DataFrame, column: str, order: str = "index", limit: int = 10_000_000) -> np.ndarray:
    """A column of a table of at most ``limit`` rows, in order."""
    n = df.count()
    if n > limit:
        raise ValueError(f"{n} rows, {limit} at most")
    return np.array(df.orderBy(order).select(column).toPandas()[column].tolist())
