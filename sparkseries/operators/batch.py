"""Batch processing: pipelines of stages, map-reduce, count and time windows, isolated errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


@dataclass
class Pipeline:
    """Named stages, each DataFrame -> DataFrame; one plan results, nothing is materialised between them."""

    stages: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def add(self, name: str, stage: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline([*self.stages, (name, stage)])

    def process(self, df: DataFrame) -> DataFrame:
        for _, stage in self.stages:
            df = df.transform(stage)
        return df

    def process_observed(self, df: DataFrame) -> tuple[DataFrame, dict[str, Observation]]:
        """The result and, per stage, an observation of its row count (filled by the first action)."""
        seen = {}
        for name, stage in self.stages:
            seen[name] = Observation(name)
            df = df.transform(stage).observe(seen[name], F.count(F.lit(1)).alias("rows"))
        return df, seen


@dataclass(frozen=True)
class BatchOptions:
    """Rows a batch has at most, tasks (0: as the table is dealt), and whether rows keep their order.

    Memory, queues and pools are Spark's: see spark.executor.memory and spark.sql.execution.arrow.maxRecordsPerBatch.
    """

    batch_size: int = 1000
    worker_tasks: int = 0
    preserve_order: bool = False


def process_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, options: BatchOptions = BatchOptions()) -> DataFrame:
    """What ``f`` gives of each batch of rows."""
    if options.worker_tasks:
        df = df.coalesce(options.worker_tasks) if options.preserve_order else df.repartition(options.worker_tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), options.batch_size):
                yield f(frame.iloc[at : at + options.batch_size])

    return df.mapInPandas(run, schema)


def map_reduce(df: DataFrame, key: Column, value: Column, reducers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Map each row to (key, value), reduce per key with algebraic reducers (partial and final aggregates)."""
    mapped = df.select(key.alias("key"), value.alias("value"))
    return mapped.groupBy("key").agg(*[f(F.col("value")).alias(name) for name, f in reducers.items()])


def map_reduce_any(df: DataFrame, key: Column, value: Column, reducer: Callable[[pd.Series], object], schema: str) -> DataFrame:
    """The same with any Python reducer over all values of a key; a key's values must fit one worker."""

    def run(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [k[0]], "value": [reducer(frame["v"])]})

    return df.select(key.alias("k"), value.alias("v")).groupBy("k").applyInPandas(run, schema)


def map_rows(df: DataFrame, f: Callable[[dict], object], result: str) -> DataFrame:
    """Any Python function per row with isolated errors: the row with ``result`` and ``error`` (null if it went well)."""
    names, schema = df.columns, ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values, errors = [], []
            for row in frame.to_dict("records"):
                try:
                    values.append(f(row))
                    errors.append(None)
                except Exception as e:  # a row's failure is its result
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame[names].assign(result=pd.Series(values, index=frame.index, dtype=object), error=pd.Series(errors, index=frame.index, dtype=object))

    return df.mapInPandas(run, f"{schema}, result {result}, error string")


def batch_statistics(df: DataFrame, error: str = "error") -> DataFrame:
    """(total, succeeded, failed) of a table with an error column."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col(error).isNull(), 1)).alias("succeeded"), F.count(error).alias("failed"))


def numbered(df: DataFrame, order: list[str], keys: tuple[str, ...] = (), name: str = "pos") -> DataFrame:
    """0-based place of each row.  With keys: a window.  Without: by ranges, offsets of the ranges added up, so
    no task sees more than its range."""
    if keys:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    from ..plans.scratch import stored

    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    offsets = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_in", inner).join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn(name, (F.col("_first") + F.col("_in")).cast("long")).drop("_part", "_p", "_first", "_in")


def tumbling_count(df: DataFrame, size: int, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows with window_id = pos // size; the last window may be short."""
    return numbered(df, order, keys).withColumn("window_id", F.floor(F.col("pos") / size).cast("long"))


def sliding_count(df: DataFrame, size: int, slide: int, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of every full window [w * slide, w * slide + size); slide 0 means size."""
    slide = slide or size
    rows = numbered(df, order, keys)
    total = rows.groupBy(*keys).agg(F.max("pos").alias("_last")) if keys else rows.agg(F.max("pos").alias("_last"))
    rows = rows.join(total, list(keys)) if keys else rows.join(F.broadcast(total))  # one row
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - (size - 1)) / slide)).cast("long")
    high = F.least(F.floor(F.col("pos") / slide), F.floor((F.col("_last") + 1 - size) / slide)).cast("long")
    return rows.withColumn("_lo", low).withColumn("_hi", high).filter("_lo <= _hi").withColumn("window_id", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi", "_last")


def tumbling_time(df: DataFrame, ts: str, size: str, keys: tuple[str, ...], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys, F.window(F.col(ts), size)["start"].alias("window_start")).agg(*aggs)


def sliding_time(df: DataFrame, ts: str, size: str, slide: str, keys: tuple[str, ...], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys, F.window(F.col(ts), size, slide)["start"].alias("window_start")).agg(*aggs)


def session(df: DataFrame, ts: str, gap: str, keys: tuple[str, ...], *aggs: Column) -> DataFrame:
    """Windows that end ``gap`` after their last row, per key."""
    s = F.session_window(F.col(ts), gap)
    return df.groupBy(*keys, s.alias("_s")).agg(*aggs).withColumns({"session_start": F.col("_s.start"), "session_end": F.col("_s.end")}).drop("_s")


def merge_sorted(frames: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows in one global order (range partitioning, then a sort per range)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy(*order)
