"""Streaming: event-time windows, sessions, ring buffers, retention, continuous queries, subscriptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.scratch import scratch_path, ship_package

#: Rows whose buffers are computed and given out at once.
STEP = 10_000


def event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """With a watermark; zone-less times are read in the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, size: str, keys: tuple[str, ...], *aggs: Column, late: str = "10 minutes") -> DataFrame:
    out = event_time(df, ts, late).groupBy(*keys, F.window(ts, size).alias("w")).agg(*aggs)
    return out.withColumn("window_start", F.col("w.start")).drop("w")


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: tuple[str, ...], *aggs: Column, late: str = "10 minutes") -> DataFrame:
    out = event_time(df, ts, late).groupBy(*keys, F.window(ts, size, slide).alias("w")).agg(*aggs)
    return out.withColumn("window_start", F.col("w.start")).drop("w")


def sessions(df: DataFrame, ts: str, gap: str, keys: tuple[str, ...], *aggs: Column, late: str = "10 minutes") -> DataFrame:
    out = event_time(df, ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggs)
    return out.withColumns({"session_start": F.col("w.start"), "session_end": F.col("w.end")}).drop("w")


def _buffers(y: np.ndarray, held: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the last ``size`` of the first n of ``y``, for n = held .. len(y); NaN for none, equal values deviate by 0."""
    means, devs = np.full(len(y) - held + 1, np.nan), np.zeros(len(y) - held + 1)
    for n in range(held, min(size, len(y) + 1)):  # not full yet
        if n:
            flat = (y[:n] == y[0]).all()
            means[n - held], devs[n - held] = (y[0], 0.0) if flat else (y[:n].mean(), y[:n].std(ddof=1))
    if len(y) >= size:
        full = sliding_window_view(y, size)[max(0, held - size) :]
        flat = full.min(axis=1) == full.max(axis=1)
        means[-len(full) :] = np.where(flat, full[:, 0], full.mean(axis=1))
        if size > 1:
            devs[-len(full) :] = np.where(flat, 0.0, full.std(axis=1, ddof=1))
    return means, devs


def ring_buffer(df: DataFrame, key: str, ts: str, value: str, size: int, threshold: float = 3.0, id: str | None = None) -> DataFrame:
    """(key, ts, value, mean, is_anomaly) per row: state is the last ``size`` values of each key.

    mean is that of the buffer before the row; the row is an anomaly if it lies more
    than ``threshold`` sample deviations from it.  A null value gets the buffer's mean,
    is no anomaly, and does not enter the buffer.

    The rows of one trigger go in the order of ts and ``id``; without an id equal times
    keep the order in which they come.  Spark hands a key's rows over unsorted and in
    several frames, so those of one key and trigger are held together while they are sorted.
    """
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[key]
    order = ["ts", "_id"] if id else ["ts"]
    df = df.select(key, F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"), *[F.col(c).alias("_id") for c in [id] if c])

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], dtype=float)
        name, parts = None, []
        for frame in frames:
            name = frame[key].iloc[:1] if name is None else name
            parts.append(frame[["value", *order]])
        rows = pd.concat(parts, ignore_index=True)
        del parts
        rows = rows.sort_values(order, kind="stable", ignore_index=True)
        for at in range(0, len(rows), STEP):
            part = rows.iloc[at : at + STEP]
            x = part["value"].to_numpy(dtype=float)
            known = ~np.isnan(x)
            before = np.cumsum(known) - known
            y = np.concatenate([held, x[known]])
            with np.errstate(all="ignore"):
                means, devs = _buffers(y, len(held), size)
                odd = known & (devs[before] > 0) & (np.abs(x - means[before]) / devs[before] > threshold)
            held = y[-size:]
            mean = pd.Series(means[before], index=part.index, dtype=float)
            yield pd.DataFrame({key: name.repeat(len(part)).set_axis(part.index), "ts": part["ts"], "value": part["value"], "mean": mean, "is_anomaly": odd})
        state.update((held.tolist(),))

    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts timestamp, value double, mean double, is_anomaly boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def retained(df: DataFrame, ts: str, hours: int) -> DataFrame:
    """Rows no older than ``hours``: a watermark lets state expire, a filter drops old rows on arrival."""
    return event_time(df, ts, f"{hours} hours").filter(F.col(ts) >= F.current_timestamp() - F.expr(f"interval {hours} hours"))


class ContinuousQueries:
    """Periodic aggregates with a callback each, by name."""

    def __init__(self) -> None:
        self._running: dict[str, StreamingQuery] = {}

    def register(self, name: str, df: DataFrame, callback: Callable[[DataFrame, int], None], interval: str | None = None, mode: str = "update") -> StreamingQuery:
        """Call back with every batch; without an interval all that is there is processed and the query ends."""
        w = df.writeStream.outputMode(mode).foreachBatch(callback).queryName(name).option("checkpointLocation", scratch_path(df.sparkSession, f"query-{name}"))
        q = (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
        self._running[name] = q
        return q

    def unregister(self, name: str) -> None:
        q = self._running.pop(name, None)
        if q is not None:
            q.stop()


class Subscriptions:
    """Fan-out of one stream to subscribers, each with its own filter."""

    def __init__(self) -> None:
        self._subscribers: dict[str, tuple[Column, Callable[[DataFrame], None]]] = {}

    def subscribe(self, name: str, condition: Column, callback: Callable[[DataFrame], None]) -> None:
        self._subscribers[name] = (condition, callback)

    def unsubscribe(self, name: str) -> None:
        self._subscribers.pop(name, None)

    def publish(self, batch: DataFrame, _: int = 0) -> None:
        """Use as the function of ``foreachBatch``."""
        batch.persist()
        for condition, callback in list(self._subscribers.values()):
            callback(batch.filter(condition))
        batch.unpersist()
