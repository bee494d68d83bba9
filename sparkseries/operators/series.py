"""Time-series operators over long tables (series key columns, ts, value).

A series table has any number of key columns, one time column, one value column
and a tie-breaking id; operators that share a window specification need one
exchange and one sort together.  Windows are always partitioned by the series
keys, so they spread over the cluster by series; a global series without keys has
only one key and goes through one task unless the operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

AGGREGATES = ("MEAN", "SUM", "MIN", "MAX", "COUNT", "MEDIAN", "STDDEV", "VARIANCE", "FIRST", "LAST", "PERCENTILE")


def aggregate(func: str, value: str = "value", ts: str = "ts", p: float = 0.95) -> Column:
    """One of AGGREGATES as a column; deviation and variance are those of a sample."""
    made = {
        "MEAN": lambda: F.avg(value),
        "SUM": lambda: F.sum(value),
        "MIN": lambda: F.min(value),
        "MAX": lambda: F.max(value),
        "COUNT": lambda: F.count(value),
        "MEDIAN": lambda: F.median(value),
        "STDDEV": lambda: F.stddev_samp(value),
        "VARIANCE": lambda: F.var_samp(value),
        "FIRST": lambda: F.min_by(value, ts),
        "LAST": lambda: F.max_by(value, ts),
        "PERCENTILE": lambda: F.percentile(value, p),
    }
    if func.upper() not in made:
        raise ValueError(f"unknown aggregate {func}")
    return made[func.upper()]()


def bucket(ts: str, interval: str) -> Column:
    """Start of the epoch-aligned, left-closed bucket of ``interval``."""
    return F.window(F.col(ts), interval)["start"]


@dataclass(frozen=True)
class Series:
    """A series table with the names of its parts."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    ts: str = "ts"
    value: str = "value"
    id: str | None = None

    def with_df(self, df: DataFrame) -> Series:
        return Series(df, self.keys, self.ts, self.value, self.id)

    @property
    def order(self) -> list[str]:
        return [self.ts, self.id] if self.id else [self.ts]

    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    # -- selection ------------------------------------------------------------
    def range(self, start=None, end=None) -> Series:
        """Points in [start, end]; a bound that is None is open."""
        df = self.df
        if start is not None:
            df = df.filter(F.col(self.ts) >= F.lit(start))
        if end is not None:
            df = df.filter(F.col(self.ts) <= F.lit(end))
        return self.with_df(df)

    def at_time(self, ts) -> Series:
        return self.with_df(self.df.filter(F.col(self.ts) == F.lit(ts)))

    def with_tags(self, tags: dict[str, str]) -> Series:
        df = self.df
        for k, v in tags.items():
            df = df.filter(F.col(k) == v)
        return self.with_df(df)

    def latest(self, n: int) -> Series:
        """The last n points of each series."""
        w = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in self.order])
        return self.with_df(self.df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n"))

    def append(self, other: DataFrame) -> Series:
        return self.with_df(self.df.unionByName(other, allowMissingColumns=True))

    # -- aggregation ----------------------------------------------------------
    def aggregate(self, funcs: Sequence[str], start=None, end=None, p: float = 0.95) -> DataFrame:
        cols = [aggregate(f, self.value, self.ts, p).alias(f.lower()) for f in funcs]
        return self.range(start, end).df.groupBy(*self.keys).agg(*cols)

    def resample(self, interval: str, func: str = "MEAN", fill: bool = False) -> DataFrame:
        """(keys, bucket, value) per non-empty bucket; with ``fill`` empty ones between first and last are null."""
        out = self.df.groupBy(*self.keys, bucket(self.ts, interval).alias("bucket")).agg(aggregate(func, self.value, self.ts).alias(self.value))
        if not fill:
            return out
        spans = out.groupBy(*self.keys).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
        grid = spans.select(*self.keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {interval}"))).alias("bucket"))
        return grid.join(out, [*self.keys, "bucket"], "left")

    def autocorrelation(self, lag: int) -> DataFrame:
        """Sum of (x[t] - mean)(x[t+lag] - mean) over the sum of squared deviations."""
        whole = Window.partitionBy(*self.keys)
        df = self.df.withColumn("_d", F.col(self.value) - F.avg(self.value).over(whole))
        df = df.withColumn("_e", F.lag("_d", lag).over(self.w()))
        return df.groupBy(*self.keys).agg(F.try_divide(F.sum(F.col("_d") * F.col("_e")), F.sum(F.col("_d") * F.col("_d"))).alias("autocorrelation"))

    # -- moving functions -----------------------------------------------------
    def moving(self, func: str, n: int, name: str | None = None) -> Series:
        """mean, sum, min, max or stddev of the last n points; null until n points are there."""
        frame = self.w().rowsBetween(-(n - 1), 0)
        made = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "stddev": F.stddev_samp}[func](self.value).over(frame)
        return self.with_df(self.df.withColumn(name or f"moving_{func}", F.when(F.count(F.lit(1)).over(frame) == n, made)))

    def diff(self, lag: int = 1, name: str = "diff") -> Series:
        return self.with_df(self.df.withColumn(name, F.col(self.value) - F.lag(self.value, lag).over(self.w())))

    def pct_change(self, name: str = "pct_change") -> Series:
        """Change over the value before as a double; over zero it is infinite, or NaN if there is no change."""
        prev = F.lag(self.value).over(self.w())
        gap = (F.col(self.value) - prev).cast("double")
        ratio = F.when(prev == 0, gap * F.pow(prev.cast("double"), F.lit(-1.0))).otherwise(F.try_divide(gap, prev.cast("double")))
        return self.with_df(self.df.withColumn(name, ratio))

    def cumsum(self, name: str = "cumsum") -> Series:
        return self.with_df(self.df.withColumn(name, F.sum(self.value).over(self.w().rowsBetween(Window.unboundedPreceding, 0))))

    def shift(self, periods: int, name: str = "shifted") -> Series:
        return self.with_df(self.df.withColumn(name, F.lag(self.value, periods).over(self.w())))

    # -- gaps -----------------------------------------------------------------
    def fill_missing(self, value, name: str = "filled") -> Series:
        return self.with_df(self.df.withColumn(name, F.coalesce(F.col(self.value), F.lit(value))))

    def fill_forward(self, name: str = "filled") -> Series:
        return self.with_df(self.df.withColumn(name, F.last(self.value, True).over(self.w().rowsBetween(Window.unboundedPreceding, 0))))

    def fill_backward(self, name: str = "filled") -> Series:
        return self.with_df(self.df.withColumn(name, F.first(self.value, True).over(self.w().rowsBetween(0, Window.unboundedFollowing))))

    def fill_interpolate(self, name: str = "filled") -> Series:
        """Linear in time between the neighbours that have values; ends stay null."""
        before, after = self.w().rowsBetween(Window.unboundedPreceding, 0), self.w().rowsBetween(0, Window.unboundedFollowing)
        t = F.unix_micros(F.col(self.ts).cast("timestamp"))
        known = F.when(F.col(self.value).isNotNull(), t)
        v0, v1 = F.last(self.value, True).over(before), F.first(self.value, True).over(after)
        t0, t1 = F.last(known, True).over(before), F.first(known, True).over(after)
        line = v0 + (v1 - v0) * F.try_divide((t - t0).cast("double"), (t1 - t0).cast("double"))
        return self.with_df(self.df.withColumn(name, F.coalesce(F.col(self.value), line)))

    def interpolate_at(self, points: DataFrame) -> DataFrame:
        """``points`` (keys, ts) with the value interpolated linearly at each time (exact where a point exists)."""
        mine = self.df.select(*self.keys, F.col(self.ts), F.col(self.value), F.lit(False).alias("_ask"))
        asked = points.select(*self.keys, F.col(self.ts)).distinct().withColumn(self.value, F.lit(None).cast("double")).withColumn("_ask", F.lit(True))
        both = Series(mine.unionByName(asked), self.keys, self.ts, self.value, "_ask")
        return both.fill_interpolate("_v").df.filter("_ask").select(*self.keys, self.ts, F.col("_v").alias(self.value))

    # -- outliers -------------------------------------------------------------
    def _indexed(self) -> DataFrame:
        return self.df.withColumn("index", (F.row_number().over(self.w()) - 1).cast("long"))

    def outliers_zscore(self, threshold: float = 3.0) -> DataFrame:
        """Points more than ``threshold`` sample deviations from the mean, with their 0-based index."""
        whole = Window.partitionBy(*self.keys)
        z = F.try_divide(F.abs(F.col(self.value) - F.avg(self.value).over(whole)), F.stddev_samp(self.value).over(whole))
        return self._indexed().withColumn("z", z).filter(F.col("z") > threshold)

    def outliers_iqr(self, factor: float = 1.5) -> DataFrame:
        """Points outside [Q1 - f IQR, Q3 + f IQR]; quartiles are one row per series, joined back."""
        q = self.df.groupBy(*self.keys).agg(F.percentile(self.value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q")) if self.keys else None
        if q is None:
            q = self.df.agg(F.percentile(self.value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
        reach = (F.col("_q")[1] - F.col("_q")[0]) * factor
        df = self._indexed()
        df = df.join(q, list(self.keys)) if self.keys else df.join(F.broadcast(q))  # one row
        return df.filter((F.col(self.value) < F.col("_q")[0] - reach) | (F.col(self.value) > F.col("_q")[1] + reach)).drop("_q")

    # -- smoothing and indicators ---------------------------------------------
    def ema(self, period: int, name: str = "ema") -> DataFrame:
        """e[t] = a x[t] + (1 - a) e[t-1] with a = 2 / (period + 1), starting at the first value.

        Series are independent, so each is folded by one task (Arrow batches per series).
        """
        return self._sequential({name: ("ema", period)})

    def rsi(self, period: int = 14, name: str = "rsi") -> DataFrame:
        """100 - 100 / (1 + average gain / average loss), Wilder smoothing; null for the first ``period`` points."""
        return self._sequential({name: ("rsi", period)})

    def macd(self, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
        """EMA(fast) - EMA(slow), its EMA(signal) and their difference."""
        return self._sequential({"macd": ("macd", fast, slow, signal), "signal": ("macd_signal", fast, slow, signal), "histogram": ("macd_histogram", fast, slow, signal)})

    def _sequential(self, wanted: dict[str, tuple]) -> DataFrame:
        from .sequential import run_indicators

        return run_indicators(self, wanted)

    def bollinger(self, period: int = 20, factor: float = 2.0) -> Series:
        """middle, upper and lower band: mean and ``factor`` population deviations of the last ``period`` points."""
        frame = self.w().rowsBetween(-(period - 1), 0)
        full = F.count(F.lit(1)).over(frame) == period
        mid, dev = F.avg(self.value).over(frame), F.stddev_pop(self.value).over(frame) * factor
        return self.with_df(self.df.withColumns({"middle": F.when(full, mid), "upper": F.when(full, mid + dev), "lower": F.when(full, mid - dev)}))

    def buffer_stats(self, size: int) -> Series:
        """mean, stddev, min and max of a ring buffer that holds the last ``size`` points."""
        frame = self.w().rowsBetween(-(size - 1), 0)
        v = self.value
        return self.with_df(self.df.withColumns({"current_mean": F.avg(v).over(frame), "current_stddev": F.stddev_samp(v).over(frame), "current_min": F.min(v).over(frame), "current_max": F.max(v).over(frame)}))

    def anomalies(self, size: int, threshold: float = 3.0) -> Series:
        """is_anomaly: more than ``threshold`` deviations from the mean of the ``size`` points before."""
        frame = self.w().rowsBetween(-size, -1)
        z = F.try_divide(F.abs(F.col(self.value) - F.avg(self.value).over(frame)), F.stddev_samp(self.value).over(frame))
        return self.with_df(self.df.withColumn("is_anomaly", F.coalesce(z > threshold, F.lit(False))))

    # -- downsampling ---------------------------------------------------------
    def downsample(self, target: int, method: str = "AVERAGE", seed: int = 42) -> DataFrame:
        """Fewer points per series: AVERAGE, MIN_MAX, FIRST_LAST, M4 (min, max, mean, median), M4_PAPER, RANDOM or LTTB."""
        method = method.upper()
        if method == "LTTB":
            from .sequential import lttb

            return lttb(self, target)
        if method == "RANDOM":
            w = Window.partitionBy(*self.keys).orderBy(F.xxhash64(*self.order, F.lit(seed)), *self.order)
            return self.df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= target).drop("_n")
        v, t = self.value, F.struct(*self.order)
        df = self.df.withColumn("tile", F.ntile(target).over(self.w()))
        aggs = {
            "AVERAGE": [F.min(self.ts).alias(self.ts), F.avg(v).alias(v)],
            "MIN_MAX": [F.min(self.ts).alias(self.ts), F.min(v).alias("min"), F.max(v).alias("max")],
            "FIRST_LAST": [F.min(self.ts).alias(self.ts), F.min_by(v, t).alias("first"), F.max_by(v, t).alias("last")],
            "M4": [F.min(self.ts).alias(self.ts), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.median(v).alias("median")],
            "M4_PAPER": [F.min(self.ts).alias(self.ts), F.min_by(v, t).alias("first"), F.max_by(v, t).alias("last"), F.min(v).alias("min"), F.max(v).alias("max")],
        }[method]
        return df.groupBy(*self.keys, "tile").agg(*aggs)

    # -- decomposition, trends ------------------------------------------------
    def decompose(self, period: int) -> Series:
        """trend (centred moving average), seasonal (mean of the detrended phase, centred) and residual."""
        half = period // 2
        if period % 2:
            frame = self.w().rowsBetween(-half, half)
            trend = F.when(F.count(F.lit(1)).over(frame) == period, F.avg(self.value).over(frame))
        else:  # the two ends count half
            frame, inner = self.w().rowsBetween(-half, half), self.w().rowsBetween(-half + 1, half - 1)
            ends = F.lag(self.value, half).over(self.w()) + F.lead(self.value, half).over(self.w())
            trend = F.when(F.count(F.lit(1)).over(frame) == period + 1, (F.sum(self.value).over(inner) + ends / 2) / period)
        df = self.df.withColumns({"trend": trend, "phase": (F.row_number().over(self.w()) - 1) % period})
        by_phase, phases = Window.partitionBy(*self.keys, "phase"), Window.partitionBy(*self.keys)
        df = df.withColumn("_s", F.avg(F.col(self.value) - F.col("trend")).over(by_phase))
        df = df.withColumn("_one", F.when(F.row_number().over(by_phase.orderBy(*self.order)) == 1, F.col("_s")))
        df = df.withColumn("seasonal", F.col("_s") - F.avg("_one").over(phases))
        df = df.withColumn("residual", F.col(self.value) - F.col("trend") - F.col("seasonal")).drop("_s", "_one")
        return self.with_df(df)

    def linear_trend(self) -> DataFrame:
        """(keys, slope per point, intercept at index 0), by least squares over the index."""
        return self._indexed().groupBy(*self.keys).agg(F.regr_slope(self.value, F.col("index").cast("double")).alias("slope"), F.regr_intercept(self.value, F.col("index").cast("double")).alias("intercept"), F.count(self.value).alias("n"))

    def forecast_linear(self, periods: int) -> DataFrame:
        """(keys, step 1..periods, forecast) on the line through the series."""
        fit = self.linear_trend()
        steps = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")
        return fit.select(*self.keys, "slope", "intercept", "n", steps).select(*self.keys, "step", (F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))).alias("forecast"))


# -- several series ---------------------------------------------------------------


def align(series: list[Series], method: str = "outer", names: list[str] | None = None) -> DataFrame:
    """One row per time, one column per series: outer (default), inner or left join on ts."""
    names = names or [f"v{i}" for i in range(len(series))]
    how = {"outer": "full_outer", "inner": "inner", "left": "left"}[method]
    out = None
    for s, name in zip(series, names):
        one = s.df.select(F.col(s.ts).alias("ts"), F.col(s.value).alias(name))
        out = one if out is None else out.join(one, "ts", how)
    return out


def merge(series: list[Series], func: str = "SUM") -> DataFrame:
    """(ts, value): all points together, those of equal time merged by ``func``."""
    out = None
    for s in series:
        one = s.df.select(F.col(s.ts).alias("ts"), F.col(s.value).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("ts").agg(aggregate(func).alias("value"))


def correlation(a: Series, b: Series, lag: int = 0) -> DataFrame:
    """Pearson correlation over common times; with ``lag`` a[t] against b[t + lag] (lag counts common points)."""
    both = align([a, b], "inner", ["x", "y"])
    if lag:
        both = both.withColumn("y", F.lead("y", lag).over(Window.partitionBy(F.lit(0)).orderBy("ts")))
    return both.agg(F.corr("x", "y").alias("correlation"))


def as_of(left: DataFrame, right: DataFrame, *, by: list[str], on: str, value: str, tolerance: str | None = None, direction: str = "backward") -> DataFrame:
    """``left`` with the last (backward) or next (forward) ``value`` of ``right`` per key.

    Both sides are put into one sorted stream per key, so one exchange and one sort
    do, whatever the number of matches; right rows at the same time count as before.
    """
    l_cols = left.columns
    r = right.select(*by, F.col(on), F.struct(F.col(on).alias("at"), F.col(value).alias("v")).alias("_r"), F.lit(0 if direction == "backward" else 1).alias("_side"))
    both = left.select(*[F.col(c) for c in l_cols], F.lit(1 if direction == "backward" else 0).alias("_side")).unionByName(r, allowMissingColumns=True)
    own = both.withColumn("_own", F.col("_r").isNull())
    w = Window.partitionBy(*by).orderBy(on, "_side")
    seen = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if direction == "backward" else F.first("_r", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = own.withColumn("_m", seen).filter("_own")
    hit = F.col("_m")["v"]
    if tolerance:
        gap = F.abs(F.unix_micros(F.col(on).cast("timestamp")) - F.unix_micros(F.col("_m")["at"].cast("timestamp")))
        hit = F.when(gap <= F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {tolerance}")), hit)
    return out.select(*l_cols, hit.alias(f"asof_{value}"))


def range_join(points: DataFrame, spans: DataFrame, *, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside spans [start, end), numeric axis, through buckets of ``width`` (an equi-join, no cross product)."""
    p = points.withColumn("_b", F.floor(F.col(at) / width).cast("long"))
    last = F.greatest(F.floor(F.col(start) / width), F.ceil(F.col(end) / width) - 1).cast("long")
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), last)))
    return p.join(s, "_b").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


# -- metric store -------------------------------------------------------------------


class MetricStore:
    """Metrics in Parquet, partitioned by metric name, so a query reads its metric only."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def write(self, metric: str, points: DataFrame) -> None:
        """Append points (ts, value, tags map)."""
        points.withColumn("metric", F.lit(metric)).write.mode("append").partitionBy("metric").parquet(self.path)

    def query(self, metric: str, start=None, end=None, tags: dict[str, str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path).filter(F.col("metric") == metric)
        df = Series(df).range(start, end).df
        for k, v in (tags or {}).items():
            df = df.filter(F.try_element_at("tags", F.lit(k)) == v)
        return df

    def query_aggregate(self, metric: str, start, end, interval: str, func: str = "MEAN", tags: dict[str, str] | None = None) -> DataFrame:
        return Series(self.query(metric, start, end, tags), ("metric",)).resample(interval, func)

    def retain(self, metric: str, hours: int) -> DataFrame:
        """Points no older than ``hours`` before the metric's last point."""
        df = self.query(metric)
        last = df.agg(F.max("ts").alias("_last"))
        return df.join(F.broadcast(last)).filter(F.col("ts") >= F.col("_last") - F.expr(f"interval {hours} hours")).drop("_last")  # one row
