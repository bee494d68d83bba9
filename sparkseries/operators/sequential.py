"""Operators whose next result needs the last one: smoothing, LTTB, models, change points.

Indicators stream: rows are dealt by series and sorted, and each task carries a
small state from batch to batch, so a long series costs time but no memory.  The
model fits at the end see one series at a time as a frame (see each docstring).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import ship_package


class Ema:
    """e = a x + (1 - a) e, starting at the first value; nulls are passed over."""

    def __init__(self, period: int):
        self.a, self.e = 2.0 / (period + 1), None

    def feed(self, x: float | None) -> float | None:
        if x is not None and x == x:
            self.e = x if self.e is None else self.a * x + (1 - self.a) * self.e
        return self.e


class Rsi:
    """Wilder's relative strength index."""

    def __init__(self, period: int):
        self.n, self.last, self.seen, self.gain, self.loss = period, None, 0, 0.0, 0.0

    def feed(self, x: float | None) -> float | None:
        if x is None or x != x:
            return None
        if self.last is not None:
            d = x - self.last
            up, down = max(d, 0.0), max(-d, 0.0)
            self.seen += 1
            if self.seen <= self.n:
                self.gain += up / self.n
                self.loss += down / self.n
            else:
                self.gain += (up - self.gain) / self.n
                self.loss += (down - self.loss) / self.n
        self.last = x
        if self.seen < self.n:
            return None
        return 100.0 if self.loss == 0 else 100.0 - 100.0 / (1.0 + self.gain / self.loss)


class Macd:
    def __init__(self, fast: int, slow: int, signal: int, part: str):
        self.fast, self.slow, self.sign, self.part = Ema(fast), Ema(slow), Ema(signal), part

    def feed(self, x: float | None) -> float | None:
        f, s = self.fast.feed(x), self.slow.feed(x)
        if f is None:
            return None
        line = f - s
        signal = self.sign.feed(line)
        return {"macd": line, "macd_signal": signal, "macd_histogram": line - signal}[self.part]


def _state(spec: tuple):
    kind, *args = spec
    return {"ema": Ema, "rsi": Rsi}[kind](*args) if kind in ("ema", "rsi") else Macd(*args, kind)


def run_indicators(series, wanted: dict[str, tuple]) -> DataFrame:
    """The series' rows with one more column per wanted indicator."""
    df = series.df
    ship_package(df.sparkSession)
    keys, value = list(series.keys), series.value
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.repartition(parts, *keys) if keys else df.coalesce(1)).sortWithinPartitions(*keys, *series.order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, states = None, {}
        for frame in frames:
            ids = list(zip(*(frame[k].tolist() for k in keys))) if keys else [()] * len(frame)
            out: dict[str, list] = {name: [] for name in wanted}
            for k, x in zip(ids, frame[value].tolist()):
                if k != key:
                    key, states = k, {name: _state(spec) for name, spec in wanted.items()}
                for name, s in states.items():
                    out[name].append(s.feed(x))
            yield frame.assign(**{n: pd.Series(v, dtype="float64", index=frame.index) for n, v in out.items()})

    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in wanted])
    return dealt.mapInPandas(run, schema)


def _per_series(series, f, fields: str) -> DataFrame:
    """One series at a time as a frame sorted by time; ``fields`` describe what follows the keys."""
    df = series.df.select(*series.keys, *series.order, series.value)
    ship_package(df.sparkSession)
    keys = list(series.keys)
    order = series.order
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [fields])
    if not keys:
        df, keys_ = df.withColumn("_all", F.lit(0)), ["_all"]
    else:
        keys_ = keys

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        out = f(frame)
        for i, k in enumerate(keys):
            out.insert(i, k, frame[k].iloc[0] if len(frame) else None)
        return out

    return df.groupBy(*keys_).applyInPandas(one, schema)


def lttb(series, target: int) -> DataFrame:
    """Largest-triangle-three-buckets (Steinarsson 2013): at most ``target`` of the points."""
    ts, value = series.ts, series.value
    kind = series.df.schema[ts].dataType.simpleString()

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        n = len(frame)
        if n <= target or target < 3:
            return frame[[ts, value]].head(max(target, 0))
        x = frame[ts].astype("int64").to_numpy(dtype=float) if kind.startswith("timestamp") else frame[ts].to_numpy(dtype=float)
        y = frame[value].to_numpy(dtype=float)
        edges = (np.arange(target - 1) * (n - 2) / (target - 2)).astype(int) + 1
        chosen = [0]
        for lo, hi, after in zip(edges[:-1], edges[1:], list(edges[2:]) + [n]):
            mx, my = (x[hi:after].mean(), y[hi:after].mean()) if after > hi else (x[-1], y[-1])
            a = chosen[-1]
            area = np.abs((x[a] - mx) * (y[lo:hi] - y[a]) - (x[a] - x[lo:hi]) * (my - y[a]))
            chosen.append(lo + int(area.argmax()))
        return frame.iloc[chosen + [n - 1]][[ts, value]].reset_index(drop=True)

    return _per_series(series, pick, f"{ts} {kind}, {value} double")


def forecast(series, periods: int, model: str = "LINEAR_REGRESSION", **options) -> DataFrame:
    """(keys, step 1..periods, forecast) by one of the models of ``MODELS``; each series is fitted by itself."""
    fit = MODELS[model.upper()]
    value = series.value

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame[value].dropna().to_numpy(dtype=float)
        ahead = fit(y, periods, **options) if len(y) else np.full(periods, np.nan)
        return pd.DataFrame({"step": np.arange(1, periods + 1), "forecast": ahead})

    return _per_series(series, run, "step long, forecast double")


def _polynomial(y: np.ndarray, periods: int, degree: int = 2) -> np.ndarray:
    """Least squares over the scaled index."""
    n = len(y)
    degree = min(degree, n - 1)
    x = np.arange(n + periods) / max(1, n - 1)
    basis = np.vander(x, degree + 1)
    return basis[n:] @ np.linalg.lstsq(basis[:n], y, rcond=None)[0]


def _linear(y: np.ndarray, periods: int) -> np.ndarray:
    return _polynomial(y, periods, 1)


def _exponential(y: np.ndarray, periods: int, alpha: float | None = None) -> np.ndarray:
    """Simple exponential smoothing; alpha of least one-step error on a grid if none is given."""

    def level(a: float) -> tuple[float, float]:
        e, cost = y[0], 0.0
        for v in y[1:]:
            cost += (v - e) ** 2
            e += a * (v - e)
        return cost, e

    _, last = min(level(a) for a in ([alpha] if alpha else np.arange(0.05, 1.0, 0.05)))
    return np.full(periods, last)


def _holt_winters(y: np.ndarray, periods: int, period: int = 12, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.2) -> np.ndarray:
    """Additive trend and season (only trend if there are fewer than two seasons)."""
    m = period if len(y) >= 2 * period and period > 1 else 1
    trend = (y[m : 2 * m].mean() - y[:m].mean()) / m if len(y) >= 2 * m else 0.0
    middle = np.arange(m) - (m - 1) / 2
    season = y[:m] - y[:m].mean() - trend * middle
    level = y[:m].mean() + trend * middle[-1]
    for i, v in enumerate(y[m:]):
        j = i % m
        old = level
        level = alpha * (v - season[j]) + (1 - alpha) * (level + trend)
        trend = beta * (level - old) + (1 - beta) * trend
        if m > 1:
            season[j] = gamma * (v - level) + (1 - gamma) * season[j]
    n = len(y)
    return np.array([level + (k + 1) * trend + (season[(n + k) % m] if m > 1 else 0.0) for k in range(periods)])


def _arima(y: np.ndarray, periods: int, p: int = 2, d: int = 1) -> np.ndarray:
    """ARIMA(p, d, 0): autoregression with constant on the d-th differences, by least squares."""
    tails, z = [], y.astype(float)
    for _ in range(d):
        if len(z) > 1:
            tails.append(z[-1])
            z = np.diff(z)
    p = max(0, min(p, (len(z) - 1) // 2))
    rows = np.column_stack([np.ones(len(z) - p), *[z[p - k - 1 : len(z) - k - 1] for k in range(p)]])
    coef = np.linalg.lstsq(rows, z[p:], rcond=None)[0]
    past, out = list(z), []
    for _ in range(periods):
        nxt = coef[0] + sum(coef[k + 1] * past[-k - 1] for k in range(p))
        past.append(nxt)
        out.append(nxt)
    ahead = np.array(out)
    for last in reversed(tails):
        ahead = last + np.cumsum(ahead)
    return ahead


def _network(y: np.ndarray, periods: int, lags: int = 6, hidden: int = 8, rounds: int = 400, seed: int = 0) -> np.ndarray:
    """A small feed-forward network on the last ``lags`` values, trained by Adam; line fit for short series."""
    if len(y) < lags + 4:
        return _linear(y, periods)
    mean, dev = y.mean(), y.std() or 1.0
    z = (y - mean) / dev
    x = np.lib.stride_tricks.sliding_window_view(z, lags)[:-1]
    t = z[lags:]
    r = np.random.default_rng(seed)
    w = [r.normal(0, lags**-0.5, (lags, hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for k in range(1, rounds + 1):
        h = np.tanh(x @ w[0] + w[1])
        e = (h @ w[2] + w[3] - t) / len(t)
        back = np.outer(e, w[2]) * (1 - h * h)
        for i, g in enumerate([x.T @ back, back.sum(0), h.T @ e, np.array([e.sum()])]):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - 0.02 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    past, out = list(z[-lags:]), []
    for _ in range(periods):
        nxt = float((np.tanh(np.array(past[-lags:]) @ w[0] + w[1]) @ w[2] + w[3])[0])
        past.append(nxt)
        out.append(nxt)
    return np.array(out) * dev + mean


MODELS = {
    "LINEAR_REGRESSION": _linear,
    "POLYNOMIAL_REGRESSION": _polynomial,
    "EXPONENTIAL_SMOOTHING": _exponential,
    "HOLT_WINTERS": _holt_winters,
    "ARIMA": _arima,
    "NEURAL_NETWORK": _network,
}


def pelt(y: np.ndarray, penalty: float = 1.0, least: int = 2) -> list[int]:
    """Starts of the segments after the first, by exact optimal partitioning with pruning (Killick 2012).

    The cost of a segment is its squared deviation from its mean, scaled by the variance of the whole series.
    """
    n = len(y)
    scale = (y.var() if n and y.min() < y.max() else 0.0) or 1.0  # rounding leaves equal values a variance
    s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        return (q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)) / scale

    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    alive = np.array([0])
    until = np.full(n + 1, n + 1)  # the end from which on a start is out
    for b in range(least, n + 1):
        ok = alive[until[alive] > b]
        total = best[ok] + cost(ok, b) + penalty
        k = int(total.argmin())
        best[b], last[b] = total[k], ok[k]
        # A start that lost at b loses to a cut at b once a segment fits behind b, not before.  The margin keeps ties.
        lost = ok[total - penalty > best[b] + 1e-9 * (1.0 + abs(best[b]))]
        until[lost] = np.minimum(until[lost], b + least)
        alive = ok if b - least + 1 < least else np.append(ok, b - least + 1)
    cuts, b = [], n
    while b > 0:
        b = int(last[b])
        if b > 0:
            cuts.append(b)
    return cuts[::-1]


def changepoints(series, penalty: float = 1.0) -> DataFrame:
    """(keys, index): 0-based places at which a new segment starts."""
    value = series.value

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame[value].to_numpy(dtype=float)
        return pd.DataFrame({"index": np.array(pelt(y, penalty) if len(y) else [], dtype="int64")})

    return _per_series(series, run, "index long")


def isolation_scores(y: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Anomaly scores in (0, 1) of an isolation forest (Liu 2008) fitted on samples of at most ``sample`` values."""
    r = np.random.default_rng(seed)
    sample = min(sample, len(y))
    limit = int(np.ceil(np.log2(max(2, sample))))

    def usual(n: float) -> float:
        return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n

    depth = np.zeros(len(y))
    for _ in range(trees):
        todo = [(y[r.choice(len(y), sample, replace=False)], np.arange(len(y)), 0)]
        while todo:
            part, rows, d = todo.pop()
            if d >= limit or len(part) < 2 or part.min() == part.max():
                depth[rows] += d + usual(len(part))
                continue
            cut = r.uniform(part.min(), part.max())
            low = y[rows] < cut
            todo += [(part[part < cut], rows[low], d + 1), (part[part >= cut], rows[~low], d + 1)]
    return 2.0 ** (-depth / trees / max(1e-9, usual(sample)))


def outliers_isolation_forest(series, threshold: float = 0.65, seed: int = 42) -> DataFrame:
    """(keys, index, score) of the points whose score passes ``threshold``."""
    value = series.value

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame[value].fillna(frame[value].median()).to_numpy(dtype=float)
        scores = isolation_scores(y, seed=seed) if len(y) > 1 else np.zeros(len(y))
        at = np.flatnonzero(scores > threshold)
        return pd.DataFrame({"index": at.astype("int64"), "score": scores[at]})

    return _per_series(series, run, "index long, score double")


#: Engle-Granger critical values for two series (MacKinnon 1991), asymptotic.
CRITICAL = {0.01: -3.90, 0.05: -3.34, 0.10: -3.05}


def cointegrated(x: np.ndarray, y: np.ndarray, significance: float = 0.05) -> tuple[bool, float]:
    """Engle-Granger: regress y on x, Dickey-Fuller statistic of the residuals against CRITICAL."""
    basis = np.column_stack([np.ones(len(x)), x])
    e = y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]
    d, lagged = np.diff(e), e[:-1]
    rho = (lagged @ d) / (lagged @ lagged)
    rest = d - rho * lagged
    error = np.sqrt((rest @ rest) / max(1, len(d) - 1) / (lagged @ lagged))
    t = rho / error if error > 0 else -np.inf
    return bool(t < CRITICAL[significance]), float(t)


def is_cointegrated(a, b, significance: float = 0.05) -> DataFrame:
    """One row (cointegrated, statistic) over the common times of two series: ``cointegrated`` in sums, for any length."""
    from .batch import numbered
    from .series import align

    both = align([a, b], "inner", ["x", "y"]).select("ts", "x", "y")
    line = both.agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"))
    rest = numbered(both, ["ts"]).join(F.broadcast(line)).select("pos", (F.col("y") - F.col("b") - F.col("a") * F.col("x")).alias("e"))  # one row
    last = rest.select((F.col("pos") + 1).alias("pos"), F.col("e").alias("l"))
    d = F.col("e") - F.col("l")
    sums = rest.join(last, "pos").agg(F.sum(F.col("l") * d).alias("ld"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(d * d).alias("dd"), F.count(F.lit(1)).alias("n"))
    rho = F.col("ld") / F.col("ll")
    error = F.sqrt((F.col("dd") - rho * F.col("ld")) / F.greatest(F.lit(1), F.col("n") - 1) / F.col("ll"))
    t = F.when(error > 0, rho / error).otherwise(F.lit(float("-inf")))
    return sums.select((t < CRITICAL[significance]).alias("cointegrated"), t.alias("statistic"))
