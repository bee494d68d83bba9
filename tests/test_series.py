import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries.operators import batch, codecs, sequential, series
from sparkseries.operators.series import MetricStore, Series
from sparkseries.operators.tscodecs import compress_series, decompress_series

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tiny(spark):
    """Ten points of one series on a minute grid with a gap, a null and an outlier; another one of three points."""
    values = [1.0, 2.0, None, 4.0, 5.0, 6.0, 100.0, 8.0, 9.0, 10.0]
    minutes = [0, 1, 2, 3, 4, 5, 6, 9, 10, 11]
    rows = [("a", T0 + dt.timedelta(minutes=m), v) for m, v in zip(minutes, values)] + [("b", T0 + dt.timedelta(minutes=m), 3.0) for m in range(3)]
    return Series(spark.createDataFrame(rows, "sid string, ts timestamp_ntz, v double"), ("sid",), "ts", "v")


def col(s, name, sid="a"):
    df = s.df if isinstance(s, Series) else s
    return [r[name] for r in df.filter(F.col("sid") == sid).orderBy("ts").collect()]


def test_gaps(tiny):
    assert col(tiny.fill_forward(), "filled")[2] == 2.0 and col(tiny.fill_backward(), "filled")[2] == 4.0 and col(tiny.fill_interpolate(), "filled")[2] == 3.0 and col(tiny.fill_missing(0.0), "filled")[2] == 0.0
    lone = Series(tiny.df.filter("v is null or ts < '2023-01-01'"), ("sid",), "ts", "v")
    assert col(lone.fill_interpolate(), "filled") == [None]


def test_moving_and_offsets(tiny):
    assert col(tiny.moving("mean", 3), "moving_mean")[:2] == [None, None] and col(tiny.moving("sum", 2), "moving_sum", "b") == [None, 6.0, 6.0]
    assert col(tiny.shift(-1), "shifted", "b") == [3.0, 3.0, None] and col(tiny.pct_change(), "pct_change", "b") == [None, 0.0, 0.0]
    assert [r["index"] for r in tiny.outliers_iqr().collect()] == [6] and [r.v for r in tiny.outliers_zscore(2.0).collect()] == [100.0]
    assert tiny.latest(2).df.count() == 4 and tiny.resample("5 minutes", "COUNT", fill=True).count() == 4


def test_indicators(tiny):
    e, want = None, []
    for v in [1.0, 2.0, None, 4.0, 5.0, 6.0, 100.0, 8.0, 9.0, 10.0]:
        e = e if v is None else v if e is None else 0.5 * v + 0.5 * e
        want.append(e)
    assert col(tiny.ema(3), "ema") == pytest.approx(want)
    rsi = col(tiny.rsi(3), "rsi", "b")
    assert rsi == [None, None, None] or all(x is None or math.isnan(x) or x == 100.0 for x in rsi)
    assert col(tiny.macd(), "histogram", "b") == pytest.approx([0.0] * 3)


def test_downsampling(spark):
    rows = [("a", T0 + dt.timedelta(minutes=i), math.sin(i / 5) + (10 if i == 60 else 0)) for i in range(200)]
    s = Series(spark.createDataFrame(rows, "sid string, ts timestamp_ntz, v double"), ("sid",), "ts", "v")
    picked = s.downsample(20, "LTTB").orderBy("ts").collect()
    assert len(picked) == 20 and picked[0].ts == T0 and picked[-1].ts == T0 + dt.timedelta(minutes=199) and max(r.v for r in picked) > 9
    for how in ("AVERAGE", "MIN_MAX", "FIRST_LAST", "M4", "M4_PAPER", "RANDOM"):
        assert s.downsample(20, how).count() == 20
    d = s.decompose(8).df.filter("trend is not null").collect()
    assert len(d) == 192 and all(abs(r.trend + r.seasonal + r.residual - r.v) < 1e-9 for r in d)


def test_forecasts():
    line = np.arange(40.0) * 2 + 1
    for model in ("LINEAR_REGRESSION", "POLYNOMIAL_REGRESSION", "ARIMA", "HOLT_WINTERS"):
        assert sequential.MODELS[model](line, 3) == pytest.approx([81, 83, 85], abs=0.5), model
    assert sequential.MODELS["EXPONENTIAL_SMOOTHING"](np.full(9, 4.0), 2) == pytest.approx([4, 4])
    wave = np.tile([1.0, 5.0, 3.0], 12)
    assert sequential.MODELS["HOLT_WINTERS"](wave, 3, period=3) == pytest.approx([1, 5, 3], abs=0.3)
    assert sequential.MODELS["NEURAL_NETWORK"](wave, 3) == pytest.approx([1, 5, 3], abs=0.6)


def test_pct_change_over_zero_and_halves(spark, tmp_path):
    import duckdb

    from sparkseries.queries import ORACLES, QUERIES

    values = [2.0, 0.0, 0.0, 5.0, 0.0, -1.0, None, 0.0, -0.0, 3.0]
    values += [x / 100 for i in range(3000) for x in (64 * (1 + i % 50), 577 + i)]  # many halves at the seventh place
    rows = [(i, T0 + dt.timedelta(seconds=i), 1, v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(ORACLES["ts_pct_change"]).fetchall())
    got = {r.event_id: r.v for r in QUERIES["ts_pct_change"](spark, str(tmp_path)).collect()}
    assert [repr(got[i]) for i in range(10)] == ["None", "-1.0", "nan", "inf", "-1.0", "-inf", "None", "None", "nan", "-inf"]
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}


def test_changepoints_equal_exhaustive_search():
    import itertools

    r = np.random.default_rng(0)
    for _ in range(15):
        y = np.concatenate([r.normal(m, 1, r.integers(2, 6)) for m in r.choice([0, 4, 9], 3)])
        scale = y.var()
        cost = lambda a, b: ((y[a:b] - y[a:b].mean()) ** 2).sum() / scale
        n = len(y)
        best = min(
            (sum(cost(a, b) for a, b in zip((0, *c), (*c, n))) + 0.7 * len(c), c)
            for k in range(4) for c in itertools.combinations(range(2, n - 1), k) if all(b - a >= 2 for a, b in zip((0, *c), (*c, n)))
        )
        got = sequential.pelt(y, 0.7)
        assert sum(cost(a, b) for a, b in zip((0, *got), (*got, n))) + 0.7 * len(got) <= best[0] + 1e-9


def test_changepoints_equal_unpruned_search():
    """Short segments are not allowed, so a start that lost may still win one day later."""

    def unpruned(y, penalty):
        n, scale = len(y), y.var() if y.min() < y.max() else 1.0
        s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
        best, last = [-penalty, np.inf], [0, 0]
        for b in range(2, n + 1):
            c = [best[a] + (q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)) / scale + penalty for a in range(b - 1)]
            best.append(min(c))
            last.append(int(np.argmin(c)))
        cuts, b = [], n
        while last[b] > 0:
            b = last[b]
            cuts.append(b)
        return cuts[::-1]

    r = np.random.default_rng(1)
    for n in (2, 3, 5, 30, 60):
        for _ in range(60):
            y = r.exponential(40, n)
            assert sequential.pelt(y, 0.7) == unpruned(y, 0.7)
    assert sequential.pelt(np.full(30, 0.1), 5.0) == [] and sequential.pelt(np.full(11, 3.3), 5.0) == []


def test_models_on_frames(spark):
    r = random.Random(0)
    rows = [("a", i, 5.0 if i < 30 else 50.0) for i in range(60)] + [("b", i, r.gauss(0, 1) + (40 if i == 7 else 0)) for i in range(200)]
    s = Series(spark.createDataFrame(rows, "sid string, ts long, v double"), ("sid",), "ts", "v")
    assert [(x.sid, x["index"]) for x in sequential.changepoints(s, 3.0).filter("sid = 'a'").collect()] == [("a", 30)]
    assert 7 in [x["index"] for x in sequential.outliers_isolation_forest(s).filter("sid = 'b'").collect()]
    assert sequential.forecast(s, 4, "ARIMA").count() == 8
    walk = np.cumsum(np.random.default_rng(1).normal(size=400))
    noise = np.random.default_rng(2).normal(size=400)
    assert sequential.cointegrated(walk, 2 * walk + noise)[0]
    others = [np.cumsum(np.random.default_rng(k).normal(size=400)) for k in range(20, 40)]
    assert sum(sequential.cointegrated(walk, o, 0.01)[0] for o in others) <= 3


def test_as_of_and_ranges(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5), (1, 4)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 15, "y"), (2, 9, "z"), (1, 20, "w")], "k int, t int, v string")
    back = {(r.k, r.t): r.asof_v for r in series.as_of(left, right, by=["k"], on="t", value="v").collect()}
    ahead = {(r.k, r.t): r.asof_v for r in series.as_of(left, right, by=["k"], on="t", value="v", direction="forward").collect()}
    assert back == {(1, 10): "x", (1, 20): "w", (2, 5): None, (1, 4): None} and ahead == {(1, 10): "y", (1, 20): "w", (2, 5): "z", (1, 4): "x"}
    p = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    spans = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.5, 4.5), (3, -3.0, 100.0)], "id int, lo double, hi double")
    for width in (1.0, 7.0, 1000.0):
        got = {(r.x, r.id) for r in series.range_join(p, spans, at="x", start="lo", end="hi", width=width).collect()}
        assert got == {(float(i), s) for i in range(20) for s, a, b in ((1, 2, 5), (3, -3, 100)) if a <= i < b}


def test_codecs(spark):
    df = spark.createDataFrame(list(enumerate([5, 5, 5, 7, 7, 5])), "pos long, x long")
    at = lambda d, c: [r[c] for r in d.orderBy("pos").collect()]
    assert at(codecs.delta_encode(df, "x", "pos"), "delta") == [5, 0, 0, 2, 0, -2]
    runs = codecs.rle_encode(df, "x", "pos")
    assert [(r.x, r.length) for r in runs.orderBy("run").collect()] == [(5, 3), (7, 2), (5, 1)] and at(codecs.rle_decode(runs, "x"), "x") == [5, 5, 5, 7, 7, 5]
    assert at(codecs.dictionary_encode(df, "x", "pos")[0], "code") == [0, 0, 0, 1, 1, 0]
    nulls = spark.createDataFrame([(0, None), (1, None), (2, 1)], "pos long, x long")
    assert [r.length for r in codecs.rle_encode(nulls, "x", "pos").orderBy("run").collect()] == [2, 1] and at(codecs.dictionary_encode(nulls, "x", "pos")[0], "code") == [0, 0, 1]


def test_block_codecs(tiny):
    s = tiny.with_df(tiny.df.filter("v is not null"))
    for algorithm in ("GORILLA", "SIMPLE8B"):
        back = decompress_series(compress_series(s, algorithm, "5 minutes"), ("sid",), algorithm)
        assert sorted((r.sid, r.ts, r.value) for r in back.collect()) == sorted((r.sid, r.ts, r.v) for r in s.df.collect())


def test_windows(spark):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m)) for i, m in enumerate([0, 1, 2, 40, 41, 100, 101])], "i int, ts timestamp_ntz")
    got = {}
    for r in batch.sliding_count(df, 3, 2, ["i"]).collect():
        got.setdefault(r.window_id, []).append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 1, 2], 1: [2, 3, 4], 2: [4, 5, 6]}
    assert sorted(r.window_id for r in batch.tumbling_count(df, 3, ["i"]).collect()) == [0, 0, 0, 1, 1, 1, 2]
    assert sorted(r.n for r in batch.session(df, "ts", "30 minutes", (), F.count(F.lit(1)).alias("n")).collect()) == [2, 2, 3]
    assert batch.sliding_count(df.limit(2), 3, 1, ["i"]).count() == 0


def test_errors_and_pipelines(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "x int")
    out = batch.map_rows(df, lambda r: 10 / r["x"], "double")
    assert {r.x: (r.result, r.error) for r in out.collect()}[0] == (None, "ZeroDivisionError: division by zero")
    assert tuple(batch.batch_statistics(out).first()) == (5, 4, 1)
    p = batch.Pipeline().add("odd", lambda d: d.filter("x % 2 = 1")).add("twice", lambda d: d.withColumn("y", F.col("x") * 2))
    res, seen = p.process_observed(df)
    assert sorted(r.y for r in res.collect()) == [2, 6] and seen["odd"].get["rows"] == 2


def test_metric_store(spark, tmp_path):
    store = MetricStore(spark, str(tmp_path / "m"))
    for metric, n in (("cpu", 10), ("mem", 4)):
        store.write(metric, spark.createDataFrame([(T0 + dt.timedelta(hours=i), float(i), {"host": "ab"[i % 2]}) for i in range(n)], "ts timestamp_ntz, value double, tags map<string,string>"))
    assert store.query("cpu").count() == 10 and store.query("cpu", tags={"host": "a"}).count() == 5 and store.query("mem", start=T0 + dt.timedelta(hours=2)).count() == 2
    assert sorted(r.value for r in store.query_aggregate("cpu", None, None, "5 hours", "MAX").collect()) == [4.0, 9.0] or store.query_aggregate("cpu", None, None, "5 hours", "MAX").count() == 3
    assert store.retain("cpu", 3).count() == 4
    plan = store.query("cpu")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan


def test_streams_equal_batches(spark, tmp_path):
    from sparkseries.streaming import stateful

    rows = [(i % 3, T0 + dt.timedelta(minutes=i), float(i % 7) + (90 if i == 50 else 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v double")
    for part in range(3):  # files that arrive in order
        df.filter((F.minute("ts") + 60 * F.hour("ts")).between(part * 20, part * 20 + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out: list = []
    q = stateful.ring_buffer(stream, "k", "ts", "v", 10).writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(out) == 60 and [r.value for r in out if r.is_anomaly] == [91.0]


def test_ring_buffer_orders_a_key_over_all_frames(spark, tmp_path):
    from sparkseries.streaming import stateful

    n = 25_000  # more than one Arrow batch, and the last comes first
    df = spark.range(n - 1, -1, -1, 1).select(F.lit(1).alias("k"), (F.lit(T0) + F.make_dt_interval(secs=F.floor(F.col("id") / 2))).cast("timestamp_ntz").alias("ts"), (F.col("id") % 1009 * (F.col("id") % 7)).cast("double").alias("v"), "id")
    flat = spark.createDataFrame([(2, T0 + dt.timedelta(minutes=i), v, i) for i, v in enumerate([0.1] * 7 + [5.0])], df.schema)
    df.union(flat).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out: list = []
    q = stateful.ring_buffer(stream, "k", "ts", "v", 16, 1.5, "id").writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    v = [float(i % 1009 * (i % 7)) for i in range(n)]
    odd = [False] * 2
    for i in range(2, n):
        b = np.array(v[max(0, i - 16) : i])
        odd.append(bool(b.std(ddof=1) > 0 and abs(v[i] - b.mean()) / b.std(ddof=1) > 1.5))
    got = [r for r in out if r.k == 1]
    assert [r.value for r in got] == v and [r.is_anomaly for r in got] == odd
    assert [r.is_anomaly for r in out if r.k == 2] == [False] * 8  # equal values do not deviate
