"""Time-series queries over ``events`` (and daily ``orders``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequential, series
from ..operators.series import Series
from ..plans.catalog import ORACLES, query, table

STAMP = "yyyy-MM-dd HH:mm:ss"


def r(c, alias: str | None = None, places: int = 6):
    c = F.round(F.col(c) if isinstance(c, str) else c, places)
    return c.alias(alias) if alias else c


def binary_round(c: str, alias: str, places: int = 6):
    """Rounded as DuckDB does: the product with a power of ten, not the shortest decimal form, decides on halves."""
    scaled = F.col(c) * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**places).otherwise(F.col(c)).alias(alias)


def stamp(c, alias: str):
    return F.date_format(c, STAMP).alias(alias)


def sql_stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def events(spark, sf):
    return table(spark, sf, "events")


def by_user(spark, sf) -> Series:
    return Series(events(spark, sf), ("user_id",), "ts", "value", "event_id")


def gappy(spark, sf) -> Series:
    """Every seventh value is missing."""
    df = events(spark, sf).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return Series(df, ("user_id",), "ts", "value", "event_id")


def hourly(spark, sf, kind: str) -> Series:
    one = Series(events(spark, sf).filter(F.col("event_type") == kind), (), "ts", "value", "event_id")
    return Series(one.resample("1 hour", "MEAN").withColumnRenamed("bucket", "ts"), (), "ts", "value")


W = "PARTITION BY user_id ORDER BY ts, event_id"
GAPPY = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
HOURLY = "(SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(value) AS value FROM events WHERE event_type = '{0}' GROUP BY 1)"


@query(f"SELECT {sql_stamp('time_bucket(INTERVAL 1 HOUR, ts)')} AS bucket, round(avg(value), 6) AS value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def ts_query_aggregate(spark, sf):
    s = Series(events(spark, sf), ("event_type",)).with_tags({"event_type": "click"}).range("2024-01-02", "2024-01-20")
    return s.resample("1 hour", "MEAN").select(stamp("bucket", "bucket"), r("value", "value"))


@query("SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06'")
def ts_query_range(spark, sf):
    return by_user(spark, sf).range("2024-01-05", "2024-01-06").df.select("event_id", "user_id", "value")


@query("SELECT event_id, value FROM events WHERE ts = (SELECT max(ts) FROM events)")
def ts_at_time(spark, sf):
    s = by_user(spark, sf)
    return s.at_time(s.df.agg(F.max("ts")).first()[0]).df.select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' AND user_id = 7")
def ts_query_tag_filter(spark, sf):
    return by_user(spark, sf).with_tags({"event_type": "purchase", "user_id": 7}).df.select("event_id", "value")


@query(
    "SELECT event_type, round(avg(value), 6) AS mean, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, count(value) AS count, round(median(value), 6) AS median, "
    "round(stddev_samp(value), 6) AS stddev, round(var_samp(value), 4) AS variance, arg_min(value, ts) AS first, arg_max(value, ts) AS last, round(quantile_cont(value, 0.95), 6) AS percentile FROM events GROUP BY event_type"
)
def ts_aggregate_all(spark, sf):
    out = Series(events(spark, sf), ("event_type",)).aggregate(series.AGGREGATES)
    places = {"mean": 6, "sum": 4, "median": 6, "stddev": 6, "variance": 4, "percentile": 6}
    return out.select("event_type", *[r(c, c, places[c]) if c in places else F.col(c) for c in out.columns[1:]])


@query(f"SELECT event_type, {sql_stamp('time_bucket(INTERVAL 1 HOUR, ts)')} AS bucket, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def ts_resample_hourly(spark, sf):
    return Series(events(spark, sf), ("event_type",)).resample("1 hour", "SUM").select("event_type", stamp("bucket", "bucket"), r("value", "value"))


@query(f"SELECT event_type, {sql_stamp('date_trunc($$day$$, ts)')} AS bucket, max(value) AS value FROM events GROUP BY 1, 2".replace("$$", "'"))
def ts_query_aggregate_daily(spark, sf):
    return Series(events(spark, sf), ("event_type",)).resample("1 day", "MAX").select("event_type", stamp("bucket", "bucket"), "value")


@query(
    f"""WITH b AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2),
    g AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 6 HOUR)) AS bucket FROM b GROUP BY 1)
    SELECT g.user_id, {sql_stamp('g.bucket')} AS bucket, b.n AS value FROM g LEFT JOIN b ON g.user_id = b.user_id AND g.bucket = b.bucket"""
)
def ts_resample_dense(spark, sf):
    return by_user(spark, sf).resample("6 hours", "COUNT", fill=True).select("user_id", stamp("bucket", "bucket"), "value")


def _moving(func: str, sql: str):
    frame = f"OVER ({W} ROWS 4 PRECEDING)"

    @query(f"SELECT event_id, CASE WHEN count(*) {frame} = 5 THEN round({sql}(value) {frame}, 6) END AS v FROM events", name=f"ts_moving_{func}_5")
    def run(spark, sf):
        return by_user(spark, sf).moving(func, 5, "m").df.select("event_id", r("m", "v"))

    return run


for _f, _s in {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "stddev": "stddev_samp"}.items():
    _moving(_f, _s)


@query(f"SELECT event_id, round(value - lag(value, 2) OVER ({W}), 6) AS v FROM events")
def ts_diff(spark, sf):
    return by_user(spark, sf).diff(2).df.select("event_id", r("diff", "v"))


@query(f"SELECT event_id, round((value - lag(value) OVER ({W})) / lag(value) OVER ({W}), 6) AS v FROM events")
def ts_pct_change(spark, sf):
    return by_user(spark, sf).pct_change().df.select("event_id", binary_round("pct_change", "v"))


@query(f"SELECT event_id, round(sum(value) OVER ({W} ROWS UNBOUNDED PRECEDING), 4) AS v FROM events")
def ts_cumsum(spark, sf):
    return by_user(spark, sf).cumsum().df.select("event_id", r("cumsum", "v", 4))


@query(f"SELECT event_id, lag(value, 3) OVER ({W}) AS back, lead(value, 1) OVER ({W}) AS ahead FROM events")
def ts_shift(spark, sf):
    return by_user(spark, sf).shift(3, "back").shift(-1, "ahead").df.select("event_id", "back", "ahead")


@query(f"SELECT event_id, coalesce(value, -1.0::DOUBLE) AS v FROM {GAPPY}")
def ts_fill_const(spark, sf):
    return gappy(spark, sf).fill_missing(-1.0).df.select("event_id", F.col("filled").alias("v"))


@query(f"SELECT event_id, last_value(value IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS v FROM {GAPPY}")
def ts_fill_forward(spark, sf):
    return gappy(spark, sf).fill_forward().df.select("event_id", F.col("filled").alias("v"))


@query(f"SELECT event_id, first_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {GAPPY}")
def ts_fill_backward(spark, sf):
    return gappy(spark, sf).fill_backward().df.select("event_id", F.col("filled").alias("v"))


@query(
    f"""WITH n AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS v0, first_value(value IGNORE NULLS) OVER f AS v1,
    last_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER p AS t0, first_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER f AS t1
    FROM {GAPPY} WINDOW p AS ({W} ROWS UNBOUNDED PRECEDING), f AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(value, v0 + (v1 - v0) * ((epoch_us(ts) - t0)::DOUBLE / (t1 - t0)::DOUBLE)), 6) AS v FROM n"""
)
def ts_fill_interpolate(spark, sf):
    return gappy(spark, sf).fill_interpolate().df.select("event_id", r("filled", "v"))


@query(
    """WITH q AS (SELECT user_id, TIMESTAMP '2024-01-15' AS ts FROM (SELECT DISTINCT user_id FROM events)),
    p AS (SELECT q.user_id, arg_max(e.value, e.ts) AS v0, max(epoch_us(e.ts)) AS t0 FROM q JOIN events e ON e.user_id = q.user_id AND e.ts <= q.ts GROUP BY 1),
    n AS (SELECT q.user_id, arg_min(e.value, e.ts) AS v1, min(epoch_us(e.ts)) AS t1 FROM q JOIN events e ON e.user_id = q.user_id AND e.ts >= q.ts GROUP BY 1)
    SELECT q.user_id, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * ((epoch_us(q.ts) - t0)::DOUBLE / (t1 - t0)::DOUBLE) END, 6) AS v FROM q LEFT JOIN p USING (user_id) LEFT JOIN n USING (user_id)"""
)
def ts_interpolate_at(spark, sf):
    s = by_user(spark, sf)
    points = s.df.select("user_id").distinct().withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    return s.interpolate_at(points).select("user_id", r("value", "v"))


@query(
    """WITH z AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type) AS z, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS index FROM events)
    SELECT event_type, event_id, index FROM z WHERE z > 1.7"""
)
def ts_outliers_zscore(spark, sf):
    return Series(events(spark, sf), ("event_type",), id="event_id").outliers_zscore(1.7).select("event_type", "event_id", "index")


@query(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1), e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS index FROM events)
    SELECT e.event_type, event_id, index FROM e JOIN q USING (event_type) WHERE value < a - 0.4 * (b - a) OR value > b + 0.4 * (b - a)"""
)
def ts_outliers_iqr(spark, sf):
    return Series(events(spark, sf), ("event_type",), id="event_id").outliers_iqr(0.4).select("event_type", "event_id", "index")


@query()
def ts_outliers_isolation_forest(spark, sf):
    return sequential.outliers_isolation_forest(Series(events(spark, sf), ("event_type",), id="event_id")).select("event_type", "index", r("score", "score"))


@query(
    f"""WITH d AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), l AS (SELECT *, lag(d) OVER ({W}) AS e FROM d)
    SELECT user_id, round(sum(d * e) / sum(d * d), 6) AS v FROM l GROUP BY user_id"""
)
def ts_autocorr_lag1(spark, sf):
    return by_user(spark, sf).autocorrelation(1).select("user_id", r("autocorrelation", "v"))


@query(f"SELECT round(corr(a.value, b.value), 6) AS v FROM {HOURLY.format('click')} a JOIN {HOURLY.format('view')} b USING (ts)")
def ts_correlation_two_types(spark, sf):
    return series.correlation(hourly(spark, sf, "click"), hourly(spark, sf, "view")).select(r("correlation", "v"))


@query(f"WITH j AS (SELECT ts, a.value AS x, lead(b.value, 2) OVER (ORDER BY ts) AS y FROM {HOURLY.format('click')} a JOIN {HOURLY.format('view')} b USING (ts)) SELECT round(corr(x, y), 6) AS v FROM j")
def ts_cross_correlation_lag2(spark, sf):
    return series.correlation(hourly(spark, sf, "click"), hourly(spark, sf, "view"), lag=2).select(r("correlation", "v"))


@query(f"SELECT {sql_stamp('ts')} AS ts, round(a.value, 6) AS click, round(b.value, 6) AS view, round(c.value, 6) AS error FROM {HOURLY.format('click')} a FULL JOIN {HOURLY.format('view')} b USING (ts) FULL JOIN {HOURLY.format('error')} c USING (ts)")
def ts_align_outer(spark, sf):
    out = series.align([hourly(spark, sf, k) for k in ("click", "view", "error")], "outer", ["click", "view", "error"])
    return out.select(stamp("ts", "ts"), *[r(c, c) for c in ("click", "view", "error")])


@query(f"SELECT {sql_stamp('ts')} AS ts, round(sum(value), 6) AS value FROM (SELECT * FROM {HOURLY.format('click')} UNION ALL SELECT * FROM {HOURLY.format('view')}) GROUP BY ts")
def ts_merge_sum(spark, sf):
    return series.merge([hourly(spark, sf, k) for k in ("click", "view")], "SUM").select(stamp("ts", "ts"), r("value", "value"))


@query(f"SELECT event_id, CASE WHEN count(*) OVER ({W} ROWS 9 PRECEDING) = 10 THEN round(avg(value) OVER ({W} ROWS 9 PRECEDING), 6) END AS v FROM events")
def ts_sma(spark, sf):
    return by_user(spark, sf).moving("mean", 10, "m").df.select("event_id", r("m", "v"))


_NUMBERED = f"n AS (SELECT event_id, user_id, value, row_number() OVER ({W}) AS i FROM events)"


def _ema_sql(period: int, source: str = "n", value: str = "value", name: str = "e") -> str:
    a = f"(2.0::DOUBLE / {period + 1})"
    return f"{name} AS (SELECT user_id, event_id, i, {value} AS v FROM {source} WHERE i = 1 UNION ALL SELECT n2.user_id, n2.event_id, n2.i, {a} * n2.{value} + (1 - {a}) * {name}.v FROM {name} JOIN {source} n2 ON n2.user_id = {name}.user_id AND n2.i = {name}.i + 1)"


@query(f"WITH RECURSIVE {_NUMBERED}, {_ema_sql(10)} SELECT event_id, round(v, 6) AS v FROM e")
def ts_ema(spark, sf):
    return by_user(spark, sf).ema(10).select("event_id", r("ema", "v"))


@query(
    f"""SELECT event_id, CASE WHEN c = 20 THEN round(m, 6) END AS middle, CASE WHEN c = 20 THEN round(m + 2 * d, 6) END AS upper, CASE WHEN c = 20 THEN round(m - 2 * d, 6) END AS lower
    FROM (SELECT event_id, count(*) OVER w AS c, avg(value) OVER w AS m, stddev_pop(value) OVER w AS d FROM events WINDOW w AS ({W} ROWS 19 PRECEDING))"""
)
def ts_bollinger(spark, sf):
    return by_user(spark, sf).bollinger(20).df.select("event_id", r("middle", "middle"), r("upper", "upper"), r("lower", "lower"))


@query(
    f"""WITH RECURSIVE {_NUMBERED}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY i) AS d FROM n),
    s AS (SELECT user_id, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM d WHERE i BETWEEN 2 AND 15 GROUP BY user_id HAVING count(*) = 14),
    f AS (SELECT d.user_id, d.event_id, d.i, s.g, s.l FROM d JOIN s USING (user_id) WHERE i = 15
      UNION ALL SELECT d.user_id, d.event_id, d.i, f.g + (greatest(d.d, 0) - f.g) / 14, f.l + (greatest(-d.d, 0) - f.l) / 14 FROM f JOIN d ON d.user_id = f.user_id AND d.i = f.i + 1)
    SELECT n.event_id, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS v FROM n LEFT JOIN f USING (event_id)"""
)
def ts_rsi(spark, sf):
    return by_user(spark, sf).rsi(14).select("event_id", r("rsi", "v"))


@query(
    f"""WITH RECURSIVE {_NUMBERED}, {_ema_sql(12, name='f')}, {_ema_sql(26, name='s')}, m AS (SELECT f.user_id, f.event_id, f.i, f.v - s.v AS line FROM f JOIN s USING (event_id)), {_ema_sql(9, 'm', 'line', 'g')}
    SELECT m.event_id, round(line, 6) AS macd, round(g.v, 6) AS signal, round(line - g.v, 6) AS histogram FROM m JOIN g USING (event_id)"""
)
def ts_macd(spark, sf):
    return by_user(spark, sf).macd().select("event_id", r("macd", "macd"), r("signal", "signal"), r("histogram", "histogram"))


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3")
def ts_latest(spark, sf):
    return by_user(spark, sf).latest(3).df.select("event_id", "user_id")


@query(f"SELECT event_id, round(avg(value) OVER w, 6) AS current_mean, round(stddev_samp(value) OVER w, 6) AS current_stddev, min(value) OVER w AS current_min, max(value) OVER w AS current_max FROM events WINDOW w AS ({W} ROWS 15 PRECEDING)")
def ts_buffer_stats(spark, sf):
    return by_user(spark, sf).buffer_stats(16).df.select("event_id", r("current_mean", "current_mean"), r("current_stddev", "current_stddev"), "current_min", "current_max")


@query(f"SELECT event_id, coalesce(abs(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) > 1.5, false) AS is_anomaly FROM events WINDOW w AS ({W} ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)")
def ts_is_anomaly(spark, sf):
    return by_user(spark, sf).anomalies(16, 1.5).df.select("event_id", "is_anomaly")


_TILES = f"(SELECT *, ntile(10) OVER ({W}) AS tile FROM events)"


@query(f"SELECT user_id, tile::INTEGER AS tile, {sql_stamp('min(ts)')} AS ts, round(avg(value), 6) AS value FROM {_TILES} GROUP BY 1, 2")
def ts_downsample_average(spark, sf):
    return by_user(spark, sf).downsample(10, "AVERAGE").select("user_id", "tile", stamp("ts", "ts"), r("value", "value"))


@query(f"SELECT user_id, tile::INTEGER AS tile, min(value) AS min, max(value) AS max FROM {_TILES} GROUP BY 1, 2")
def ts_downsample_min_max(spark, sf):
    return by_user(spark, sf).downsample(10, "MIN_MAX").select("user_id", "tile", "min", "max")


@query(f"SELECT user_id, tile::INTEGER AS tile, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM {_TILES} GROUP BY 1, 2")
def ts_downsample_first_last(spark, sf):
    return by_user(spark, sf).downsample(10, "FIRST_LAST").select("user_id", "tile", "first", "last")


@query(f"SELECT user_id, tile::INTEGER AS tile, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM {_TILES} GROUP BY 1, 2")
def ts_downsample_m4(spark, sf):
    return by_user(spark, sf).downsample(10, "M4").select("user_id", "tile", "min", "max", r("mean", "mean"), r("median", "median"))


#: The next chosen point is that of the largest triangle with the last one and the next bucket's mean.
@query(
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT user_id, ts, value AS y, epoch_us(ts)::DOUBLE AS x, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    b AS (SELECT user_id, n, j, j * (n - 2) // 10 + 1 AS lo, (j + 1) * (n - 2) // 10 + 1 AS hi, CASE WHEN j = 9 THEN n ELSE (j + 2) * (n - 2) // 10 + 1 END AS after_ FROM (SELECT DISTINCT user_id, n FROM p WHERE n > 12), (SELECT unnest(range(0, 10)) AS j)),
    m AS (SELECT b.user_id, b.j, coalesce(avg(p.x), any_value(z.x)) AS mx, coalesce(avg(p.y), any_value(z.y)) AS my FROM b JOIN p z ON z.user_id = b.user_id AND z.i = b.n - 1 LEFT JOIN p ON p.user_id = b.user_id AND p.i >= b.hi AND p.i < b.after_ GROUP BY 1, 2),
    c AS MATERIALIZED (SELECT b.user_id, b.j, p.i, p.x, p.y, mx, my FROM b JOIN m USING (user_id, j) JOIN p ON p.user_id = b.user_id AND p.i >= b.lo AND p.i < b.hi),
    s AS (SELECT user_id, -1::BIGINT AS j, i, x, y FROM p WHERE n > 12 AND i = 0
      UNION ALL SELECT q.user_id, q.j, q.pick.i, q.pick.x, q.pick.y FROM (SELECT c.user_id, c.j, arg_max({{'i': c.i, 'x': c.x, 'y': c.y}}, abs((s.x - mx) * (c.y - s.y) - (s.x - c.x) * (my - s.y))) AS pick FROM s JOIN c ON c.user_id = s.user_id AND c.j = s.j + 1 GROUP BY 1, 2) q)
    SELECT user_id, {sql_stamp('ts')} AS ts, y AS value FROM p WHERE n <= 12 OR i = n - 1 UNION ALL SELECT user_id, {sql_stamp('p.ts')}, p.y FROM s JOIN p USING (user_id, i)"""
)
def ts_downsample_lttb(spark, sf):
    return by_user(spark, sf).downsample(12, "LTTB").select("user_id", stamp("ts", "ts"), "value")


@query()
def ts_downsample_random(spark, sf):
    return by_user(spark, sf).downsample(12, "RANDOM").select("user_id", "event_id", "value")


_DAILY = "(SELECT date_trunc('day', ts) AS ts, sum(value) AS value FROM events GROUP BY 1)"


def daily(spark, sf) -> Series:
    """One value per day of the whole table: as long as there are days, not rows."""
    return Series(Series(events(spark, sf)).resample("1 day", "SUM").withColumnRenamed("bucket", "ts"))


@query(
    f"""WITH d AS (SELECT ts, value, (row_number() OVER (ORDER BY ts) - 1) % 7 AS phase, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS trend FROM {_DAILY} WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    s AS (SELECT phase, avg(value - trend) AS s FROM d GROUP BY phase), m AS (SELECT avg(s) AS m FROM s)
    SELECT {sql_stamp('ts')} AS ts, round(trend, 4) AS trend, round(s - m, 4) AS seasonal, round(value - trend - (s - m), 4) AS residual FROM d JOIN s USING (phase), m"""
)
def ts_decompose(spark, sf):
    return daily(spark, sf).decompose(7).df.select(stamp("ts", "ts"), r("trend", "trend", 4), r("seasonal", "seasonal", 4), r("residual", "residual", 4))


@query(
    f"""WITH d AS (SELECT value, row_number() OVER (ORDER BY ts) - 1 AS i FROM {_DAILY}), f AS (SELECT regr_slope(value, i) AS a, regr_intercept(value, i) AS b, count(*) AS n FROM d)
    SELECT step::INTEGER AS step, round(b + a * (n - 1 + step), 4) AS forecast FROM f, (SELECT unnest(range(1, 8)) AS step)"""
)
def ts_linear_forecast(spark, sf):
    return daily(spark, sf).forecast_linear(7).select("step", r("forecast", "forecast", 4))


_USER_DAYS = "d AS MATERIALIZED (SELECT user_id, sum(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events GROUP BY user_id, date_trunc('day', ts))"
_STEPS = "(SELECT unnest(range(1, 8)) AS step)"

#: Of 19 smoothing factors the one of least squared one-step error.
_EXPONENTIAL = f"""WITH RECURSIVE {_USER_DAYS}, r AS (SELECT user_id, 0.05::DOUBLE + k * 0.05::DOUBLE AS a, i, n, v AS e, 0::DOUBLE AS cost FROM d, (SELECT unnest(range(0, 19)) AS k) WHERE i = 1
UNION ALL SELECT r.user_id, a, d.i, d.n, e + a * (d.v - e), cost + (d.v - e) * (d.v - e) FROM r JOIN d ON d.user_id = r.user_id AND d.i = r.i + 1)
SELECT user_id, step, round(e, 4) AS forecast FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cost, e) AS k FROM r WHERE i = n), {_STEPS} WHERE k = 1"""

#: Seasons of seven days, none for fewer than two of them.
_HOLT_WINTERS = f"""WITH RECURSIVE {_USER_DAYS}, y AS (SELECT user_id, n, list(v ORDER BY i) AS y, CASE WHEN n >= 14 THEN 7 ELSE 1 END AS m FROM d GROUP BY user_id, n),
t AS (SELECT *, list_avg(y[1:m]) AS mean, CASE WHEN n >= 2 * m THEN (list_avg(y[m + 1:2 * m]) - list_avg(y[1:m])) / m ELSE 0 END AS trend FROM y),
w AS (SELECT user_id, y, n, m, m AS i, mean + trend * (m - 1) / 2.0 AS level, trend, list_transform(range(0, m), lambda j: y[j + 1] - mean - trend * (j - (m - 1) / 2.0)) AS season FROM t
UNION ALL SELECT user_id, y, n, m, i + 1, l, 0.1 * (l - level) + 0.9 * trend, CASE WHEN m > 1 THEN list_concat(list_concat(season[1:i % m], [0.2 * (y[i + 1] - l) + 0.8 * season[i % m + 1]]), season[i % m + 2:m]) ELSE season END
  FROM (SELECT *, 0.3 * (y[i + 1] - season[i % m + 1]) + 0.7 * (level + trend) AS l FROM w WHERE i < n))
SELECT user_id, step, round(level + step * trend + CASE WHEN m > 1 THEN season[(n + step - 1) % m + 1] ELSE 0 END, 4) AS forecast FROM w, {_STEPS} WHERE i = n"""


#: Least squares by the normal equations of degree 2, or less for fewer than three days.
_POLYNOMIAL = f"""WITH {_USER_DAYS}, x AS (SELECT *, (i - 1) / greatest(1, n - 1)::DOUBLE AS x FROM d),
s AS (SELECT user_id, n, n::DOUBLE AS s0, sum(x) AS s1, sum(x ** 2) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(v) AS t0, sum(v * x) AS t1, sum(v * x * x) AS t2 FROM x GROUP BY user_id, n),
c AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
k AS (SELECT user_id, n, CASE WHEN n = 1 THEN t0 WHEN n = 2 THEN t0 - t1 ELSE (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det END AS c0,
  CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 2 * t1 - t0 ELSE (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det END AS c1,
  CASE WHEN n < 3 THEN 0 ELSE (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det END AS c2 FROM c),
f AS (SELECT *, (n - 1 + step) / greatest(1, n - 1)::DOUBLE AS x FROM k, {_STEPS})
SELECT user_id, step, round(c0 + c1 * x + c2 * x * x, 4) AS forecast FROM f"""


def _forecast(model: str, sql: str | None, **options):
    @query(sql, name=f"ts_forecast_{model.lower()}")
    def run(spark, sf):
        s = Series(by_user(spark, sf).resample("1 day", "SUM").withColumnRenamed("bucket", "ts"), ("user_id",))
        return sequential.forecast(s, 7, model, **options).select("user_id", "step", r("forecast", "forecast", 4))

    return run


for _m, _s, _o in (("POLYNOMIAL_REGRESSION", _POLYNOMIAL, {}), ("EXPONENTIAL_SMOOTHING", _EXPONENTIAL, {}), ("HOLT_WINTERS", _HOLT_WINTERS, {"period": 7}), ("ARIMA", None, {}), ("NEURAL_NETWORK", None, {})):
    _forecast(_m, _s, **_o)


#: Best segmentations of the first b days from those of fewer days; a segment has two days at least.
_CHANGEPOINTS = """WITH RECURSIVE y AS (SELECT user_id, list(v ORDER BY day) AS y, count(*) AS n, CASE WHEN var_pop(v) > 0 THEN var_pop(v) ELSE 1 END AS scale FROM (SELECT user_id, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY user_id),
p AS (SELECT user_id, n, scale, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(y[1:k]), 0)) AS s, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(list_transform(y[1:k], lambda v: v * v)), 0)) AS q FROM y),
r AS (SELECT *, 1::BIGINT AS b, [-5.0::DOUBLE, 'inf'::DOUBLE] AS best, [0::BIGINT, 0::BIGINT] AS last FROM p
UNION ALL SELECT user_id, n, scale, s, q, b + 1, list_append(best, list_min(c)), list_append(last, list_position(c, list_min(c)) - 1)
  FROM (SELECT *, list_transform(range(0, b), lambda a: best[a + 1] + (q[b + 2] - q[a + 1] - (s[b + 2] - s[a + 1]) ** 2 / (b + 1 - a)) / scale + 5.0) AS c FROM r WHERE b < n)),
t AS (SELECT user_id, last, last[n + 1] AS place FROM r WHERE b = n UNION ALL SELECT user_id, last, last[place + 1] FROM t WHERE place > 0)
SELECT user_id, place AS index FROM t WHERE place > 0"""


@query(_CHANGEPOINTS)
def ts_changepoints(spark, sf):
    return sequential.changepoints(Series(by_user(spark, sf).resample("1 day", "MEAN").withColumnRenamed("bucket", "ts"), ("user_id",)), 5.0)


@query(
    f"""WITH x AS ({HOURLY.format('click')}), y AS ({HOURLY.format('view')}), j AS (SELECT x.ts, x.value AS x, y.value AS y FROM x JOIN y ON x.ts = y.ts),
    f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM j), e AS (SELECT y - b - a * x AS e, lag(y - b - a * x) OVER (ORDER BY ts) AS l FROM j, f),
    s AS (SELECT sum(l * (e - l)) / sum(l * l) AS rho, sum(l * l) AS ll, count(*) AS n FROM e WHERE l IS NOT NULL),
    t AS (SELECT any_value(rho) / sqrt(sum((e - l - rho * l) * (e - l - rho * l)) / (any_value(n) - 1) / any_value(ll)) AS t FROM e, s WHERE l IS NOT NULL)
    SELECT t < -3.34 AS cointegrated, round(t, 6) AS statistic FROM t"""
)
def ts_cointegrated(spark, sf):
    return sequential.is_cointegrated(hourly(spark, sf, "click"), hourly(spark, sf, "view")).select("cointegrated", r("statistic", "statistic"))


@query("SELECT event_id, value FROM events WHERE event_type = 'view' AND ts >= (SELECT max(ts) FROM events WHERE event_type = 'view') - INTERVAL 48 HOUR")
def ts_retention(spark, sf):
    """What a metric store keeps of one metric, counted from the metric's last point."""
    from ..plans.scratch import scratch_path

    store = series.MetricStore(spark, scratch_path(spark, "metrics"))
    store.write("view", events(spark, sf).filter("event_type = 'view'").select("ts", "value", "event_id"))
    return store.retain("view", 48).select("event_id", "value")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def ts_gorilla_roundtrip(spark, sf):
    """Compressed by user and day, read back, and joined to its rows by time (times are distinct)."""
    from ..operators.tscodecs import compress_series, decompress_series

    df = events(spark, sf).filter("event_type = 'click'")
    back = decompress_series(compress_series(Series(df, ("user_id",), "ts", "value", "event_id")).drop("block"), ("user_id",))
    return back.join(df.select("user_id", "ts", "event_id"), ["user_id", "ts"]).select("event_id", "user_id", "value")


@query(f"SELECT {sql_stamp('time_bucket(INTERVAL 6 HOUR, ts)')} AS bucket, round(avg(value), 6) AS value FROM events WHERE event_type = 'view' AND user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-10' GROUP BY 1")
def ts_metric_store(spark, sf):
    """Two metrics written to a store partitioned by name; one is queried by time and tag."""
    from ..plans.scratch import scratch_path

    store = series.MetricStore(spark, scratch_path(spark, "metrics"))
    for kind in ("view", "click"):
        df = events(spark, sf).filter(F.col("event_type") == kind)
        store.write(kind, df.select("ts", "value", F.create_map(F.lit("even"), (F.col("user_id") % 2 == 0).cast("string")).alias("tags")))
    out = store.query_aggregate("view", "2024-01-03", "2024-01-10", "6 hours", "MEAN", {"even": "true"})
    return out.select(stamp("bucket", "bucket"), r("value", "value"))


@query(f"SELECT event_id, value FROM events UNION ALL SELECT event_id, value FROM events WHERE event_type = 'error'")
def ts_append(spark, sf):
    s = by_user(spark, sf)
    return s.append(s.df.filter("event_type = 'error'").select("event_id", "user_id", "ts", "value")).df.select("event_id", "value")
