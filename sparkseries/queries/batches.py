"""Batch, window, codec, decimal and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, security
from ..operators import batch, codecs
from ..plans.catalog import query, table


def r(c, alias, places=6):
    return F.round(F.col(c) if isinstance(c, str) else c, places).alias(alias)


def stamp(c, alias):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(alias)


SQL_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query("SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS window_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY window_id".replace("SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS window_id, count(*)", "SELECT window_id, count(*)").replace("FROM events", "FROM (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS window_id, value FROM events)"))
def win_tumbling_count(spark, sf):
    return batch.tumbling_count(table(spark, sf, "events"), 100, ["ts", "event_id"]).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), "total", 4))


@query(
    """WITH p AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
    w AS (SELECT unnest(range(0, (SELECT (any_value(n) - 100) // 50 + 1 FROM p))) AS window_id)
    SELECT window_id, count(*) AS n, round(sum(value), 4) AS total FROM w JOIN p ON pos >= window_id * 50 AND pos < window_id * 50 + 100 GROUP BY window_id"""
)
def win_sliding_count(spark, sf):
    return batch.sliding_count(table(spark, sf, "events"), 100, 50, ["ts", "event_id"]).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), "total", 4))


@query(f"SELECT event_type, {SQL_STAMP.format('time_bucket(INTERVAL 15 MINUTE, ts)')} AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def win_tumbling_time(spark, sf):
    return batch.tumbling_time(table(spark, sf, "events"), "ts", "15 minutes", ("event_type",), F.count(F.lit(1)).alias("n")).select("event_type", stamp("window_start", "window_start"), "n")


@query(f"SELECT event_type, {SQL_STAMP.format('time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE')} AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def win_sliding_time(spark, sf):
    return batch.sliding_time(table(spark, sf, "events"), "ts", "1 hour", "30 minutes", ("event_type",), F.count(F.lit(1)).alias("n")).select("event_type", stamp("window_start", "window_start"), "n")


@query(
    f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, {SQL_STAMP.format('min(ts)')} AS session_start, {SQL_STAMP.format('max(ts) + INTERVAL 30 MINUTE')} AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def win_session(spark, sf):
    return batch.session(table(spark, sf, "events"), "ts", "30 minutes", ("user_id",), F.count(F.lit(1)).alias("n")).select("user_id", stamp("session_start", "session_start"), stamp("session_end", "session_end"), "n")


# -- codecs ------------------------------------------------------------------------------


@query("SELECT event_id, (value * 100)::BIGINT - lag((value * 100)::BIGINT, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events")
def codec_delta(spark, sf):
    df = table(spark, sf, "events").withColumn("x", F.round(F.col("value") * 100).cast("long"))
    return codecs.delta_encode(df, "x", "event_id", ("user_id",)).select("event_id", "delta")


@query("SELECT o_orderkey, o_custkey AS x FROM orders")
def codec_delta_inverse(spark, sf):
    df = table(spark, sf, "orders").withColumn("block", F.floor(F.col("o_orderkey") / 1000))
    enc = codecs.delta_encode(df, "o_custkey", "o_orderkey", ("block",))
    return codecs.delta_decode(enc, "delta", "o_orderkey", ("block",), "x").select("o_orderkey", "x")


@query("SELECT o_orderkey, o_custkey AS x FROM orders")
def codec_delta_delta_inverse(spark, sf):
    df = table(spark, sf, "orders").withColumn("block", F.floor(F.col("o_orderkey") / 1000))
    enc = codecs.delta_delta_encode(df, "o_custkey", "o_orderkey", ("block",))
    return codecs.delta_delta_decode(enc, "delta2", "o_orderkey", ("block",), "x").select("o_orderkey", "x")


@query("SELECT event_id, xor(event_id * 3, lag(event_id * 3, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id)) AS x FROM events")
def codec_xor(spark, sf):
    return codecs.xor_encode(table(spark, sf, "events").withColumn("v", F.col("event_id") * 3), "v", "event_id", ("user_id",), "x").select("event_id", "x")


@query(
    """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM c)
    SELECT user_id, (k - dense)::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS length FROM (SELECT *, 1 - 1 + min(k) OVER (PARTITION BY user_id) AS dense FROM s) GROUP BY user_id, k, dense"""
)
def codec_rle(spark, sf):
    return codecs.rle_encode(table(spark, sf, "events"), "event_type", "event_id", ("user_id",)).select("user_id", "run", "event_type", "length")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type FROM events")
def codec_rle_inverse(spark, sf):
    return codecs.rle_decode(codecs.rle_encode(table(spark, sf, "events"), "event_type", "event_id", ("user_id",)), "event_type", ("user_id",)).select("user_id", "pos", "event_type")


@query("WITH f AS (SELECT event_type, min(event_id) AS f FROM events GROUP BY 1), d AS (SELECT event_type, row_number() OVER (ORDER BY f) - 1 AS code FROM f) SELECT event_id, code FROM events JOIN d USING (event_type)")
def codec_dictionary(spark, sf):
    return codecs.dictionary_encode(table(spark, sf, "events"), "event_type", "event_id")[0].select("event_id", "code")


@query("SELECT event_id, event_type FROM events")
def codec_dictionary_inverse(spark, sf):
    rows, words = codecs.dictionary_encode(table(spark, sf, "events"), "event_type", "event_id")
    return codecs.dictionary_decode(rows.select("event_id", "code"), words, "event_type").select("event_id", "event_type")


# -- map-reduce, pipelines, errors -----------------------------------------------------------


@query("SELECT o_orderpriority AS key, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top FROM orders GROUP BY 1")
def mapreduce_count_sum(spark, sf):
    return batch.map_reduce(table(spark, sf, "orders"), F.col("o_orderpriority"), F.col("o_totalprice"), {"n": F.count, "total": lambda c: F.round(F.sum(c), 2), "top": F.max})


@query("SELECT o_orderpriority AS key, median(o_totalprice) AS value FROM orders GROUP BY 1")
def mapreduce_any_reducer(spark, sf):
    return batch.map_reduce_any(table(spark, sf, "orders"), F.col("o_orderpriority"), F.col("o_totalprice"), lambda s: float(s.median()), "key string, value double")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice * 1.1::DOUBLE), 1) AS gross FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def batch_pipeline(spark, sf):
    p = batch.Pipeline().add("open", lambda d: d.filter("o_orderstatus <> 'P'")).add("tax", lambda d: d.withColumn("gross", F.col("o_totalprice") * 1.1)).add("sum", lambda d: d.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gross"), 1).alias("gross")))
    return p.process(table(spark, sf, "orders"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderkey % 10 <> 0) AS succeeded, count(*) FILTER (o_orderkey % 10 = 0) AS failed FROM orders")
def batch_error_isolation(spark, sf):
    rows = batch.map_rows(table(spark, sf, "orders").select("o_orderkey"), lambda x: 100.0 / (x["o_orderkey"] % 10), "double")
    return batch.batch_statistics(rows)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def batch_numbered(spark, sf):
    return batch.numbered(table(spark, sf, "events"), ["ts", "event_id"]).select("event_id", "pos")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus IN ('F', 'O')")
def batch_merge_sorted(spark, sf):
    o = table(spark, sf, "orders")
    merged = batch.merge_sorted([o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'")], ["o_orderkey"])
    placed = merged.select("o_orderkey", F.monotonically_increasing_id().alias("_at"))  # as the rows come out
    return batch.numbered(placed, ["_at"], (), "position").select("o_orderkey", "position")


@query("SELECT event_id, value * 2 AS twice, true AS small FROM events")
def batch_process(spark, sf):
    """In batches of 300 rows at most over four tasks."""

    def twice(frame):
        return frame[["event_id"]].assign(twice=frame["value"] * 2, small=len(frame) <= 300)

    return batch.process_batches(table(spark, sf, "events").select("event_id", "value"), twice, "event_id long, twice double, small boolean", batch.BatchOptions(300, 4))


# -- scalars ------------------------------------------------------------------------------


@query("SELECT l_returnflag, round(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2))), 2)::DOUBLE AS revenue FROM lineitem GROUP BY 1")
def decimal_sum_round(spark, sf):
    x, d = (scalars.decimal(F.col(c), 18, 2) for c in ("l_extendedprice", "l_discount"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(x * (F.lit(1).cast("decimal(18,2)") - d)), 2).cast("double").alias("revenue"))


@query("SELECT o_orderkey, CASE WHEN (o_totalprice::DECIMAL(18,2) * 100)::BIGINT % 8 = 4 THEN 2 * round((o_totalprice::DECIMAL(18,2) * 100)::BIGINT / 16)::BIGINT ELSE round((o_totalprice::DECIMAL(18,2) * 100)::BIGINT / 8)::BIGINT END / 100 AS part, (o_totalprice::DECIMAL(18,2) * 100)::BIGINT AS cents FROM orders")
def currency_bround(spark, sf):
    x = scalars.decimal(F.col("o_totalprice"), 18, 2)
    return table(spark, sf, "orders").select("o_orderkey", scalars.divide_and_round(x, F.lit(8).cast("decimal(2,0)"), 2).cast("double").alias("part"), scalars.to_cents(x).alias("cents"))


@query("SELECT c_custkey, (c_acctbal::DECIMAL(18,2) * 7.25::DECIMAL(5,2))::DOUBLE AS share_x100 FROM customer")
def percentage_apply(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", (scalars.apply_percentage(F.lit("7.25").cast("decimal(5,2)"), scalars.decimal(F.col("c_acctbal"), 18, 2)) * 100).cast("decimal(20,4)").cast("double").alias("share_x100"))


@query("SELECT c_custkey, trunc(c_acctbal::DECIMAL(18,2) * 10)::BIGINT AS tenths, abs(c_acctbal) AS size, c_acctbal < 0 AS negative FROM customer")
def decimal_truncate(spark, sf):
    x = scalars.decimal(F.col("c_acctbal"), 18, 2)
    return table(spark, sf, "customer").select("c_custkey", (scalars.truncate(x, 1) * 10).cast("long").alias("tenths"), F.abs("c_acctbal").alias("size"), (x < 0).alias("negative"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, (epoch_us(ts) % 1000000) * 1000 AS nanos, epoch_us(ts) // 1000 AS millis FROM events")
def timestamp_parts(spark, sf):
    """In UTC, whatever the session's zone: times without zone count from the epoch as they stand."""
    m = F.expr("(unix_date(cast(ts as date)) * 86400L + hour(ts) * 3600 + minute(ts) * 60) * 1000000 + cast(extract(second from ts) * 1000000 as bigint)")
    df = table(spark, sf, "events").select("event_id", scalars.from_micros(m).alias("t"))
    parts = scalars.split_timestamp(F.col("t"))
    return df.select("event_id", parts["seconds"].alias("seconds"), parts["nanos"].cast("long").alias("nanos"), scalars.to_millis(F.col("t")).alias("millis"))


@query("SELECT event_id, event_id BETWEEN -128 AND 127 AS is_byte, event_id * 1000 BETWEEN -2147483648 AND 2147483647 AS is_int, event_id % 3 <> 0 AS is_float, event_id * 1000000 BETWEEN 0 AND 4102444800 AS is_time FROM events")
def type_validate(spark, sf):
    k = F.col("event_id")
    odd = F.when(k % 6 == 0, F.lit(float("nan"))).when(k % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", scalars.valid_int(k, 8).alias("is_byte"), scalars.valid_int(k * 1000, 32).alias("is_int"), scalars.valid_float(odd).alias("is_float"), scalars.valid_timestamp(k * 1_000_000).alias("is_time"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || chr(65533) || 'x' END AS clean, doc_id % 2 = 0 AS is_utf8 FROM documents")
def utf8_sanitize(spark, sf):
    """Every other text with a byte that is no UTF-8 behind it."""
    t = F.col("text").cast("binary")
    data = F.when(F.col("doc_id") % 2 == 0, t).otherwise(F.concat(t, F.unhex(F.lit("FF")), F.lit("x").cast("binary")))
    return table(spark, sf, "documents").select("doc_id", scalars.sanitize_utf8(data).alias("clean"), scalars.valid_utf8(data).alias("is_utf8"))


@query("SELECT doc_id, length(text) AS n_chars2, octet_length(encode(text)) AS n_bytes, regexp_matches(text, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AS has_ip, true AS is_utf8 FROM documents")
def text_validate(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.char_length(t).cast("long").alias("n_chars2"), F.octet_length(t).cast("long").alias("n_bytes"), t.rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").alias("has_ip"), scalars.valid_utf8(t.cast("binary")).alias("is_utf8"))


@query("SELECT page_id, regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*:[^\\s]*') AS is_uri, starts_with(lower(html), '<!doctype html') AS is_html FROM pages")
def url_predicates(spark, sf):
    from ..schema.validate import matches_format

    return table(spark, sf, "pages").select("page_id", matches_format(F.col("url"), "uri").alias("is_uri"), F.lower("html").startswith("<!doctype html").alias("is_html"))


@query(
    """WITH z AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 5) AS dot, round(list_distance(embedding::DOUBLE[], q), 5) AS l2, round(list_cosine_similarity(embedding::DOUBLE[], q), 5) AS cosine FROM embeddings, z"""
)
def vector_measures(spark, sf):
    e = table(spark, sf, "embeddings")
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    d = e.join(F.broadcast(one))  # one row
    return d.select("vec_id", r(scalars.dot(F.col("embedding"), F.col("q")), "dot", 5), r(scalars.l2_distance(F.col("embedding"), F.col("q")), "l2", 5), r(scalars.cosine_similarity(F.col("embedding"), F.col("q")), "cosine", 5))


@query("WITH z AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, embedding < q AS smaller FROM embeddings, z")
def vector_lexicographic(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.join(F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", (F.col("embedding") < F.col("q")).alias("smaller"))  # one row


_PADS = {name: bytes(b ^ pad for b in b"a-very-secret-key".ljust(64, b"\0")).hex() for name, pad in (("inner", 0x36), ("outer", 0x5C))}


@query(f"SELECT doc_id, sha256(unhex('{_PADS['outer']}') || unhex(sha256(unhex('{_PADS['inner']}') || encode(text)))) AS signature FROM documents")
def hmac_sign(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    return df.select("doc_id", F.lower(F.hex(security.hmac_sha256(F.col("payload"), b"a-very-secret-key"))).alias("signature"))
