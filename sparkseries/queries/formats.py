"""Binary format, compression and streaming queries: round trips give the source back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.catalog import query, table
from ..functions import security, values
from ..plans.scratch import scratch_path, ship_package
from ..sources import compression, datasource, formats, wire
from ..streaming import stateful


def _roundtrip(df, sf, spark, **options):
    datasource.register(spark)
    path = scratch_path(spark, "wire")
    df.write.format("sparkseries").mode("append").options(**options).save(path)
    return spark.read.format("sparkseries").options(**{k: v for k, v in options.items() if k == "framed"}).schema(df.schema).load(path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def wire_roundtrip(spark, sf):
    return _roundtrip(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), sf, spark, framed="true", compress="ZSTD")


@query("SELECT event_id, user_id, event_type, value FROM events")
def wire_tabular_roundtrip(spark, sf):
    return _roundtrip(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), sf, spark, rows_per_value="1000")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def wire_msgpack_roundtrip(spark, sf):
    return _roundtrip(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), sf, spark, tabular="false")


@query("SELECT event_id, value FROM events")
def wire_column_pruning(spark, sf):
    """Only two of four columns are decoded."""
    datasource.register(spark)
    path = scratch_path(spark, "wire")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.format("sparkseries").mode("append").save(path)
    return spark.read.format("sparkseries").schema("event_id long, value double").load(path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def wire_rows_in_columns(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return formats.decode_rows(formats.encode_rows(df), "data", "c_custkey long, c_name string, c_acctbal double").filter("error is null").drop("error")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def compress_roundtrip(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    back = compression.decompress_column(compression.compress_column(df, "data", "ZSTD"), "data", "ZSTD")
    return back.select("doc_id", F.md5("data").alias("digest"))


@query(
    """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS size, hex(encode(text)[1:1024]) AS h FROM documents),
    b AS (SELECT *, CASE WHEN size < 256 THEN 256 ELSE len(list_distinct(list_transform(range(0, least(size, 1024)), lambda i: h[2 * i + 1:2 * i + 2]))) END AS n FROM d)
    SELECT doc_id, size, CASE WHEN size < 128 THEN 'NONE' WHEN size < 65536 AND n >= 128 THEN 'LZ4' ELSE 'ZSTD' END AS algorithm FROM b"""
)
def compress_profile(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return compression.profile_column(df, "data").select("doc_id", F.col("size").cast("long").alias("size"), "algorithm")


@query("SELECT doc_id, algorithm, true AS same FROM documents, (SELECT unnest(['LZ4', 'SNAPPY', 'BROTLI', 'ZLIB', 'ZSTD']) AS algorithm)")
def compress_all_codecs(spark, sf):
    """Every text through every codec and back."""
    df = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    out = None
    for name in ("LZ4", "SNAPPY", "BROTLI", "ZLIB", "ZSTD"):
        packed = compression.compress_column(df, "data", name, "FAST", "packed")
        back = compression.decompress_column(packed, "packed", name, "back").select("doc_id", F.lit(name).alias("algorithm"), (F.col("back") == F.col("data")).alias("same"))
        out = back if out is None else out.union(back)
    return out


_DISTINCT = "len(list_distinct(list_transform(range(0, least(size, 1024)), lambda i: h[2 * i + 1:2 * i + 2])))"
_HEADS = "(SELECT doc_id, octet_length(encode(text)) AS size, hex(encode(text)[1:1024]) AS h FROM documents)"
_BEST = f"CASE WHEN size < 65536 AND (size < 256 OR {_DISTINCT} >= 128) THEN 'LZ4' ELSE 'ZSTD' END"


@query(
    f"""SELECT doc_id, 'realtime' AS profile, CASE WHEN size < 128 THEN 'NONE' ELSE 'LZ4' END AS algorithm, true AS same FROM {_HEADS}
    UNION ALL SELECT doc_id, 'streaming', CASE WHEN size < 512 THEN 'NONE' ELSE 'LZ4' END, true FROM {_HEADS}
    UNION ALL SELECT doc_id, 'storage', CASE WHEN size < 64 THEN 'NONE' ELSE 'BROTLI' END, true FROM {_HEADS}
    UNION ALL SELECT doc_id, 'network', CASE WHEN size < 256 THEN 'NONE' ELSE {_BEST} END, true FROM {_HEADS}"""
)
def compress_profiles(spark, sf):
    """Every text through every profile and back."""
    df = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    out = None
    for name in compression.PROFILES:
        packed = compression.compress_by_profile(df, "data", name)
        back = compression.decompress_by_name(packed, "packed", "algorithm", "back").select("doc_id", F.lit(name).alias("profile"), "algorithm", (F.col("back") == F.col("data")).alias("same"))
        out = back if out is None else out.union(back)
    return out


@query(f"SELECT doc_id, CASE WHEN size < 64 THEN 1.0 ELSE round(CASE WHEN size < 128 THEN 1.0 WHEN a = 'LZ4' THEN 0.7 + 0.25 * d / 256 ELSE 0.45 + 0.45 * d / 256 END, 10) END::DOUBLE AS ratio FROM (SELECT *, {_DISTINCT} AS d, {_BEST} AS a FROM {_HEADS})")
def compress_estimate(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return compression.profile_column(df, "data").select("doc_id", F.round("estimated_ratio", 10).alias("ratio"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, md5(props) AS digest, event_id * 1.5::DOUBLE AS twice, event_type FROM events")
def wire_typed_roundtrip(spark, sf):
    """Timestamps, dates, binaries, lists and maps as typed extensions, encoded by row and read back."""
    k = F.col("event_id")
    made = table(spark, sf, "events").select("event_id", F.col("ts"), F.to_date("ts").alias("day"), F.unhex(F.md5("props")).alias("raw"), F.array(k * 0.5, k * 1.0).alias("parts"), F.create_map(F.lit("kind"), "event_type").alias("tags"))
    back = formats.decode_rows(formats.encode_rows(made), "data", "event_id long, ts timestamp_ntz, day date, raw binary, parts array<double>, tags map<string,string>").filter("error is null")
    return back.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("day").cast("string").alias("day"), F.lower(F.hex("raw")).alias("digest"), (F.col("parts")[0] + F.col("parts")[1]).alias("twice"), F.col("tags")["kind"].alias("event_type"))


@query("SELECT event_id, CASE WHEN event_id < 128 THEN 1 WHEN event_id < 16384 THEN 2 ELSE 3 END::BIGINT AS bytes, event_id AS back FROM events")
def wire_varint(spark, sf):
    def run(frames):
        for f in frames:
            packed = [wire.write_varint(int(x)) for x in f["event_id"]]
            yield f.assign(bytes=[len(p) for p in packed], back=[wire.read_varint(p)[0] for p in packed])

    ship_package(spark)
    return table(spark, sf, "events").select("event_id").mapInPandas(run, "event_id long, bytes long, back long")


@query("SELECT event_id, event_id % 2000 <= 1000 AS ok FROM events")
def wire_zip_bombs(spark, sf):
    """Compression headers that claim 0 to 1,999 bytes for one: above a thousandfold they are bombs; the rest is torn."""
    head = F.concat(F.lit(wire.MAGIC), F.unhex(F.lit("01000000" + "00000001")), F.unhex(F.lpad(F.hex(F.col("event_id") % 2000), 8, "0")), F.lit(b"x"))
    checked = security.validate_column(table(spark, sf, "events").select("event_id", head.alias("data")), "data")
    return checked.select("event_id", (~F.array_contains("check.errors", "zip bomb")).alias("ok"))


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'csv' WHEN 2 THEN 'yaml' WHEN 3 THEN 'msgpack' WHEN 4 THEN 'xml' END AS format FROM nation")
def format_detect(spark, sf):
    endings = ["json", "tsv", "yml", "mp", "xml", "unknown"]
    rows = [(r[0], formats.detect_format(f"{r[1]}.{endings[r[0] % 6]}")) for r in table(spark, sf, "nation").select("n_nationkey", "n_name").collect()]
    return spark.createDataFrame(rows, "n_nationkey int, format string")


@query("SELECT n_nationkey, n_name FROM nation")
def convert_json_files(spark, sf):
    """Files of one JSON array each, converted to the binary format file by file, and read."""
    source, made = scratch_path(spark, "json-files"), scratch_path(spark, "wire-files")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    lists = n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    for k in range(5):  # one file per region
        lists.filter(F.col("n_regionkey") == k).select("value").coalesce(1).write.text(f"{source}/region{k}")
    done = formats.convert_folder(spark, source, "wire")
    done = done.filter("error is null").select("output")
    done.write.parquet(made)
    return formats.decode_rows(spark.read.parquet(made), "output", "n_nationkey int, n_name string").filter("error is null").drop("error")


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def wire_transform_files(spark, sf):
    """Tables of customers, file by file through a function, and read again."""
    datasource.register(spark)
    source, target = scratch_path(spark, "wire"), scratch_path(spark, "wire-twice")
    table(spark, sf, "customer").select("c_custkey", "c_acctbal").repartition(3, "c_custkey").write.format("sparkseries").option("rows_per_value", "100").mode("append").save(source)
    done = formats.transform_files(spark, source, target, lambda rows, _: [{"c_custkey": r["c_custkey"], "twice": r["c_acctbal"] * 2} for r in rows], "ZSTD")
    failed = done.filter("error is not null").count()
    if failed:
        raise RuntimeError(f"{failed} files failed")
    return spark.read.format("sparkseries").option("framed", "true").schema("c_custkey long, twice double").load(target)


@query("SELECT s_suppkey, s_name FROM supplier")
def convert_streaming(spark, sf):
    """Half of the suppliers arrive as binary files, are streamed to JSON, then the other half."""
    datasource.register(spark)
    source, target, state = scratch_path(spark, "wire"), scratch_path(spark, "json"), scratch_path(spark, "stream-state")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    for half in (0, 1):
        s.filter(F.col("s_suppkey") % 2 == half).coalesce(1).write.format("sparkseries").mode("append").save(source)
        formats.convert_stream(spark, source, target, "json", "s_suppkey long, s_name string", state).awaitTermination()
    return formats.read(spark, target, "json", schema="s_suppkey long, s_name string")


@query("SELECT event_id, 'map' AS kind, 'int' AS inner_kind, event_id % 2 = 0 AS same, 3 + CASE WHEN k < 128 THEN 1 ELSE 2 END::BIGINT AS size FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events)")
def value_facts(spark, sf):
    """Kind, typed equality and encoded size of dynamic values."""
    v, k = F.parse_json("props"), F.col("event_id")
    other = F.parse_json(F.when(k % 2 == 0, F.col("props")).otherwise(F.lit('{"k": "text"}')))
    df = values.size_of(table(spark, sf, "events"), "props", "size")
    return df.select("event_id", values.type_of(v).alias("kind"), values.type_of(F.variant_get(v, "$.k", "variant")).alias("inner_kind"), values.equals(v, other).alias("same"), F.col("size"))


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS valid FROM supplier")
def wire_validate(spark, sf):
    """A third of the rows whole, a third cut short, a third with a byte that begins no value."""
    df = table(spark, sf, "supplier")
    data = formats.to_wire(F.struct(*df.columns))
    k = F.col("s_suppkey") % 3
    short = F.expr("substring(data, 1, octet_length(data) - 1)")
    df = df.select("s_suppkey", data.alias("data")).withColumn("data", F.when(k == 0, F.col("data")).when(k == 1, short).otherwise(F.concat(F.unhex(F.lit("C1")), "data")))
    return security.validate_column(df, "data").select("s_suppkey", F.col("check.valid").alias("valid"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    formats.write(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, "json")
    return formats.read(spark, path, "json", schema="n_nationkey long, n_name string")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def xml_roundtrip(spark, sf):
    path = scratch_path(spark, "xml")
    formats.write(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, "xml", rowTag="nation")
    return formats.read(spark, path, "xml", rowTag="nation", schema="n_nationkey long, n_name string")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    formats.write(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, "csv")
    return formats.read(spark, path, "csv", schema="n_nationkey long, n_name string")


# -- streaming ---------------------------------------------------------------------------------


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _complete(df, mode: str, before=(None,)):
    """Run a stream over all there is and read what it wrote; once after each function of ``before``, going on from its state."""
    spark = df.sparkSession
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")

    def keep(batch, k):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    for arrive in before:
        if arrive:
            arrive()
        df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY 1, 2".replace("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*)", "SELECT event_type, count(*) AS windows, sum(n)::BIGINT AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*)") + ") GROUP BY 1")
def stream_tumbling(spark, sf):
    out = _complete(stateful.tumbling(_stream(spark, sf), "ts", "1 hour", ("event_type",), F.count(F.lit(1)).alias("n")), "complete")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"))


@query("SELECT event_type, count(DISTINCT w) AS windows, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < time_bucket(INTERVAL 1 HOUR, (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)) GROUP BY 1")
def stream_late_rows(spark, sf):
    """The second half of the month arrives first; the first half is late then and is dropped, and windows that the
    watermark has not passed are not given out."""
    path, e = scratch_path(spark, "late"), table(spark, sf, "events")
    e.limit(0).write.parquet(path)  # the folder must be there
    halves = [lambda h=h: e.filter(h).write.mode("append").parquet(path) for h in ("ts >= '2024-01-15'", "ts < '2024-01-15'")]
    source = spark.readStream.schema(e.schema).parquet(path)
    out = _complete(stateful.tumbling(source, "ts", "1 hour", ("event_type",), F.count(F.lit(1)).alias("n")), "append", halves)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS n FROM g GROUP BY user_id"""
)
def stream_sessions(spark, sf):
    out = _complete(stateful.sessions(_stream(spark, sf), "ts", "30 minutes", ("user_id",), F.count(F.lit(1)).alias("n")), "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (a) AS odd FROM (SELECT coalesce(abs(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) > 1.5, false) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING))")
def stream_ring_buffer(spark, sf):
    out = _complete(stateful.ring_buffer(_stream(spark, sf), "user_id", "ts", "value", 16, 1.5, "event_id"), "append")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("odd"))


@query("SELECT event_type, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY 1")
def stream_continuous_query(spark, sf):
    path = scratch_path(spark, "continuous")
    queries = stateful.ContinuousQueries()
    df = _stream(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("top"))
    queries.register("top_values", df, lambda b, k: b.write.mode("overwrite").parquet(path), mode="complete").awaitTermination()
    queries.unregister("top_values")
    return spark.read.parquet(path)


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def stream_subscriptions(spark, sf):
    path = scratch_path(spark, "subscribers")
    subs = stateful.Subscriptions()
    for kind in ("error", "signup"):
        subs.subscribe(kind, F.col("event_type") == kind, lambda b: b.select("event_id", "event_type").write.mode("append").parquet(path))
    _stream(spark, sf).writeStream.foreachBatch(subs.publish).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def stream_wire_source(spark, sf):
    datasource.register(spark)
    path = scratch_path(spark, "wire")
    table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").write.format("sparkseries").mode("append").save(path)
    return _complete(spark.readStream.format("sparkseries").schema("n_nationkey long, n_name string").load(path), "append")


