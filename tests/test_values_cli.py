import json
import socket
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseries import cli
from sparkseries.functions import scalars, values
from sparkseries.schema.model import SchemaBuilder
from sparkseries.sources import wire


def test_values(spark):
    df = spark.createDataFrame([('{"a":1}', '{"a":1}'), ("1", "1.5"), ("null", "null"), ('"x"', "2")], "a string, b string").select(F.parse_json("a").alias("a"), F.parse_json("b").alias("b"), F.col("a").alias("t"))
    assert [tuple(r) for r in df.select(values.equals(F.col("a"), F.col("b")), values.type_of(F.col("a"))).collect()] == [(True, "map"), (False, "int"), (True, "nil"), (False, "string")]
    assert [r.encoded_size for r in values.size_of(df, "t").collect()] == [4, 1, 1, 2]
    maps = spark.createDataFrame([('{"a":1,"b":2}',), ('{"b":0,"a":1}',)], "j string").select(F.parse_json("j").alias("v"))
    assert values.is_tabular(maps, "v").first()[0] and not values.is_tabular(maps.limit(1), "v").first()[0] and not values.is_tabular(maps.union(df.select("a")), "v").first()[0]


def test_numpy_bridge(spark):
    for a in (np.array([1.5, 2.5, 3.0]), np.arange(6.0).reshape(3, 2)):
        assert np.array_equal(values.to_numpy(values.from_numpy(spark, a), "values"), a)
    with pytest.raises(ValueError):
        values.to_numpy(spark.range(5).withColumnRenamed("id", "index"), "index", limit=2)


def test_scalars(spark):
    d = spark.createDataFrame([("10.005", -7), ("x", 0), ("-2.50", 3)], "s string, n int")
    x = scalars.decimal(F.col("s"), 18, 3)
    rows = d.select(x.cast("string"), scalars.normalize(x), scalars.truncate(x, 1).cast("string"), scalars.format_currency(x), scalars.is_integer(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("10.005", "10.005", "10.0", "$10.00", True), (None, None, None, None, True), ("-2.500", "-2.5", "-2.5", "-$2.50", True)]
    one = spark.range(1).select(
        scalars.from_cents(F.lit(1234)).cast("string"), scalars.to_cents(F.lit("12.34").cast("decimal(10,2)")), scalars.as_basis_points(F.lit("2.5").cast("decimal(5,2)")), scalars.valid_int(F.lit("128"), 8), scalars.valid_int(F.lit("-128"), 8),
        scalars.valid_float(F.lit(float("nan"))), scalars.valid_timestamp(F.lit(-1)), scalars.valid_utf8(F.lit(b"\xff")), scalars.sanitize_utf8(F.lit(b"a\xff")), scalars.split_timestamp(F.timestamp_micros(F.lit(-1)))["seconds"],
    ).first()
    assert tuple(one) == ("12.34", 1234, 250, False, True, False, False, False, "a�", -1)


def test_cli(spark, tmp_path, capsys):
    s = SchemaBuilder("user").field("id", "int").build()
    (tmp_path / "a.json").write_text(s.to_json())
    (tmp_path / "b.json").write_text(SchemaBuilder("user").version(2).field("id", "string").optional_field("x", "any").build().to_json())
    data = tmp_path / "in"
    data.mkdir()
    (data / "d.json").write_text('[{"id": 1}, {"id": "z"}]')
    run = lambda *a: (cli.main([str(x) for x in a]), capsys.readouterr().out)
    assert "Field added: x" in run("diff", tmp_path / "a.json", tmp_path / "b.json")[1]
    assert "interface User" in run("generate", tmp_path / "a.json", "--language", "typescript")[1]
    assert json.loads(run("export", tmp_path / "a.json")[1])["required"] == ["id"] and "# user" in run("doc", tmp_path / "a.json")[1]
    code, out = run("validate", tmp_path / "a.json", data / "d.json")
    assert code == 1 and json.loads(out)["invalid"] == 1
    assert json.loads(run("infer", data / "d.json")[1])["fields"][0]["type"] == "any"
    (data / "bad.json").write_text("{")
    assert run("convert", data, tmp_path / "out", "--format", "wire")[0] == 1
    assert wire.decode((tmp_path / "out" / "d.spw").read_bytes()) == [{"id": 1}, {"id": "z"}]


def test_socket_stream(spark, tmp_path):
    from sparkseries.sources import socket as source

    source.register(spark)
    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]

    def serve():
        while True:
            try:
                link, _ = server.accept()
            except OSError:
                return
            link.sendall(wire.frames([{"a": i, "b": f"x{i}"} for i in range(5)]))

    threading.Thread(target=serve, daemon=True).start()
    seen: list = []
    stream = spark.readStream.format("sparkseries_socket").schema("a long, b string").option("port", str(port)).option("host", "127.0.0.1").load()
    q = stream.writeStream.foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(100):
        q.awaitTermination(0.3)
        if len(seen) >= 5:
            break
    q.stop()
    server.close()
    assert [(r.a, r.b) for r in seen][:5] == [(i, f"x{i}") for i in range(5)]
