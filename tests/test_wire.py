import datetime as dt
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseries.functions import security
from sparkseries.operators import tscodecs
from sparkseries.sources import compression, datasource, formats, wire

scalars = st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False) | st.text() | st.binary() | st.builds(wire.Timestamp, st.integers(-(2**40), 2**40), st.integers(0, 10**9 - 1), st.none() | st.integers(-900, 900))
values = st.recursive(scalars, lambda x: st.lists(x, max_size=5) | st.dictionaries(st.text(max_size=8), x, max_size=5), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(values, st.booleans(), st.sampled_from([None, "ZLIB", "ZSTD", "AUTO"]))
def test_round_trip(v, tabular, compress):
    assert wire.decode(wire.encode(v, tabular=tabular, compress=compress, least=1)) == v


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80))
def test_any_bytes_give_a_value_or_an_error(data):
    try:
        wire.decode(data)
    except (wire.WireError, RecursionError, OverflowError):
        pass


@pytest.mark.parametrize(
    "v,hexed",
    [
        (None, "c0"), (False, "c2"), (True, "c3"), (0, "00"), (127, "7f"), (128, "cc80"), (255, "ccff"), (256, "cd0100"), (-1, "ff"), (-32, "e0"), (-33, "d0df"), (-129, "d1ff7f"),
        (2**64 - 1, "cf" + "ff" * 8), (-(2**63), "d380" + "00" * 7), (1.5, "cb3ff8000000000000"), ("", "a0"), ("abc", "a3616263"), (b"\1", "c40101"), ([1, "a"], "9201a161"), ({"b": 1, "a": 2}, "82a16102a16201"),
        (wire.Timestamp(1, 2), "c70cff" + "0000000000000001" + "00000002"), (wire.Extension(5, b"\0"), "d40500"), ("x" * 32, "d920" + "78" * 32),
    ],
)
def test_known_bytes(v, hexed):
    assert wire.encode(v).hex() == hexed
    assert wire.decode(bytes.fromhex(hexed)) == v


def test_tables_are_columns():
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    data = wire.encode(rows)
    body = struct.pack(">III", 1, 2, 2) + struct.pack(">I", 1) + b"a" + struct.pack(">I", 1) + b"b" + bytes([2, 5]) + struct.pack(">I", 2) + b"\1\2" + struct.pack(">I", 4) + b"\xa1x\xa1y"
    assert data == b"\xc7" + bytes([len(body)]) + b"\xf6" + body
    assert wire.decode(data) == rows
    assert wire.decode(data, {"b"}) == [{"b": "x"}, {"b": "y"}]
    assert wire.decode(wire.encode(rows, tabular=False)) == rows
    assert not wire.is_tabular(rows[:1]) and not wire.is_tabular([{"a": 1}, {"b": 1}])


def test_vectors_dates_times():
    assert wire.decode(wire.encode(wire.Vector((1.0, 2.5), True))) == wire.Vector((1.0, 2.5), True)
    assert wire.decode(wire.encode(dt.date(2024, 2, 29))) == dt.date(2024, 2, 29)
    t = dt.datetime(1969, 12, 31, 23, 59, 59, 500000, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    assert wire.Timestamp.from_datetime(t).to_datetime() == t
    assert wire.Timestamp.from_micros(-1) == wire.Timestamp(-1, 999_999_000)


@pytest.mark.parametrize("bad", [b"", b"\xc1", b"\xd9\x05ab", b"\xa2\xff\xfe", b"\xdd\xff\xff\xff\xff", b"\x93\x01", b"\x91" * 2000])
def test_bad_bytes(bad):
    with pytest.raises((wire.WireError, RecursionError)):
        wire.decode(bad)
    assert not security.check_bytes(bad)["valid"]


def test_compression_header():
    v = ["abc"] * 500
    data = wire.encode(v, compress="ZLIB")
    assert data[:4] == wire.MAGIC and data[5] == 0 and wire.decode(data) == v
    assert wire.encode([1, 2], compress="ZLIB") == wire.encode([1, 2])  # too small
    with pytest.raises(wire.WireError):
        wire.decode(data[:-3])
    bomb = wire.MAGIC + struct.pack(">BBHII", 1, 0, 0, 1, 1 << 31) + b"x"
    assert security.check_bytes(bomb)["errors"] == ["zip bomb"]


def test_frames_and_varints():
    assert list(wire.read_frames(wire.frames([1, "a", [2]]))) == [1, "a", [2]]
    assert list(wire.decode_all(wire.encode(1) + wire.encode("a"))) == [1, "a"]
    with pytest.raises(wire.WireError):
        list(wire.read_frames(wire.frames([1])[:-1]))
    for n in (0, 127, 128, 300, 2**63):
        assert wire.read_varint(wire.write_varint(n)) == (n, len(wire.write_varint(n)))
    for size in range(1, 9):  # seven bits a byte, beyond three bytes too
        assert len(wire.write_varint(2 ** (7 * size) - 1)) == size and len(wire.write_varint(2 ** (7 * size))) == size + 1


columns = st.sampled_from(
    [st.integers(-(2**63), 2**63 - 1), st.integers(0, 300), st.integers(-40, 127), st.integers(2**31, 2**33), st.floats(allow_nan=False), st.booleans(), st.text(), st.text(max_size=300), st.none() | st.integers(), st.integers(0, 2**70)]
)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_columns_are_encoded_like_their_cells(data):
    cells = data.draw(st.lists(data.draw(columns), min_size=2, max_size=40))
    one = wire.Encoder()
    for x in cells:
        one.put(x)
    whole = wire.column_bytes(cells)
    assert whole is None or whole == bytes(one.out)
    back = wire.column_values(memoryview(bytes(one.out)), len(cells))
    assert back is None or (back == cells and list(map(type, back)) == list(map(type, cells)))
    assert wire.decode(wire.encode([{"c": x} for x in cells])) == [{"c": x} for x in cells]


@pytest.mark.parametrize("framed", ["true", "false"])
def test_large_files_are_split(spark, tmp_path, framed):
    datasource.register(spark)
    path = str(tmp_path / "big")
    df = spark.range(20_000).selectExpr("id", "concat('row ', id) as name").coalesce(1)
    df.write.format("sparkseries").option("framed", framed).option("rows_per_value", "500").mode("append").save(path)
    back = spark.read.format("sparkseries").schema("id long, name string").option("framed", framed).option("split_bytes", "20000").load(path)
    assert back.rdd.getNumPartitions() > 5
    assert sorted(r.id for r in back.collect()) == list(range(20_000))
    whole = spark.read.format("sparkseries").schema("id long, name string").option("framed", framed).load(path)
    assert whole.rdd.getNumPartitions() == 1 and whole.count() == 20_000


def test_choice_of_compression():
    assert compression.select_best_algorithm(b"a" * 100) == "NONE" and compression.select_best_algorithm(b"a" * 1000) == "ZSTD"
    assert compression.numeric_level("ZSTD", "MAXIMUM") == 19 and compression.numeric_level("ZLIB", "FAST") == 3
    assert compression.estimate_ratio(b"a" * 1000, "ZLIB") == pytest.approx(0.5 + 0.4 / 256)
    assert compression.highly_compressible(b"ab" * 500) and not compression.highly_compressible(bytes(range(256)) * 4)
    assert compression.select_best_algorithm(bytes(range(256)) * 4) == "LZ4" and compression.select_best_algorithm(bytes(range(256)) * 256) == "ZSTD"
    assert compression.select_best_algorithm(b"a" * 1000, prefer_speed=True) == "LZ4"
    with pytest.raises(ValueError):
        compression.compress_bytes(b"a", "NOPE")


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000) | st.builds(lambda b, n: b * n, st.binary(max_size=40), st.integers(0, 300)), st.sampled_from(["NONE", "ZLIB", "LZ4", "ZSTD", "BROTLI", "SNAPPY"]), st.sampled_from(["FASTEST", "BALANCED", "MAXIMUM"]))
def test_codecs_round_trip(data, name, preset):
    packed = compression.compress_bytes(data, name, compression.numeric_level(name, preset))
    assert compression.decompress_bytes(packed, name) == data


@pytest.mark.parametrize("name", ["ZLIB", "LZ4", "ZSTD", "BROTLI", "SNAPPY"])
def test_too_long_or_torn_is_an_error(name):
    packed = compression.compress_bytes(b"abc" * 33_333, name)
    assert len(compression.decompress_bytes(packed, name, 99_999)) == 99_999
    with pytest.raises(Exception):
        compression.decompress_bytes(packed, name, 1000)
    with pytest.raises(Exception):
        compression.decompress_bytes(packed[:-5], name)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**45), 2**45), st.floats(allow_nan=False)), max_size=60))
def test_gorilla(points):
    t, v = [p[0] for p in points], [p[1] for p in points]
    assert tscodecs.gorilla_decode(tscodecs.gorilla_encode(t, v)) == (t, v)
    assert tscodecs.xor_decode(tscodecs.xor_encode(v)) == v


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**60 - 1) | st.just(1) | st.integers(0, 9), max_size=400))
def test_simple8b(xs):
    assert tscodecs.simple8b_decode(tscodecs.simple8b_encode(xs)) == xs
    assert [tscodecs.unzigzag(tscodecs.zigzag(x)) for x in xs] == xs and tscodecs.unzigzag(tscodecs.zigzag(-5)) == -5


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    df = spark.createDataFrame([(1, "a", [1.5], {"k": 2}, b"x", None), (2, None, [], {}, b"", True)], "id long, s string, f array<double>, m map<string,long>, b binary, t boolean")
    path = str(tmp_path / "t")
    for mode, n in (("append", 2), ("append", 4), ("overwrite", 2)):
        df.write.format("sparkseries").mode(mode).save(path)
        back = spark.read.format("sparkseries").schema(df.schema).load(path)
        assert back.count() == n
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    inferred = spark.read.format("sparkseries").load(path)
    assert dict(inferred.dtypes)["id"] == "bigint" and dict(inferred.dtypes)["s"] == "string"
    empty = str(tmp_path / "e")
    df.limit(0).write.format("sparkseries").mode("append").save(empty)
    assert spark.read.format("sparkseries").schema(df.schema).load(empty).count() == 0


def test_convert_folder_isolates_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.spw").write_bytes(wire.encode([{"x": 3}, {"x": 4}]))
    (tmp_path / "c.json").write_text("{broken")
    rows = {r.path.rsplit("/", 1)[1]: r for r in formats.convert_folder(spark, str(tmp_path), "wire").collect()}
    assert wire.decode(bytes(rows["a.json"].output)) == [{"x": 1}, {"x": 2}] and rows["b.spw"].error is None and rows["c.json"].output is None and "JSONDecodeError" in rows["c.json"].error
    assert formats.detect_format("x", b"  {") == "json" and formats.detect_format("a.yml") == "yaml" and formats.detect_format("q") is None


def test_signatures(spark):
    from pyspark.sql import functions as F

    key = b"a-very-secret-key"
    df = spark.createDataFrame([(b"payload", security.sign_bytes(b"payload", key)), (b"tampered", security.sign_bytes(b"payload", key)), (b"x", None)], "p binary, s binary")
    assert [r[0] for r in df.select(security.verify(F.col("p"), F.col("s"), key)).collect()] == [True, False, False]
    long = b"k" * 100
    assert bytes(df.limit(1).select(security.hmac_sha256(F.col("p"), long)).first()[0]) == security.sign_bytes(b"payload", long)
    assert security.verify_bytes(b"a", security.sign_bytes(b"a", key), key)


def test_validation_limits():
    deep = wire.encode([[[[1]]]])
    assert security.check_bytes(deep, security.Limits(max_depth=2))["errors"] == ["nested too deeply"]
    assert security.check_bytes(wire.encode(float("nan")), security.Limits(allow_nan=False))["errors"] == ["not a finite number"]
    stats = security.check_bytes(wire.encode({"a": ["x", b"y"], "b": {}}))
    assert (stats["valid"], stats["maps"], stats["arrays"], stats["strings"], stats["binaries"], stats["max_depth"]) == (True, 2, 1, 1, 1, 2)
