import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import sparkseries.llm.token_files as m


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(m.default_tokenizer())


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(" aéñ.,;:!?%&*#$'-1»\u0301", max_size=40) | st.text(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　aA1'sİßΣ̧́.<|>é", max_size=40) | st.sampled_from(["<|endoftext|>", "a<|startoftext|> b", "we'll 's 12ab"]))
def test_words_are_encoded_like_whole_texts(text):
    encode = m.encoder(m.default_tokenizer())
    assert encode.by_word
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_many_random_texts_and_letters_that_change():
    """Marks behind letters that lower case or composition turns into something else, and 30,000 random texts."""
    encode = m.encoder(m.default_tokenizer())
    rng = np.random.default_rng(8)
    odd = [chr(c) for c in [*range(0x21, 0x250), *range(0x300, 0x320), 0x345, 0x3A3, 0x3C2, 0x958, 0x1E9E, 0x212A, 0x2126, 0xFB1D, 0x1100, 0x1161, 0xAC00, 0x10400, 0x1F600]]
    texts = [c + mark for c in odd for mark in (".", "*", ",;", "̇!")] + ["İ*", "aİ.", "İİ, b", "<|endoftext|>.", " <|endoftext|>", "A<|startoftext|>B."]
    common = list("aeinorst AEIO .,;:!?%&*#$'-10<|>\n\t") + odd
    texts += ["".join(rng.choice(common, rng.integers(1, 30))) for _ in range(30_000)]
    want = encode.tokenizer.encode_batch(texts, add_special_tokens=False)
    got = encode(texts)
    assert [t for t, g, w in zip(texts, got, want) if g != np.array(w.ids, "<u4").tobytes()] == []


def test_file_round_trip_and_selective_reading(tmp_path, monkeypatch):
    monkeypatch.setattr(m, "FRAME_BYTES", 64)
    rng = np.random.default_rng(0)
    docs = [(None, b"")] + [(i, rng.integers(0, 60_000, rng.integers(0, 40)).astype("<u4").tobytes()) for i in range(200)]
    path = str(tmp_path / "x.zst")
    with open(path, "wb") as f:
        w = m.TokenFileWriter(f)
        for i, t in docs:
            w.add(i, t)
        w.close()
    r = m.TokenFileReader(path)
    assert list(r) == docs and len(r.frames) > 50
    r = m.TokenFileReader(path)
    got = r.read({17, 150})
    assert [(i, t.tobytes()) for i, t in got] == [docs[18], docs[151]] and r.decompressed <= 2
    data = open(path, "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain == b"".join(t for _, t in docs)  # any decoder reads the file
    broken = bytearray(data)
    at, size, _, _ = r.frames[3]
    broken[at + size - 2] ^= 0xFF
    open(path, "wb").write(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(m.TokenFileReader(path))
    open(path, "wb").write(data[:-4] + struct.pack("<I", 1))
    with pytest.raises(ValueError):
        m.TokenFileReader(path)


def test_documents_longer_than_a_frame(tmp_path, monkeypatch):
    monkeypatch.setattr(m, "FRAME_BYTES", 64)
    monkeypatch.setattr(m, "PART_BYTES", 64)
    docs = [(1, b"aaaa"), (None, bytes(range(200)) * 2), (3, b""), (4, b"b" * 64), (5, b"c" * 68)]
    path = str(tmp_path / "x.zst")
    with open(path, "wb") as f:
        w = m.TokenFileWriter(f)
        for i, t in docs:
            w.add(i, t)
        w.close()
    r = m.TokenFileReader(path)
    assert list(r) == docs and max(size for _, _, size, _ in r.frames) == 64
    for i, t in docs:
        assert [(j, x.tobytes()) for j, x in r.read({i})] == [(i, t)]


def test_a_long_text(spark, tokenizer):
    """Workers cut at the size of the module; a text of more than two frames."""
    text = " ".join(f"word{i} naïve, {i * 37 % 9973}" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string")
    ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
    assert len(ids) * 4 > 2 * m.FRAME_BYTES
    got = sorted(tuple(r) for r in m.token_round_trip(df).collect())
    assert got[0] == (1, 0, len(ids), zlib.crc32(ids.tobytes())) and got[1][1] == len(ids)


def test_table(spark, tokenizer):
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(path).to_pylist()}
    got = {r.doc_id: r for r in m.token_round_trip(spark.read.parquet(path)).collect()}
    start = 0
    assert len(got) == len(texts)
    for i in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_odd_rows(spark):
    df = spark.createDataFrame([(3, "b", 1), (None, None, 2), (1, "", 3), (3, "b", 4)], "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in m.token_round_trip(df).collect()), key=lambda r: r[1])
    assert [r[:3] for r in got] == [(None, 0, 1), (1, 1, 1), (3, 2, 2), (3, 4, 2)]
    assert m.token_round_trip(df.limit(0)).count() == 0
