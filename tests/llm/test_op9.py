import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import sparkseries.llm.token_counts as m


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=m.default_model())


LIB = sentencepiece.SentencePieceProcessor(model_file=m.default_model())
COUNT = m.TokenCounter(m.default_model())


@settings(max_examples=1500, deadline=None)
@given(st.text(max_size=50) | st.text(" ▁\n\t\r\x00abetinr<s>/0.é́漢\U0001f600", max_size=60) | st.text(" \n the", max_size=40))
def test_equals_library(text):
    assert COUNT(text) == len(LIB.encode(text)), text
    assert COUNT(text) == len(LIB.encode(text))  # once more, remembered


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "   " * 40, "\n\n x\n ", " \n", "\n", " ", "<s></s><unk> <0x41>", "hello world\nhello  world ", "x" * 49 + " " + "x" * 49])
def test_hard_texts(library, text):
    assert COUNT(text) == len(library.encode(text))


def test_table(spark, library):
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(path).to_pylist()}
    got = m.count_tokens(spark.read.parquet(path)).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "é", 0)], "doc_id long, text string, n_bytes int")
    assert sorted(tuple(r)[1:] for r in m.count_tokens(df).collect())[:3] == [(0, 0, False)] * 3
    assert m.count_tokens(df.limit(0)).count() == 0
