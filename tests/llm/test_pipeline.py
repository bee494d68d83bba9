import zlib

import numpy as np
import pyarrow.dataset as ds
from tokenizers import Tokenizer

import corpus_pipeline
from sparkseries.llm import simhash, token_files
from tests.llm import test_op3, test_op5
from tests.llm.util import duck
from sparkseries.llm import quality

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    kept = {r["doc_id"] for r in duck(quality.oracle(), SF) if r["kept"]}
    outs = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
        assert k == 4 or docs.columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in outs]
    assert ids[0] == kept
    order = sorted(kept)
    prints = [simhash.fingerprint(before[i].text) for i in order]
    assert ids[1] == {order[c] for c in set(test_op5.plain_classes(prints))}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {x[0] for x in test_op3.brute([(i, before[i].text) for i in ids[1]], items)}
    assert leaks and ids[2] == ids[1] - leaks == ids[3] == ids[4]
    # The mix is the order of the stored files; the token files follow it.
    rows = []
    for f in sorted((tmp_path / "3").glob("part-*.parquet")):
        rows += ds.dataset(f).to_table().to_pylist()
    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    got = {r.doc_id: r for r in outs[4].collect()}
    start = 0
    for r in rows:
        x = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        assert (got[r["doc_id"]].start, got[r["doc_id"]].n_tokens, got[r["doc_id"]].ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    first = [r["source"] for r in rows[: 64 * 3]]
    assert len(set(first)) >= 3


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


CLASHES = "id fp row key level kept n s src first slots words h tk body _row _kept _leak _source _position _file component_id shard slot".split()


def test_odd_documents(spark, tmp_path):
    """Nulls in every column, repeated rows, empty texts and columns named like the operators' own."""
    (tmp_path / "sf").mkdir()
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    prose = "word%d and then some more of it to read here, so that there are ten words"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (None, prose % 1, None, None, None), (2, prose % 2, "en", "a", 9), (2, prose % 2, "en", "a", 9), (3, " ".join(prose % i for i in range(30_000)), "de", "b", 1), (4, "x", "en", None, 1)]
    docs = spark.createDataFrame([r + tuple(None if i % 2 else f"{i}" for i in range(len(CLASHES))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    for source in (docs, docs.limit(0)):
        df = source
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            # Each stage sees the odd rows, whatever the one before it dropped.
            path = str(tmp_path / f"{k}-{source is docs}")
            df.write.parquet(path)
            stored = spark.read.parquet(path)
            out = f(spark, stored, str(tmp_path / "sf"))
            assert k == 4 or out.columns == docs.columns
            n = out.count()
            assert source is docs or n == 0
            if source is docs:
                assert n == [3, 6, 7, 7, 7][k], (k, n)
