import math
import re

import pytest
from pyspark.sql import functions as F

from sparkseries.llm import quality
from tests.llm.util import duck, same

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \t\n", "a b c d e a b c d e a b c d e", "x " * 40, "é$ ü% ||\n\n l\nl\r\nl\n  l", "one two three four", "a b c d e f", "  a b", "p q r s t u p q r s t\x0bz\x0c" * 3]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, "en", 5, "w") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int, stratum string")
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(docs).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [plain(t) for t in TEXTS]


def test_tail(spark):
    cases = [(500, 0), (500, 3), (2000, 9), (100, 1), (40, 0), (3000, 40)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p"))
    for r in df.collect():
        exact = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * 0.01 else 1.0
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_against_sql(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    same(quality.judge(docs, labels), duck(quality.oracle(), SF))
    same(quality.judge(docs, labels, limit=0.2), duck(quality.oracle(limit=0.2), SF))  # enough labels to certify levels


def test_keep_good_agrees_with_judge(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.1/%s.parquet" % t) for t in ("documents", "labels"))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = quality.judge(docs, labels).filter("kept")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in want.collect())
    truth = quality.judge(docs, labels).join(labels, "doc_id")
    good = truth.filter("quality = 1 and not base_failed")
    assert good.filter("not kept").count() <= 0.01 * good.count()
    assert truth.filter("quality = 0 and kept").count() <= 0.6 * truth.filter("quality = 0").count()


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    docs = spark.createDataFrame([(None, None, None), (1, "w " * 3, None), (1, "w " * 3, None)], "doc_id long, text string, lang string")
    assert [r.kept for r in quality.judge(docs, labels).collect()] == [False] * 3
    assert quality.keep_good(docs, labels).count() == 0


def test_a_long_text(spark):
    """A text of 60,000 words, half of it repeated, against the plain counts of its parts."""
    import random

    r = random.Random(2)
    fresh = [f"w{i}" for i in range(40_000)]
    text = " ".join(fresh) + "\n" + " ".join(fresh[:20_000]) + "\n" + "same line\n" * 3 + " ".join(r.choice("ab") for _ in range(3))
    docs = spark.createDataFrame([(1, text, "en"), (2, "short one", "en")], "doc_id long, text string, lang string")
    got = {x.id: x for x in quality.features(docs).collect()}
    words = text.split()
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].n_dup_lines) == (len(words), len(hit), 2)
