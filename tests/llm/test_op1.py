import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkseries.llm.suffix_dedup import oracle, remove_repeated_substrings, repeated_windows, runs
from tests.llm.util import duck, same


def brute(texts, length):
    seen = {}
    bodies = [(t or "").encode() for t in texts]
    for i, b in enumerate(bodies):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((i, s))
    flags = [bytearray(len(b)) for b in bodies]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                flags[i][s : s + length] = b"\1" * length
    out = []
    for b, f in zip(bodies, flags):
        kept = bytes(x for x, y in zip(b, f) if not y)
        spans = sum(1 for j, y in enumerate(f) if y and (j == 0 or not f[j - 1]))
        out.append((len(b), sum(f), spans, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(2, 9))
def test_interval_expansion_equals_brute_force(texts, length):
    texts = [t.encode() for t in texts]
    count = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            count[t[s : s + length]] = count.get(t[s : s + length], 0) + 1
    got = repeated_windows(texts, [1] * len(texts), length)
    for t, g in zip(texts, got):
        assert g.tolist() == [count[t[s : s + length]] > 1 for s in range(len(t) - length + 1)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 168), st.integers(1, 169), st.sampled_from([24, 4, 1, 169]))
def test_runs_share_their_bytes(p, n, width):
    """Runs partition the windows, and each window holds the bytes of its run; they depend on offsets to the anchor only."""
    n = min(n, p + 1)
    seen = []
    for c, i0, k, lo, hi in runs(p, n, width):
        assert k > 0 and lo == p - c * width and hi - lo == 201 - width
        for i in range(i0, i0 + k):
            assert i <= lo < hi <= i + 200 and (p - i) // width == c
        seen += range(i0, i0 + k)
    assert sorted(seen) == list(range(n))


def test_texts_longer_than_a_piece(spark):
    """Repeats inside and across pieces of long texts, against windows counted by their bytes."""
    r = random.Random(9)
    line = "".join(r.choice("abcdef") for _ in range(230))
    filler = lambda n: "".join(r.choices("ghijklmnop", k=n))
    texts = [f"{filler((1 << 20) - 100)}1{line}2{filler(5_000)}3{line}", f"{filler(3_000)}4{line}5{filler(10)}", filler(1_100_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in remove_repeated_substrings(docs).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(3)] == [(460, 2), (230, 1), (0, 0)]
    kept = [t.replace(line, "") for t in texts]
    assert [got[i].kept_sha256 for i in range(3)] == [hashlib.sha256(t.encode()).hexdigest() for t in kept]


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdéß") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(70) for _ in range(4)]
    line = prose(22)
    texts = [None, "", "x", "a" * 700, "a" * 230, prose(90)]
    for i in range(60):
        t = prose(r.randint(5, 120))
        if i % 3 == 0:
            t += shared[i % 4][r.randint(0, 20) :] + prose(20)
        if i % 4 == 0:
            t = prose(3) + line + t
        texts.append(t)
    texts += [texts[20], texts[20], texts[20][40:], texts[30] + texts[31], prose(20) * 9]
    return texts


def test_whole_operator(spark, monkeypatch):
    import sparkseries.llm.suffix_dedup as m

    texts = corpus()
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, tk long, body string")
    want = brute(texts, 200)
    for group in (m.GROUP, 700, 0):  # small groups send the common line, or everything, down to finer runs
        monkeypatch.setattr(m, "GROUP", group)
        got = {r.doc_id: tuple(r)[1:] for r in remove_repeated_substrings(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_empty_table_and_null_ids(spark):
    assert remove_repeated_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = remove_repeated_substrings(spark.createDataFrame([(None, "b" * 250), (None, "b" * 250)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_removed) for r in rows] == [(None, 250)] * 2


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(remove_repeated_substrings(spark.read.parquet(f"{sf}/documents.parquet")), duck(oracle(), sf))
