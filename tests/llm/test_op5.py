import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import sparkseries.llm.simhash as m


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(prints, radius=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def ball(r, n, centres, flips):
    base = [r.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = r.choice(base)
        for _ in range(r.randint(0, flips)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint(text):
    assert m.fingerprint(text) == plain_fingerprint(text)


def test_bucket_join_equals_all_pairs(monkeypatch):
    r = random.Random(3)
    for n, c, f, fan, step in [(300, 5, 9, 16, 1 << 19), (800, 40, 7, 4, 999), (500, 500, 3, 16, 1 << 12), (2, 1, 1, 16, 9), (700, 1, 4, 8, 5000)]:
        monkeypatch.setattr(m, "FAN", fan)
        monkeypatch.setattr(m, "STEP", step)
        prints = ball(r, n, c, f)
        got = m.link_bucket(np.array(prints, np.uint64))
        want = plain_classes(prints)
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_linking_with_and_without_crowded_buckets(spark, monkeypatch):
    prints = ball(random.Random(8), 900, 30, 10)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = plain_classes(prints)
    for crowd in (m.CROWD, 20):
        monkeypatch.setattr(m, "CROWD", crowd)
        got = {r.node: r.root for r in m.link_fingerprints(table).collect()}
        roots = [got.get(p - (1 << 64) if p >> 63 else p, p - (1 << 64) if p >> 63 else p) for p in prints]
        assert len(set(zip(roots, want))) == len(set(want)) == len(set(roots))


def test_documents(spark):
    r = random.Random(1)
    prose = lambda n: " ".join(r.choice("abcdefghij") * r.randint(1, 5) for _ in range(n))
    texts = [None, "", " \t", "One two", prose(3000)]
    for _ in range(8):
        base = prose(300).split()
        for _ in range(r.randint(1, 4)):
            w = list(base)
            w[r.randrange(300)] = "Changed"
            texts.append(" ".join(w))
    texts.append(texts[-1])
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, fp long, component_id string")
    got = {x.doc_id: x for x in m.near_duplicate_classes(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    want = plain_classes(prints)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = m.keep_one_of_each(docs)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_empty_and_null_ids(spark):
    assert m.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (None, "q")], "doc_id long, text string")
    assert sorted((x.doc_id is None, x.component_id) for x in m.near_duplicate_classes(docs).collect() if x.component_id is not None) == [(False, 4), (True, 4), (True, 4)]
    assert m.keep_one_of_each(docs).count() == 4
