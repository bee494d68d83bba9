import random

import sparkseries.llm.decontaminate as m
from tests.llm.util import duck, same

SF = "/root/testdata/sf0.01"


def brute(docs, items, t=0.8):
    united = {}
    for i, x in items:
        n = len((x or "").encode().split())
        if i is not None and n:
            united.setdefault(i, set()).update((min(5, n), s) for s in m.shingles(x, min(5, n)))
    out = set()
    sizes = {n for want in united.values() for n, _ in want}
    for d, x in docs:
        own = {(n, s) for n in sizes for s in m.shingles(x, n)}
        for i, want in united.items():
            have = len(want & own)
            if have >= t * len(want) - 1e-9:
                out.add((d, i, len(want), have))
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    prose = lambda n: " ".join(r.choice(["Aa", "b", "cé", "d", "ee", "f", "g", "h"]) for _ in range(n))
    items = [(i, prose(r.choice([1, 3, 5, 9, 20, 60]))) for i in range(25)] + [(None, "x y"), (30, None), (31, " "), (0, "zz y x w v")]
    docs = [(i, prose(r.randint(0, 50))) for i in range(30)] + [(40, None), (41, "")]
    for j in range(25):
        words = items[j][1].split()
        if j % 2 and len(words) > 8:
            words[len(words) // 2] = "other"
        docs.append((50 + j, prose(5) + "\n" + " ".join(words).lower() + "\t" + prose(300)))
    df = spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.n_item_shingles, x.n_found) for x in m.find_leaks(df, bench).collect()}
    assert got == brute(docs, items)
    kept = m.drop_leaking(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {g[0] for g in got}


def test_against_sql(spark):
    same(m.find_leaks(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")), duck(m.oracle(), SF))


def test_candidates_come_from_signatures(spark):
    """No leak is lost, and far fewer pairs are verified than share a shingle."""
    r = random.Random(5)
    common = [" ".join(r.choice("abcdefgh") * 3 for _ in range(9)) for _ in range(6)]
    words = lambda n: " ".join("".join(r.choice("mnopqrst") for _ in range(5)) for _ in range(n))
    items = [(i, f"{words(20)} {common[i % 6]} {words(20)}") for i in range(60)]
    docs = [(i, f"{words(50)} {common[i % 6]} {words(50)} {items[i % 60][1] if i % 4 == 0 else ''}") for i in range(400)]
    index = m._index(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 0.8)
    per_item = {}
    for x in index.collect():
        per_item.setdefault(x.item_id, []).append(x)
    for xs in per_item.values():
        assert sum(x.signature for x in xs) == xs[0].q - xs[0].need + min(2, xs[0].need) < xs[0].q
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = {s for xs in per_item.values() for s in (bytes(x.shingle) for x in xs)}
    rows = [(str(d), 5, m.xxhash.xxh64_intdigest(s) - (1 << 64 if m.xxhash.xxh64_intdigest(s) >> 63 else 0), bytearray(s)) for d, t in docs for s in m.shingles(t) if s in known]
    found = spark.createDataFrame(rows, "id string, size int, h long, shingle binary")
    candidates = {(x.id, x.item_id) for x in m._candidates(found, index).collect()}
    sharing = found.join(index, ["size", "h", "shingle"]).select("id", "item_id").distinct().count()
    want = brute(docs, items)
    assert {(str(d), i) for d, i, _, _ in want} <= candidates and len(want) == 100
    assert len(candidates) < sharing / 3
    assert {(x.doc_id, x.item_id, x.n_item_shingles, x.n_found) for x in m.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == want


def test_empty_tables_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert m.find_leaks(none, bench).count() == 0
    docs = spark.createDataFrame([(None, "x a b c d e f g"), (None, "x a b c d e f g"), (3, "q")], "doc_id long, text string")
    assert [tuple(x) for x in m.find_leaks(docs, bench).collect()] == [(None, 1, 3, 3, 1.0)]
    assert m.find_leaks(docs, bench.limit(0)).count() == 0
    assert [x.doc_id for x in m.drop_leaking(docs, bench).collect()] == [3]


def test_a_short_item_in_a_long_text(spark):
    r = random.Random(3)
    item = " ".join(f"i{k}" for k in range(30))
    words = [f"w{r.randrange(50_000)}" for _ in range(300_000)]
    long = " ".join(words[:200_000] + item.split() + words[200_000:])
    docs = spark.createDataFrame([(1, long), (2, " ".join(words)), (3, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((x.doc_id, x.n_found) for x in m.find_leaks(docs, bench).collect()) == [(1, 26), (3, 26)]
    assert [x.doc_id for x in m.drop_leaking(docs, bench).collect()] == [2]
