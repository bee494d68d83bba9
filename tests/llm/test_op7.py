import random
import zlib

import numpy as np
import pytest

import sparkseries.llm.sharding as m


def brute_capacity(sizes, shards):
    """Least possible largest run, by dynamic programming."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = ends.astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[i], ends[j] - ends[i]) for i in range(j + 1)) for j in range(len(ends))])
    return int(best[-1])


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_whole_search(seed):
    r = random.Random(seed)
    shards = r.randint(1, 8)
    buckets, detail, flat = [], {}, []
    for b in range(r.randint(1, 30)):
        sizes = [r.choice([1, 2, 3, r.randint(1, 50), r.randint(1, 900) if r.random() < 0.05 else 4]) for _ in range(r.randint(1, 9))]
        buckets.append((b, sum(sizes), max(sizes)))
        detail[b] = sizes
        flat += sizes
    asked = []
    cuts = m.plan_cuts(buckets, lambda w: (asked.extend(w), {b: detail[b] for b in w})[1], shards)
    flat = np.array(flat)
    want = m.smallest_capacity(flat, shards)
    assert want == brute_capacity(flat, shards)
    ends = np.concatenate([[0], np.cumsum(flat)])
    assert cuts == [int(ends[s]) for s in m.greedy(flat, want)]


@pytest.mark.parametrize("seed", range(40))
def test_plan_through_ranges(seed):
    """Two levels and one read at a time give the same cuts."""
    r = random.Random(seed)
    shards = r.randint(1, 8)
    ranges, inner, flat = [], {}, []
    for a in range(r.randint(1, 6)):
        below = []
        for b in range(r.randint(1, 6)):
            sizes = [r.choice([1, 2, 3, r.randint(1, 50), r.randint(1, 2000) if r.random() < 0.05 else 4]) for _ in range(r.randint(1, 9))]
            inner["b", a, b] = sizes
            below.append((("b", a, b), sum(sizes)))
            flat += sizes
        inner["r", a] = below
        ranges.append((("r", a), sum(x for _, x in below), max(max(inner[k]) for k, _ in below)))
    cuts = m.plan_cuts(ranges, lambda w: {k: inner[k] for k in w}, shards)
    ends = np.concatenate([[0], np.cumsum(flat)])
    assert cuts == [int(ends[s]) for s in m.greedy(np.array(flat), m.smallest_capacity(np.array(flat), shards))]


@pytest.mark.parametrize("large", [0.0, 0.01, 0.05, 0.2, 0.5])
def test_few_groups_reach_the_driver(large):
    """Of two million groups in 2,000 buckets, however large the largest of them."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 4_000, 2_000_000)
    hot = [777_777, 1_200_345]
    for h in hot:
        sizes[h] = max(1, int(sizes.sum() * large / 2))
    each = 1_000
    table = sizes.reshape(-1, each)
    fetched = []

    def fetch(wanted):
        fetched.extend(wanted)
        return {b: table[b].tolist() for b in wanted}

    cuts = m.plan_cuts([(b, int(x.sum()), int(x.max())) for b, x in enumerate(table)], fetch, 16)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    assert cuts == [int(ends[s]) for s in m.greedy(sizes, m.smallest_capacity(sizes, 16))]
    assert len(fetched) == len(set(fetched)) <= 300


def test_copies_without_ids(spark, monkeypatch):
    """A third of the rows are one text with null ids; they are numbered in many parts."""
    monkeypatch.setattr(m, "PART_BITS", 4)
    docs = spark.range(3000).selectExpr("case when id % 3 = 0 then null else id end as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end as text")
    got = m.shard_by_bytes(docs).collect()
    place = {}
    for x in got:
        place.setdefault(x.shard, []).append(x.slot)
    assert sum(map(len, place.values())) == 3000 and all(sorted(v) == list(range(len(v))) for v in place.values())
    assert len({x.shard for x in got if x.doc_id is None}) == 1


@pytest.mark.parametrize("bucket_groups", [3, 4096])
def test_table(spark, monkeypatch, bucket_groups):
    monkeypatch.setattr(m, "BUCKET_GROUPS", bucket_groups)
    monkeypatch.setattr(m, "RANGE_BITS", 2)
    r = random.Random(4)
    texts = [None, "", "é€"] + ["x" * r.randint(0, 90) + str(i) for i in range(300)]
    texts += [texts[9]] * 60 + [texts[20]] * 3 + [None]
    docs = spark.createDataFrame([(i if i % 50 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    got = m.shard_by_bytes(docs).collect()
    assert len(got) == len(texts)
    assert sorted((x.doc_id or -1, x.size, x.text_crc32) for x in got) == sorted((i if i % 50 and i else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    place, groups = {}, {}
    for x in got:
        place.setdefault(x.shard, []).append(x.slot)
        groups.setdefault((x.text_crc32, x.size), set()).add(x.shard)
    assert all(sorted(v) == list(range(len(v))) for v in place.values()) and all(len(g) == 1 for g in groups.values())
    load = {}
    for x in got:
        load[x.shard] = load.get(x.shard, 0) + x.size
    order = {}
    for x in sorted(got, key=lambda x: (x.shard, x.slot)):
        order[(x.text_crc32, x.size)] = order.get((x.text_crc32, x.size), 0) + x.size
    assert max(load.values()) == m.smallest_capacity(np.array(list(order.values())), 16)


def test_empty(spark):
    assert m.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = m.shard_by_bytes(spark.createDataFrame([(7, "a")], "doc_id long, text string")).collect()
    assert [(x.shard, x.slot, x.law, x.grown_shard) for x in one] == [(0, 0, "bytes", None)]


def test_a_text_larger_than_a_shard(spark):
    """One text holds most of the bytes: it has a shard for itself and the others stay near equal."""
    docs = spark.range(400).selectExpr("id as doc_id", "case when id = 7 then repeat('é', 500000) else concat('text ', id) end as text")
    got = m.shard_by_bytes(docs).collect()
    large = next(x for x in got if x.doc_id == 7)
    assert large.size == 1_000_001 and large.text_crc32 == zlib.crc32(("é" * 500_000).encode())
    load = {}
    for x in got:
        load[x.shard] = load.get(x.shard, 0) + x.size
    assert max(load.values()) == m.smallest_capacity(np.array([x.size for x in sorted(got, key=lambda x: (x.shard, x.slot))]), 16)
