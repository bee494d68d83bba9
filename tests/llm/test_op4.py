import random
from fractions import Fraction
from math import ceil, floor

import pytest

import sparkseries.llm.mixing as m


def brute(blocks, weights):
    """Slot by slot earliest deadline first, with a new start whenever a source runs out."""
    left, order = {s: n for s, n in blocks.items() if n}, []
    done = dict.fromkeys(left, 0)
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        w = {s: Fraction(weights[s]) / total for s in left}
        given, t, over = dict.fromkeys(left, 0), 0, False
        while not over:
            ready = [(ceil((given[s] + 1) / w[s]), floor(given[s] / w[s]), s) for s in left if floor(given[s] / w[s]) <= t]
            _, _, s = min(ready)
            order.append((s, done[s]))
            done[s] += 1
            given[s] += 1
            left[s] -= 1
            t += 1
            for x in given:
                assert abs(given[x] - w[x] * t) < 1
            over = left[s] == 0
        left = {s: n for s, n in left.items() if n}
    return order


@pytest.mark.parametrize("seed", range(6))
def test_schedule(seed):
    r = random.Random(seed)
    blocks = {f"s{i}": r.randint(0, 60) for i in range(r.randint(1, 7))}
    weights = {s: r.randint(1, 9) for s in blocks}
    got = []
    for s, i, slot, times, n, cycle, lack in m.phases(blocks, m.whole_weights(weights), 1):
        assert lack == 0
        got += [(slot + k * cycle, s, i + k * n) for k in range(times)]
    got.sort()
    assert [g[0] for g in got] == list(range(sum(blocks.values())))
    assert [(s, i) for _, s, i in got] == brute(blocks, weights)


def test_weights_are_exact():
    fine = {"a": Fraction(1, 3), "b": Fraction(1, 7919), "c": 5}
    whole = m.whole_weights(fine)
    assert all(Fraction(whole[x], whole[y]) == Fraction(fine[x]) / fine[y] for x in fine for y in fine)
    assert m.whole_weights({"a": 0.1, "b": 0.2, "c": 0.7}) == {"a": 1, "b": 2, "c": 7}
    assert m.whole_weights({"a": 123_456_789, "b": 1}) == {"a": 123_456_789, "b": 1}
    # No more slots are walked through than there are blocks, however long a cycle is.
    got = [(s, slot, times) for s, _, slot, times, *_ in m.phases({"a": 50, "b": 50}, {"a": 123_456_789, "b": 1}, 1)]
    assert got == [("a", t, 1) for t in range(50)] + [("b", 50, 50)]


def test_less_than_one_block_at_every_slot():
    """While no source has run out, whatever the weights."""
    weights = m.whole_weights({f"s{i}": w for i, w in enumerate([0.31, 0.17, 5, 1e-3, 2.2, 0.9])})
    total, given = sum(weights.values()), dict.fromkeys(weights, 0)
    order = {}
    for s, _, slot, times, _, cycle, _ in m.phases(dict.fromkeys(weights, 10_000), weights, 1):
        order |= {slot + k * cycle: s for k in range(times)}
    for t in range(min(20_000, len(order))):
        given[order[t]] += 1
        if max(given.values()) == 10_000:
            break
        assert all(abs(given[s] - Fraction(weights[s] * (t + 1), total)) < 1 for s in weights)
    assert t > 10_000


def test_table(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 7)
    r = random.Random(1)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", "", None]), "t", i) for i in range(500)] + [(5, "a", "t", 1)] * 3 + [(None, "b", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")
    got = m.mix_order(docs, weights={"a": 0.5, "b": 0.25}, block=8).collect()
    assert sorted(x.position for x in got) == list(range(len(rows)))
    got.sort(key=lambda x: x.position)
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + 1
    names = {s: "" if s is None else f"={s}" for s in sizes}
    want = brute({names[s]: ceil(n / 8) for s, n in sizes.items()}, {"=a": 4, "=b": 2, "": 3, "=": 3, "=c": 3})
    seen = list(dict.fromkeys((names[x.source], x.block) for x in got))
    assert seen == want and [x.slot for x in got] == sorted(x.slot for x in got)
    out = m.mixed(docs, weights={"a": 0.5, "b": 0.25}, block=8)
    assert {x.source for x in got} == {"a", "b", "c", "", None} and sorted((x.doc_id or -1, x.source or "") for x in got) == sorted((x[0] or -1, x[1] or "") for x in rows)
    assert out.columns == docs.columns and [x.source for x in out.collect()] == [x.source for x in got]


def test_odd_cases(spark):
    none = spark.createDataFrame([], "doc_id long, source string")
    assert m.mix_order(none).count() == 0 and m.mixed(none).count() == 0
    with pytest.raises(ValueError):
        m.whole_weights({"a": 0.0})


def test_whole_table(spark):
    """The query's weights on the whole table, against slot-by-slot scheduling of its sources."""
    import sparkseries.llm.queries as queries

    got = sorted(queries.op4_mixing(spark, "/root/testdata/sf0.1").collect(), key=lambda x: x.position)
    assert [x.position for x in got] == list(range(10_000))
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + 1
    weights = queries.TARGET_WEIGHTS
    assert len({weights[s] for s in sizes}) > 3
    want = brute({s: ceil(n / m.BLOCK) for s, n in sizes.items()}, weights)
    assert list(dict.fromkeys((x.source, x.block) for x in got)) == want


def test_many_sources_and_a_map_column(spark):
    """1,500 sources of one to four rows, null ids, and a column that cannot be hashed."""
    rows = [(None if i % 3 else i, f"s{i * 7919 % 1500}", {"a": i}) for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, m map<string, int>")
    got = m.mix_order(docs, block=2)
    assert sorted(r.position for r in got.select("position").collect()) == list(range(4_000))
    out = m.mixed(docs, weights={"s3": 5, "s4": Fraction(7, 3)}, block=2)
    assert out.columns == docs.columns and sorted(x.m["a"] for x in out.collect()) == list(range(4_000))
