import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phylospark.llm.packing import fills, pack, pack_all, plan


def contents(counts, capacity):
    """Sizes in each container, by the steps' ranks."""
    steps, made = plan(counts, capacity)
    by = {}
    for s, r, first, each in steps:
        by.setdefault(s, []).append((r, first, each))
    boxes = [[] for _ in range(made)]
    for s, n in counts.items():
        rows = sorted(by[s])
        assert rows[0][0] == 0
        for k, (r, first, each) in enumerate(rows):
            for x in range(r, rows[k + 1][0] if k + 1 < len(rows) else n):
                boxes[first + (x - r) // each].append(s)
    return boxes


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 40)))))
def test_plan(case):
    capacity, counts = case
    boxes = contents(counts, capacity)
    assert all(b and sum(b) <= capacity for b in boxes)
    assert all(sum(3 * s > capacity for s in b) <= 2 for b in boxes)
    assert sum(map(len, boxes)) == sum(counts.values())
    # no packing needs fewer: the total size; items above a half are alone; those above a third at most two
    least = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity), -(-sum(n for s, n in counts.items() if 3 * s > capacity) // 2))
    assert least <= len(boxes) <= least * 1.5 + 1


def test_little_is_left_free():
    rng = random.Random(1)
    counts = {}
    for _ in range(20_000):
        s = min(1024, max(1, int(rng.lognormvariate(4, 1))))
        counts[s] = counts.get(s, 0) + 1
    boxes = contents(counts, 1024)
    assert sum(map(sum, boxes)) / (1024 * len(boxes)) > 0.999


def test_pack(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([None, 0, 5, 5, 5, 7, 10, 11, 25, 1000, rng.randint(1, 12)])) for i in range(400)]
    df = spark.createDataFrame(sizes, "doc long, tokens int").withColumn("size", F.lit("clash"))
    got = pack(df, "doc", "tokens", 10).collect()
    by = {}
    for r in got:
        by.setdefault(r["item"], []).append((r.piece, r["size"]))
    assert set(by) == {d for d, s in sizes if s is not None}
    for d, s in sizes:
        if s is not None:
            pieces = [x for _, x in sorted(by[d])]
            assert sum(pieces) == s and len(pieces) == max(1, -(-s // 10)) and all(x == 10 for x in pieces[:-1])
    used = {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r["size"]
    assert max(used.values()) <= 10 and sorted(used) == list(range(len(used)))
    assert {r.container_id: r.used for r in fills(pack(df, "doc", "tokens", 10), 10).collect()} == used


def test_edges(spark):
    empty = spark.createDataFrame([], "doc long, tokens int")
    assert pack(empty, "doc", "tokens", 10).count() == 0
    zero = spark.createDataFrame([(1, 0), (2, 0)], "doc long, tokens int")
    assert [(r.container_id, r["size"]) for r in pack(zero, "doc", "tokens", 10).collect()] == [(0, 0), (0, 0)]
    with pytest.raises(Exception, match="negative"):
        pack(spark.createDataFrame([(1, -1)], "doc long, tokens int"), "doc", "tokens", 10).count()


def test_many_capacities(spark, monkeypatch):
    """More capacities than go in one pass, from one sort of the items: each as if it were alone."""
    from phylospark.llm import packing

    rng = random.Random(7)
    df = spark.createDataFrame([(i, rng.choice([0, 3, 3, 8, 21, rng.randint(1, 40)])) for i in range(300)], "doc long, tokens int")
    packs = [(f"p{c}", c) for c in range(1, 31)]
    one_pass = {tuple(r) for r in pack_all(df, "doc", "tokens", packs).collect()}
    monkeypatch.setattr(packing, "SENT_SIZES", 100)
    got = [tuple(r) for r in pack_all(df, "doc", "tokens", packs).collect()]
    assert len(got) == len(one_pass) and set(got) == one_pass
    for name, cap in packs[::6]:
        boxes, items = {}, {}
        for _, _, doc, piece, size, box in (r for r in got if r[0] == name):
            boxes[box] = boxes.get(box, 0) + size
            items[doc] = items.get(doc, 0) + size
        assert len(items) == 300 and max(boxes.values()) <= cap and sorted(boxes) == list(range(len(boxes)))
        assert items == {r.doc: r.tokens for r in df.collect()}
    assert pack_all(df, "doc", "tokens", []).count() == 0
