import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phylospark.operators.intervals import IntervalMap, disjoint, merge


def plain(pairs):
    covered = sorted({p for s, e in pairs for p in range(s, e + 1)})
    periods = []
    for p in covered:
        if periods and periods[-1][1] == p - 1:
            periods[-1][1] = p
        else:
            periods.append([p, p])
    periods = [tuple(x) for x in periods]
    return periods, [(a[1] + 1, b[0] - 1) for a, b in zip(periods, periods[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 60), st.integers(0, 9))))
def test_map(items):
    pairs = [(s, s + n) for s, n in items]
    m = IntervalMap()
    for s, e in pairs:
        low, high = m.insert(s, e)
        assert low <= s and high >= e
    assert (m.periods(), m.gaps()) == plain(pairs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-30, 60), st.integers(0, 9))))
def test_disjoint(items):
    code, start, end = disjoint(*(np.array(x, dtype=np.int64) for x in ([k for k, _, _ in items], [s for _, s, _ in items], [s + n for _, s, n in items])))
    for k in range(3):
        mine = code == k
        assert list(zip(start[mine].tolist(), end[mine].tolist())) == plain([(s, s + n) for c, s, n in items if c == k])[0]


def test_disjoint_far():
    low, high = -(2**63), 2**63 - 1
    code, start, end = disjoint(np.zeros(3, dtype=np.int64), np.array([low, high - 1, 5]), np.array([low, high, 6]))
    assert list(zip(start.tolist(), end.tolist())) == [(low, low), (5, 6), (high - 1, high)]


def expected(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and s <= e:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, pairs in by.items():
        periods, gaps = plain(pairs)
        out |= {(k, "period", *p) for p in periods} | {(k, "gap", *g) for g in gaps}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge(spark, seed):
    """Several partitions, a hot entity in most of them, long intervals over all of them, nulls, inverted and repeated rows."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), s := rng.choice([None, *range(1, 3000)] if seed % 2 else range(1, 400)), None if s is None else s + rng.choice([-1, 0, 3, 5, rng.choice([5, 900])])) for _ in range(700)]
    rows += rows[:50]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", seed == 3)
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        df = spark.createDataFrame(rows, "chrom string, s long, e long").repartition(5).withColumn("kind", df_lit())
        got = [tuple(r) for r in merge(df, ["chrom"], "s", "e", shard_rows=[40, 200, 1000, 100][seed]).collect()]
        assert len(got) == len(set(got)) and set(got) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("a column that clashes")


def test_empty(spark):
    assert merge(spark.createDataFrame([], "k string, s long, e long"), ["k"], "s", "e").collect() == []
