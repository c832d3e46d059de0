import random

import pytest
from pyspark.sql import functions as F

from phylospark.operators.ranges import join_skewed, previous, running_sum


@pytest.mark.parametrize("total", [None, "whole"])
def test_running_sum(spark, total):
    """A hot group over several partitions, a null group, null values."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, *range(5)]), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, v long, _sum string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r.i: (r.running, r.whole if total else None) for r in running_sum(df, ["g"], ["i"], "v", total=total).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    want, sums = {}, {}
    for i, g, v, _ in rows:
        sums[g] = sums.get(g, 0) + (v or 0)
        want[i] = sums[g]
    assert {i: x for i, (x, _) in got.items()} == want
    assert not total or all(got[i][1] == sums[g] for i, g, _, _ in rows)
    assert running_sum(df.limit(0), ["g"], ["i"], "v").count() == 0


def test_previous(spark):
    """The row before in each group, over range borders; nulls stay nulls and are values of their own."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, *range(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g string, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r.i: r.before for r in previous(df, ["g"], ["i"], "v", "before").collect()}
        whole = {r.i: r.before for r in previous(df, [], ["i"], "v", "before").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    want, last = {}, {}
    for i, g, v in rows:
        want[i] = last.get(g)
        last[g] = v
    assert got == want and whole == {0: None} | {i: rows[i - 1][2] for i in range(1, 400)}


@pytest.mark.parametrize("small, hot", [(True, 1000), (False, 1000), (False, 20)])
def test_join_skewed(spark, small, hot):
    left = [(i, "hot" if i % 3 else f"k{i % 7}" if i % 2 else None) for i in range(200)]
    right = [("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("other", 5)]
    a, b = spark.createDataFrame(left, "i long, k string"), spark.createDataFrame(right, "r string, v long")
    run = lambda how, **more: sorted(map(tuple, join_skewed(a, "k", b, "r", how, small=small, hot_rows=hot, **more).collect()))
    assert run("inner") == sorted((i, k, v) for i, k in left for r, v in right if k is not None and k == r)
    keys = {"hot", "k1"}
    assert run("left_semi") == sorted((i, k) for i, k in left if k in keys)
    assert [i for i, _ in join_skewed(a, "k", b, "r", "left_anti", small=small, hot_rows=hot).orderBy("i").collect()] == [i for i, k in left if k not in keys]
    assert run("left_semi", fits=F.col("v") == 3) == sorted((i, k) for i, k in left if k == "k1")
