import random

import pytest

from phylospark.llm.mixing import mix


def test_shares(spark):
    """A source of most rows, a scarce one, one without records, one without a target; null sources and sizes; size 0."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "other", "untargeted", None]), rng.choice([None, 0, *range(1, 40)])) for i in range(3000)]
    targets = [("m", "big", 0.5, 2), ("m", "small", 0.3, 3), ("m", "other", 0.2, 4), ("v", "big", 0.5, 2), ("v", "void", 0.5, 2), ("z", "void", 1.0, 1), ("z", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "doc long, src string, tokens int").repartition(5)
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        draws, report = mix(df, "doc", "src", "tokens", t)
        draws, report = draws.collect(), report.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    size = {i: s for i, _, s in rows}
    src = {i: x for i, x, _ in rows}
    most = {(m, s): r for m, s, _, r in targets}
    seen = set()
    sums = {}
    for d in draws:
        assert (d.mix_name, d.record) not in seen and 1 <= d.n_uses <= most[d.mix_name, d.source] and src[d.record] == d.source and size[d.record] == d.size
        seen.add((d.mix_name, d.record))
        sums[d.mix_name, d.source] = sums.get((d.mix_name, d.source), 0) + d.n_uses * d.size
    for r in report:
        assert r.drawn == sums.get((r.mix_name, r.source), 0) and abs(r.drawn - r.budget) <= 20
        if r.mix_name == "m":
            assert r.actual_share == pytest.approx(r.target_share, abs=0.01)
    assert len(report) == 6
    # the limiting source is used up
    assert any(r.mix_name == "m" and r.drawn == r.available * r.max_repeats for r in report)


def test_given_total_and_empty(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b", 10) for i in range(100)], "doc long, src string, tokens int")
    t = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    _, report = mix(df, "doc", "src", "tokens", t, total=1000)
    got = {r.source: (r.drawn, r.max_uses) for r in report.collect()}
    assert got == {"a": (500, 1), "b": (200, 2)}
    draws, report = mix(df.limit(0), "doc", "src", "tokens", t)
    assert draws.count() == 0 and {r.drawn for r in report.collect()} == {0}


def test_draw_is_random_but_fixed(spark):
    df = spark.createDataFrame([(i, "a" if i < 500 else "b", 10) for i in range(600)], "doc long, src string, tokens int")
    t = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    one = lambda seed: {r.record for r in mix(df.repartition(3), "doc", "src", "tokens", t, seed=seed)[0].collect() if r.source == "a"}
    first = one(0)
    assert first == one(0) and first != one(1) and len(first) == 100 and 30 < sum(i < 250 for i in first) < 70


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 5, 1, "x") for i in range(40)], "doc long, src string, tokens int, budget int, source string")
    t = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    draws, _ = mix(df, "doc", "src", "tokens", t)
    assert draws.count() == 40


def test_many_targets(spark):
    """More targets than are sent to all executors: the same draws, with the hot source spread."""
    df = spark.createDataFrame([(i, "a" if i % 4 else "b", 1 + i % 9) for i in range(400)], "doc long, src string, tokens int")
    t = spark.createDataFrame([(f"m{k}", s, x, 2) for k in range(6) for s, x in (("a", 0.3 + k / 20), ("b", 0.7 - k / 20))], "mix_name string, source string, target_share double, max_repeats int")
    want = {tuple(r) for r in mix(df, "doc", "src", "tokens", t)[0].collect()}
    draws, report = mix(df, "doc", "src", "tokens", t, sent=3, hot_rows=50)
    got = [tuple(r) for r in draws.collect()]
    assert len(got) == len(want) and set(got) == want and report.count() == 12
