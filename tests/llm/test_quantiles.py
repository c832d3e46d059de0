import math
import random

from pyspark.sql import functions as F

from phylospark.llm.quantiles import combine, percentiles, value_counts

PS = [0, 1, 250, 500, 999, 1000]


def plain(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(len(v) * p / 1000 - 1e-9)) - 1]


def expected(rows):
    by = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            by.setdefault(g, []).append(v)
    return {(g, p): (len(v), plain(v, p)) for g, v in by.items() for p in PS}


def test_exact_and_combined(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), rng.choice([None, math.nan, math.inf, -0.0, 0.0, *map(float, range(-40, 60))])) for _ in range(900)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit("clash")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        half = F.rand(3) < 0.5
        df = df.withColumn("h", half).cache()
        both = combine(value_counts(df.filter("h"), ["g"], "v"), value_counts(df.filter("not h"), ["g"], "v"))
        got = {(r.g, r.per_mille): (r.n_values, r.value) for r in percentiles(both, PS).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
        df.unpersist()
    assert got == expected(rows)
    assert percentiles(value_counts(df.limit(0), ["g"], "v"), PS).count() == 0


def test_error_of_bins(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 50)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = expected(rows)
    got = percentiles(value_counts(df, ["g"], "v", 0.5), PS).collect()
    assert len(got) == len(PS) and all(abs(r.value - want["a", r.per_mille][1]) <= 0.25 + 1e-9 for r in got)
