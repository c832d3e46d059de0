import random

from pyspark.sql import functions as F

from phylospark.operators.bitmaps import may_hold


def test_nothing_is_lost(spark):
    rng = random.Random(1)
    known = [rng.randint(-(2**63), 2**63 - 1) for _ in range(300)]
    other = [rng.randint(-(2**63), 2**63 - 1) for _ in range(3000)]
    held = may_hold(spark.createDataFrame([(x,) for x in known], "h long"), "h", 16)
    df = spark.createDataFrame([(x, True) for x in known] + [(x, False) for x in other], "h long, inside boolean").filter(held(F.col("h")))
    assert df.filter("inside").count() == 300 and df.filter("not inside").count() < 100
    empty = may_hold(spark.createDataFrame([], "h long"), "h", 16)
    assert spark.createDataFrame([(1,)], "h long").filter(empty(F.col("h"))).count() == 0
