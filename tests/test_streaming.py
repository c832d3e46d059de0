import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from phylospark.operators.genomics import read_summary
from phylospark.operators.intervals import Maps, merge
from phylospark.streaming.intervals import merged, packed, unpacked
from phylospark.streaming.reads import read_stream, summary_stream, windowed_counts


def test_interval_state(spark, tmp_path):
    """Several files, one a micro-batch: the state ends as the batch operator's result, with an entity in one shard or in several; null and '' are two entities."""
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", "b", None, ""]), s := rng.randint(1, 300), s + rng.choice([-2, 0, 4, 30])) for _ in range(120)] + [("a", None, 3)]
    df = spark.createDataFrame(data, "e string, s long, t long")
    for k in range(3):
        df.filter(F.pmod(F.hash("s", "t"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in merge(df, ["e"], "s", "t").collect()}
    assert {r[0] for r in want} == {"a", "b", None, ""}
    for rows in (1000, 15):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = [tuple(r) for r in merged(stream, df, ["e"], "s", "t", shard_rows=rows).collect()]
        assert len(got) == len(want) and set(got) == want


def test_packed():
    m = Maps()
    m.insert([pa.array(["x", None, "", "é", "x"])], np.array([1, 5, 2, 0, 9]), np.array([3, 6, 2, 0, 9]))
    back = unpacked(packed(m))
    assert {k: v.periods() for k, v in back.by.items()} == {("x",): [(1, 3), (9, 9)], (None,): [(5, 6)], ("",): [(2, 2)], ("é",): [(0, 0)]}
    assert unpacked(packed(Maps())).by == {}


def test_read_streams(spark, tmp_path):
    data = [("p1", "ACGN", "IIII", "2024-01-01 00:10:00"), ("p1", "AC", "!I", "2024-01-01 00:50:00"), ("p2", "", "", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(data, "path string, seq string, qual string, at string").withColumn("at", F.to_timestamp("at"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    q = summary_stream(read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sums").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    cols = sorted(read_summary(df).columns)
    assert sorted(map(tuple, spark.sql("select * from sums").select(cols).collect())) == sorted(map(tuple, read_summary(df).select(cols).collect()))
    stream = read_stream(spark, str(tmp_path / "in"), "path string, seq string, qual string, at timestamp")
    q = windowed_counts(stream, "at").writeStream.format("memory").queryName("win").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.path, r.read_count, r.base_count) for r in spark.sql("select * from win").collect()] == [("p1", 2, 6)]
