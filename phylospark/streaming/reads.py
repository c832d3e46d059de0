"""Read summaries over reads that keep arriving: the batch operators' sums are all associative, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.operators import genomics


def read_stream(spark: SparkSession, folder: str, schema: str = "path string, seq string, qual string") -> DataFrame:
    """Reads from Parquet files that are put into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def summary_stream(reads: DataFrame) -> DataFrame:
    """`genomics.read_summary` of all reads so far; write it in complete or update mode."""
    return genomics.read_summary(reads)


def windowed_counts(reads: DataFrame, at: str, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Reads and bases by path and window of time, in append mode; rows later than `late` are left out."""
    rows = reads.withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("window"), "path").agg(F.count("*").alias("read_count"), F.sum(F.length("seq")).alias("base_count"))
