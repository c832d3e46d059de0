"""Percentiles per group from mergeable value counts, by cumulative frequencies.

`value_counts` reduces rows to counts by group and value, where values may be put into bins of a fixed width: the stated error.
Counts of separate partitions or days are combined by adding them up. `percentiles` sorts the counts by range, adds up
running sums within partitions and the offsets of the partitions before, and takes the first value whose running count reaches
each rank. A group of any size is spread over many partitions; nothing is collected.

The p-th percentile is the smallest value for which at least p of the group's values are not larger: rank ceil(n * p), at least 1,
and 1 for p = 0. Error: with width None the result is exactly one of the values; else it is at most width / 2 from that value.

Defined results: null and NaN values are left out; infinite values are values (they go into no bin and stay exact); a group
without values has no row; a null group is a group of its own; ties and repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.operators.ranges import running_sum


def value_counts(df: DataFrame, groups: list[str], value: str, width: float | None = None) -> DataFrame:
    """Groups, value (double) and n. width: the values of a bin count as its middle."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v))
    inf = F.lit(float("inf"))
    if width is not None:
        per = round(1 / width)
        if abs(per * width - 1) > 1e-9:
            raise ValueError("1 / width must be a whole number")
        v = F.when((v < inf) & (v > -inf), (F.floor(v * F.lit(float(per))).cast("double") + 0.5) / F.lit(float(per))).otherwise(v)
    v = F.when(v == 0, F.lit(0.0)).otherwise(v)  # -0.0 is 0.0
    return rows.select(*groups, v.alias("value")).groupBy(*groups, "value").agg(F.count("*").alias("n"))


def combine(*counts: DataFrame) -> DataFrame:
    """Counts of separate parts as one."""
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.groupBy(*[c for c in every.columns if c != "n"]).agg(F.sum("n").alias("n"))


def rank(n: Column, per_mille: Column) -> Column:
    """ceil(n * per_mille / 1000), at least 1, in whole numbers."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor((n * per_mille + F.lit(999)) / F.lit(1000)).cast("bigint"))


def percentiles(counts: DataFrame, per_mille: list[int]) -> DataFrame:
    """Groups, n_values, per_mille, value: a row for each group and wanted percentile (500: the median)."""
    groups = [c for c in counts.columns if c not in ("value", "n")]
    # Each row covers the ranks (upto - n, upto]; it yields the percentiles whose ranks are among these.
    rows = running_sum(counts, groups, ["value"], "n", out="_upto", total="n_values", cut="frequencies")
    ps = F.array(*[F.lit(p).cast("bigint") for p in sorted(set(per_mille))])
    hit = F.filter(ps, lambda p: (rank(F.col("n_values"), p) <= F.col("_upto")) & (rank(F.col("n_values"), p) > F.col("_upto") - F.col("n")))
    return rows.withColumn("_hit", hit).filter(F.size("_hit") > 0).select(*groups, "n_values", F.explode("_hit").alias("per_mille"), "value")
