"""Draws from several sources so that each gives its target share of the total size.

Every record gets a random key by hashing its id; within each source the records are sorted by it, range-partitioned, and
their sizes summed up across the partitions. A source's budget is its share of the mix's total: whole epochs of the source
use every record that often, and the rest of the budget takes the records up to the point where the running sum reaches it. The record
at this point is in if more than half of it lies within the budget, so that a source misses its budget by half a record at most.

The total is the largest at which no source with records needs more than its allowed repeats, so that the targets are kept; a given
total may be larger, and then scarce sources stop at their allowed repeats and the report shows what they really give.

Defined results: records with a null source or size are not drawn, those of size 0 are used with the part of the order in which they lie;
a target whose source has no records gives nothing and does not limit the others; shares of a mix need not sum to 1; targets
with a null share or repeats, or not above 0, give nothing; ids must be unique, other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.operators.ranges import HOT_ROWS, join_skewed, running_sum
from phylospark.runtime import is_small, materialize

#: Most targets (one a mix and source) that are sent to all executors; with more, they meet the records by a shuffle in which hot sources are spread.
MAX_TARGETS = 100_000


def budgets(available: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """mix_name, source, target_share, max_repeats, available, budget: the size to draw for each target.

    available: source, available; targets: mix_name, source, target_share, max_repeats.
    """
    have = targets.join(available, "source", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    limit = F.when(usable, F.col("available") * F.col("max_repeats") / F.col("target_share"))
    if total is None:
        sums = have.groupBy("mix_name").agg(F.min(limit).alias("_total"))
    else:
        sums = have.select("mix_name").distinct().withColumn("_total", F.lit(float(total)))
    most = (F.col("available") * F.col("max_repeats")).cast("double")
    budget = F.when(usable, F.least(most, F.col("_total") * F.col("target_share"))).otherwise(F.lit(0.0))
    return have.join(sums, "mix_name").withColumn("budget", budget).drop("_total")


def mix(records: DataFrame, record: str, source: str, size: str, targets: DataFrame, total: int | None = None, seed: int = 0, sent: int = MAX_TARGETS, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The draws (mix_name, record, source, size, n_uses) and the report (mix_name, source, target_share, max_repeats, available, budget,
    drawn, actual_share, n_records, max_uses)."""
    targets = targets.select("mix_name", "source", "target_share", "max_repeats").filter("mix_name is not null and source is not null")
    small = is_small(targets, sent)
    rows = records.filter(F.col(source).isNotNull() & F.col(size).isNotNull()).select(F.col(record).alias("record"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size"))
    rows = join_skewed(rows, "source", targets.select(F.col("source").alias("_target")).distinct(), "_target", "left_semi", small=small, hot_rows=hot_rows).withColumn("_key", F.xxhash64(F.lit(seed), F.col("record")))
    summed = materialize(running_sum(rows, ["source"], ["_key", "record"], "size", out="_upto", cut="mix"), "mix")
    have = summed.groupBy("source").agg(F.max("_upto").alias("available"))
    plan = materialize(budgets(have, targets, total), "budgets")  # as many rows as there are targets
    joined = join_skewed(summed, "source", plan.withColumnRenamed("source", "_target"), "_target", "inner", small=small, hot_rows=hot_rows)
    epochs = F.floor(F.col("budget") / F.col("available")).cast("bigint")
    epochs = F.when(F.col("available") > 0, epochs).otherwise(0)
    rest = F.col("budget") - epochs * F.col("available")
    partly = (F.col("_upto") - F.col("size") / 2.0 <= rest) & (rest > 0) & (epochs < F.col("max_repeats"))
    uses = F.least(epochs + F.when(partly, 1).otherwise(0), F.col("max_repeats").cast("bigint"))
    draws = joined.select("mix_name", "record", "source", "size", uses.alias("n_uses")).filter("n_uses > 0")
    drawn = draws.groupBy("mix_name", "source").agg(F.sum(F.col("size") * F.col("n_uses")).alias("drawn"), F.count("*").alias("n_records"), F.max("n_uses").alias("max_uses"))
    report = plan.join(drawn, ["mix_name", "source"], "left")
    zero = F.lit(0).cast("bigint")
    report = report.withColumns({c: F.coalesce(c, zero) for c in ("drawn", "n_records", "max_uses")})
    sums = report.groupBy("mix_name").agg(F.sum("drawn").alias("_all"))
    report = report.join(sums, "mix_name").withColumn("actual_share", F.try_divide(F.col("drawn").cast("double"), F.col("_all").cast("double")))
    return draws, report.select("mix_name", "source", "target_share", "max_repeats", "available", "budget", "drawn", "actual_share", "n_records", "max_uses")
