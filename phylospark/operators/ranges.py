"""Running sums over groups of any size: range-sort, sum by partition, add the offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phylospark.runtime import materialize

#: A key of the left side is hot with more rows than this, and more than one HOT_PART of all: so there are less than HOT_PART hot keys.
HOT_ROWS = 100_000
HOT_PART = 10_000
#: Copies of the right side's rows of a hot key, over which the left side's rows with that key are spread.
SALTS = 32


def join_same(left: DataFrame, right: DataFrame, cols: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join on null-safe equality of the columns; the result has each of them once. small: right has a proven size bound."""
    right = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") for c in cols], *[F.col(f"`{c}`") for c in right.columns if c not in cols])
    on = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_r_{c}`")) for c in cols])
    return left.join(F.broadcast(right) if small else right, on, how).drop(*[f"_r_{c}" for c in cols])


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: str | list[str], out: str | list[str] = "running", total: str | None = None, cut: str = "ranged") -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same groups up to and with this one, in the given order; several of both if these
    are lists. `total`, if named, is the (first) sum over all of the group. Without groups the whole table is one.

    A group may hold any share of the rows: the table is range-partitioned by groups and order, so that a large group is
    spread over many partitions; each adds the sums of the partitions before it. Rows equal in groups and order are
    taken in an unspecified order and stay in one partition, so the order should be unique. Nulls are a group of their own and count as 0 in sums.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    k = range(len(values))
    zero = lambda c: F.coalesce(c, F.lit(0))
    ranged = df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, cut)  # both uses below must see the same partitions
    parts = ranged.groupBy("_part", *groups).agg(*[F.sum(zero(F.col(values[i]))).alias(f"_sum{i}") for i in k])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({f"_before{i}": F.sum(f"_sum{i}").over(before) for i in k})
    if total:
        parts = parts.withColumn(total, F.sum("_sum0").over(Window.partitionBy(*groups)))
    else:  # only a group that began in an earlier partition has an offset: at most one row for each partition of the range-sort
        parts = parts.filter(F.col("_before0").isNotNull())
    parts = parts.drop(*[f"_sum{i}" for i in k])
    within = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.withColumns({f"_within{i}": F.sum(zero(F.col(values[i]))).over(within) for i in k})
    joined = join_same(inner, parts, ["_part", *groups], small=not total)
    sums = [(F.col(f"_within{i}") + zero(F.col(f"_before{i}"))).alias(outs[i]) for i in k]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *sums, *([total] if total else []))


def previous(df: DataFrame, groups: list[str], order: list[str], value: str, out: str, cut: str = "previous") -> DataFrame:
    """Add `out`: the value in the row before this one in its groups, null in the first. As in `running_sum`, a group of any size is spread over ranges; the first
    row of a range has its value from the last range before with rows of the group."""
    ranged = materialize(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), cut)
    within = Window.partitionBy("_part", *groups).orderBy(*order)
    rows = ranged.withColumns({"_row": F.row_number().over(within), out: F.lag(value).over(within)})
    last = ranged.groupBy("_part", *groups).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    before = last.withColumn("_earlier", F.lag("_last").over(Window.partitionBy(*groups).orderBy("_part"))).select("_part", *groups, "_earlier")
    joined = join_same(rows, before.filter(F.col("_earlier").isNotNull()), ["_part", *groups], small=True)  # at most one row for each range
    value_here = F.when(F.col("_row") == 1, F.col("_earlier.v")).otherwise(F.col(out))
    return joined.withColumn(out, value_here).select(*[F.col(f"`{c}`") for c in df.columns], out)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str, hot: int = 100_000) -> DataFrame:
    """Inner join with a right side that has each key once and knows, in `weight`, how many rows of left have it.

    The keys of more than `hot` rows are sent to all executors, so that their rows need no shuffle: at most one key for every
    `hot` rows of left. The other keys are joined as usual; none is hot there.
    """
    many = right.filter(F.col(weight) > hot)
    if many.isEmpty():
        return left.join(right.drop(weight), keys)
    flagged = left.join(F.broadcast(many.drop(weight).withColumn("_hot", F.lit(True))), keys, "left")
    cold = flagged.filter("_hot is null").select(*left.columns).join(right.filter(F.col(weight) <= hot).drop(weight), keys)
    return flagged.filter("_hot").drop("_hot").unionByName(cold)


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """_hot: the keys that so many rows have that they must be spread; less than HOT_PART, whatever the data. Counted in each task before the shuffle."""
    counts = materialize(df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")), "key_counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return counts.filter(F.col("_n") > max(hot_rows, total // HOT_PART)).select("_hot")


def join_skewed(left: DataFrame, key: str, right: DataFrame, right_key: str, how: str = "left_semi", fits: Column | None = None, small: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join on key = right_key and `fits`, 'inner' (without right_key in the result), 'left_semi' or 'left_anti'. Column names of the two
    must differ. small: right has a proven size bound and is sent to all; else both are shuffled by key, and only keys that are hot on the left are spread."""
    fits = F.lit(True) if fits is None else fits
    if small:
        return left.join(F.broadcast(right), (F.col(key) == F.col(right_key)) & fits, how).drop(*[right_key] * (how == "inner"))
    hot = F.broadcast(hot_keys(left, key, hot_rows))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).cast("int")
    salted = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = right.join(hot, F.col(right_key) == F.col("_hot"), "left").withColumn("_salt_r", F.explode(copies)).drop("_hot")
    joined = salted.join(right, (F.col(key) == F.col(right_key)) & (F.col("_salt") == F.col("_salt_r")) & fits, how)
    return joined.drop("_salt", *["_salt_r", right_key] * (how == "inner"))
