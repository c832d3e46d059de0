"""Rows that are the same record but for the way they are written.

A record is a set of named fields, each with a way to compare: 'exact', 'fold' (letter case is ignored) or 'words' (the same
ASCII words, each as often, in any order and with anything between). Each (field name, value) or (field name, word) is hashed
and the hashes are added up modulo a prime: a multiset hash that knows no order, of fields or of words, and needs no
sort. Two such sums of independent hashes are the fingerprint (124 bits). Rows are grouped by it, in which the size of a group
does not matter: what is kept of a group is its number of rows, its least id and that row's fields. Then each row is compared
with its group's first row, field by field, words by their counts. Rows that differ (equal fingerprints by chance) are
grouped once more by their fields themselves.

Defined results: rows with a null in any field are left out; '' equals ''; an id without words equals other such ids;
other columns do not matter; equal ids of rows are kept apart only by their row ids, which must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.functions.ids import id_words
from phylospark.operators.bitmaps import may_hold
from phylospark.runtime import is_small, materialize

PRIME = 4611686018427387847  # the largest below 2^62: two remainders never overflow 64 bits
SEEDS = (0x9E3779B9, 0x85EBCA6B)
#: Groups with more rows than this are spread over several partitions for the comparison with their first row.
HOT_ROWS = 100_000
SALTS = 64


def _normal(col: Column, how: str) -> Column:
    if how == "exact":
        return col.cast("string")
    if how == "fold":
        return F.lower(col)
    if how == "words":
        return id_words(col)
    raise ValueError(f"unknown way to compare: {how}")


def fingerprint(fields: dict[str, str], seed: int) -> Column:
    """The multiset hash of the normalized fields, columns called f_<name>."""
    total = F.lit(0).cast("bigint")
    for name, how in fields.items():
        col = F.col(f"f_{name}")
        h = lambda x, name=name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), x), F.lit(PRIME))
        if how == "words":
            total = F.pmod(total + F.aggregate(col, F.lit(0).cast("bigint"), lambda a, w: F.pmod(a + h(w), F.lit(PRIME))), F.lit(PRIME))
        else:
            total = F.pmod(total + h(col), F.lit(PRIME))
    return total


def _equal(a: Column, b: Column, how: str) -> Column:
    if how != "words":
        return a == b
    # the same words, each as often; the common case, the same words in the same order, first
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return (a == b) | ((F.size(a) == F.size(b)) & F.forall(F.array_distinct(a), lambda w: count(a, w) == count(b, w)))


def _exact_key(fields: dict[str, str]) -> list[Column]:
    return [(F.array_join(F.sort_array(f"f_{n}"), " ") if how == "words" else F.col(f"f_{n}")).alias(f"k_{n}") for n, how in fields.items()]


def normalized(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """row_id, f_<name> for each field, and the fingerprint h1, h2. Rows with a null field are left out."""
    rows = df.filter(" and ".join(f"`{n}` is not null" for n in fields)).select(F.col(id_col).alias("row_id"), *[_normal(F.col(n), how).alias(f"f_{n}") for n, how in fields.items()])
    return rows.withColumn("h1", fingerprint(fields, SEEDS[0])).withColumn("h2", fingerprint(fields, SEEDS[1]))


def groups(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """first_id and n_copies (the first one too) of each distinct record."""
    members = copies(df, id_col, fields, singles=True)
    return members.groupBy("first_id").agg(F.count("*").alias("n_copies"))


def copies(df: DataFrame, id_col: str, fields: dict[str, str], singles: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """first_id and copy_id, a row for each row beyond the first of its record; with singles also the first ones, as their own copies."""
    rows = normalized(df, id_col, fields)
    hashes = ["h1", "h2"]
    found = rows.groupBy(*hashes).agg(F.min("row_id").alias("first_id"), F.count("*").alias("n_rows"))
    found = materialize(found, "fingerprints")
    many = found.filter("n_rows > 1").drop("n_rows")
    hot = found.filter(F.col("n_rows") > hot_rows).select(*hashes, F.col("first_id").alias("_hot_first"))
    fs = [f"f_{n}" for n in fields]
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    if is_small(many):
        many = F.broadcast(many)  # only rows with copies are shuffled at all
    else:  # nor are most of the others: a bitmap of fixed size tells rows that surely have no copy
        rows = rows.filter(may_hold(many, "h1")(F.col("h1")))
    if hot.isEmpty():
        dups = rows.join(many, hashes).withColumn("_hot", F.lit(False))
    else:  # a hot group holds more than hot_rows rows of the table, so these are few whatever its size; their rows take no part in the shuffle by group
        flagged = rows.join(F.broadcast(hot), hashes, "left")
        cold = flagged.filter("_hot_first is null").drop("_hot_first").join(many, hashes).withColumn("_hot", F.lit(False))
        dups = cold.unionByName(flagged.filter("_hot_first is not null").withColumnRenamed("_hot_first", "first_id").withColumn("_hot", F.lit(True)))
    dups = materialize(dups, "dups")
    # A row goes to its group's first row; the first row of a hot group goes to SALTS partitions, over which the group's rows are spread.
    heads = dups.filter("row_id = first_id").select(*hashes, F.explode(F.when(F.col("_hot"), salts).otherwise(F.array(F.lit(0)))).alias("_salt"), *[F.col(f).alias(f"o_{f}") for f in fs])
    rest = dups.filter("row_id <> first_id").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    same = F.lit(True)
    for n, how in fields.items():
        same = same & _equal(F.col(f"f_{n}"), F.col(f"o_f_{n}"), how)
    judged = rest.join(heads, [*hashes, "_salt"]).select("first_id", F.col("row_id").alias("copy_id"), same.alias("_same"))
    judged = materialize(judged, "copies")
    result = judged.filter("_same").select("first_id", "copy_id")
    odd = judged.filter("not _same")
    if not odd.isEmpty():
        keys = [f"k_{n}" for n in fields]
        again = rows.join(odd.select(F.col("copy_id").alias("row_id")), "row_id", "left_semi").select("row_id", *_exact_key(fields))
        heads2 = again.groupBy(*keys).agg(F.min("row_id").alias("first_id"), F.count("*").alias("n_rows"))
        again = again.join(heads2, keys).select("first_id", F.col("row_id").alias("copy_id"))
        result = result.unionByName(again if singles else again.filter("first_id <> copy_id"))
    if singles:
        result = result.unionByName(found.select("first_id", F.col("first_id").alias("copy_id")))
    return result
