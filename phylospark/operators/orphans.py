"""References to records that do not exist, direct and inherited, by a fixpoint over a graph of foreign keys.

A table takes part with its rows' identity, the key it refers by and the key it can be referred to by. A row is a direct orphan
if none of the parent's rows with its key is valid at the row's time; it is an inherited orphan if it refers to rows of
the parent that are all orphans themselves. Each round joins only the newly found orphans' keys against the children, until
a round finds none; the found ones are written to the shared folder after each round.

Defined results: a null reference refers to nothing and is no orphan; an empty parent makes all references orphans; repeated
rows are judged each on its own; a null time of the row is valid at no time, so the row is an orphan.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phylospark.operators.intervals import merge
from phylospark.operators.ranges import HOT_ROWS, join_skewed
from phylospark.runtime import BROADCAST_ROWS, is_small, materialize

#: The end of a period that never ends, in microseconds.
FAR_MICROS = 2**62
#: Rounds after which the tables of the rounds are written as one, so that plans stay short however many rounds there are.
MERGED_ROUNDS = 16


@dataclass(frozen=True)
class Reference:
    """Rows of `child` refer by its column `child_key` to `parent_key` of `parent`.

    With `valid_from` (and `valid_to`, null for ever) of the parent and `at` of the child, the parent's row must be valid at that time:
    valid_from <= at < valid_to.
    """

    child: str
    child_key: str
    parent: str
    parent_key: str
    at: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None


def validity(parent: DataFrame, key: str, valid_from: str, valid_to: str, small: bool = True) -> DataFrame:
    """_key, _from, _to: the disjoint periods in which any row with that key is valid, _to null for ever. Periods that touch are one.

    A small parent (its size is checked by the caller) is merged in a window; a large one, of which a key may hold any share, by the
    operator for intervals.
    """
    rows = parent.filter(F.col(key).isNotNull() & F.col(valid_from).isNotNull() & (F.col(valid_to).isNull() | (F.col(valid_from) < F.col(valid_to))))
    far = F.lit(FAR_MICROS)
    end = F.coalesce(F.unix_micros(F.col(valid_to).cast("timestamp")), far)
    rows = rows.select(F.col(key).alias("_key"), F.unix_micros(F.col(valid_from).cast("timestamp")).alias("_from"), end.alias("_to")).distinct()
    if small:
        order = Window.partitionBy("_key").orderBy("_from", "_to")
        reach = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_new", F.when(F.col("_from") <= reach, 0).otherwise(1))
        rows = rows.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        merged = rows.groupBy("_key", "_n").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    else:
        merged = merge(rows.withColumn("_last", F.col("_to") - 1), ["_key"], "_from", "_last").filter("kind = 'period'")
        merged = merged.select("_key", F.col("from_pos").alias("_from"), (F.col("to_pos") + 1).alias("_to"))
    return merged.select("_key", "_from", F.when(F.col("_to") < far, F.col("_to")).alias("_to"))


def without_parent(child: DataFrame, key: str, parent: DataFrame, parent_key: str, at: str | None = None, valid_from: str | None = None, valid_to: str | None = None, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The child's rows whose key is not null and has no valid parent. The parent is sent to all only if it has at most so many rows;
    otherwise both sides are shuffled by key, with the children of hot keys spread."""
    if valid_from:
        small = is_small(parent, broadcast_rows)
        keys = validity(parent, parent_key, valid_from, valid_to, small)
        when = F.unix_micros(F.col(at).cast("timestamp"))
        fits = (F.col("_from") <= when) & (F.col("_to").isNull() | (when < F.col("_to")))
    else:
        keys, fits = parent.filter(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("_key")).distinct(), None
        small = is_small(keys, broadcast_rows)
    return join_skewed(child.filter(F.col(key).isNotNull()), key, keys, "_key", "left_anti", fits, small, hot_rows)


def orphans(tables: dict[str, DataFrame], ids: dict[str, str], references: list[Reference], carry: dict[str, list[str]] | None = None, broadcast_rows: int = BROADCAST_ROWS, inherited: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """table_name, row_id, kind ('direct' or 'inherited'), depth (0 for direct), then the columns of `carry` of each table under its keys.

    tables by name; ids: the column that identifies a table's rows, cast to bigint. A row may be reached on several ways; the least depth counts.
    carry: columns to pass on, the same names in each table. inherited: without it the fixpoint ends with the direct orphans, its round 0.
    """
    passed = sorted({c for cols in (carry or {}).values() for c in cols})

    def shaped(df: DataFrame, name: str, kind: str, depth: int) -> DataFrame:
        extra = [F.col(c) if c in (carry or {}).get(name, []) else F.lit(None).alias(c) for c in passed]
        keys = sorted({r.parent_key for r in references if r.parent == name})
        return df.select(F.lit(name).alias("table_name"), F.col(ids[name]).cast("bigint").alias("row_id"), F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), *extra, F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(k).cast("string") for k in keys])).alias("_keys") if keys else F.lit(None).cast("map<string,string>").alias("_keys"))

    def once(df: DataFrame, ways: list[Reference]) -> DataFrame:
        return df.dropDuplicates(["table_name", "row_id"]) if len({r.child for r in ways}) < len(ways) else df  # repeated rows stay where there is one way

    found: DataFrame | None = None
    for r in references:
        if r.child not in ids or r.parent in ids and not r.valid_from and r.parent not in tables:
            raise ValueError(f"unknown table in {r}")
        part = shaped(without_parent(tables[r.child], r.child_key, tables[r.parent], r.parent_key, r.at, r.valid_from, r.valid_to, broadcast_rows, hot_rows), r.child, "direct", 0)
        found = part if found is None else found.unionByName(part)
    cascades = [r for r in references if r.parent in {x.child for x in references}] if inherited else []
    out = ["table_name", "row_id", "kind", "depth", *passed]
    if not cascades:
        return once(found.select(out), references)
    found = materialize(once(found, references), "orphans")
    fresh, everything = found, found
    for depth in count(1):  # ends, as a round adds only rows not yet known
        n_fresh = fresh.count()
        if not n_fresh:
            break
        few = n_fresh <= broadcast_rows  # bounds the keys that a round deals with
        step: DataFrame | None = None
        for r in cascades:
            key = F.col("_keys")[r.parent_key]
            touched = fresh.filter((F.col("table_name") == r.parent) & key.isNotNull()).select(key.alias("_key")).distinct()
            # A key is lost only if no row that has it is left sound.
            lost = everything.filter(F.col("table_name") == r.parent).select(F.col("row_id").alias("_lost"))
            parents = tables[r.parent].select(F.col(ids[r.parent]).cast("bigint").alias("_row"), F.col(r.parent_key).cast("string").alias("_held"))
            holders = join_skewed(parents, "_held", touched, "_key", small=few, hot_rows=hot_rows)
            sound = holders.join(lost, F.col("_row") == F.col("_lost"), "left_anti").select(F.col("_held").alias("_sound")).distinct()
            gone = touched.join(F.broadcast(sound) if few else sound, F.col("_key") == F.col("_sound"), "left_anti")
            gone = gone if few else materialize(gone, "gone")
            child = tables[r.child].withColumn("_refers", F.col(r.child_key).cast("string"))
            child = join_skewed(child, "_refers", gone, "_key", small=few, hot_rows=hot_rows).drop("_refers")
            known = everything.filter(F.col("table_name") == r.child).select(F.col("row_id").alias("_known"))
            child = child.join(known, F.col(ids[r.child]).cast("bigint") == F.col("_known"), "left_anti")
            part = shaped(child, r.child, "inherited", depth)
            step = part if step is None else step.unionByName(part)
        fresh = materialize(once(step, cascades), "orphans")
        everything = everything.unionByName(fresh)
        if depth % MERGED_ROUNDS == 0:
            everything = materialize(everything, "orphans")
    return everything.select(out)


def per_period(found: DataFrame, at: str) -> DataFrame:
    """Number of direct and inherited orphans by table and month of the carried time column."""
    month = F.date_trunc("month", F.col(at)).alias("month")
    return found.groupBy("table_name", month).agg(F.count_if(F.col("kind") == "direct").alias("direct"), F.count_if(F.col("kind") == "inherited").alias("inherited"))
