"""Overlapping, nested and touching intervals per entity: continuous periods and the gaps between them.

`IntervalMap` keeps disjoint intervals in order; an insertion finds what it touches by binary search, merges it and so changes the gaps.
Entities are put into shards, each of which has a map for each of its entities as its keyed state:
1. each Arrow batch merges its own rows (a partial aggregation before the shuffle),
2. the remaining intervals go to the shard of their entity; an entity with more rows than a shard should have has several of its own, cut by
   quantiles of the starts, so that an entity of any size is spread,
3. a shard inserts what it gets into its maps,
4. only for entities with several shards, what crosses from one to the next is joined by a table with at most one row for each shard.
`merge` does this for a table, `streaming.intervals` for a stream, with the maps in the state store.

Intervals are integers with both ends included. Rows with a null end or start > end are left out; null keys form entities of their own, apart from ''.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phylospark.operators.ranges import join_same
from phylospark.runtime import materialize

#: Rows that a shard should have at most, and the most shards that large entities are cut into: with more rows than their product, shards are larger.
SHARD_ROWS = 100_000
MOST_CUTS = 10_000
ACCURACY = 10_000


class IntervalMap:
    """Disjoint intervals in order, none touching another; both ends included."""

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts = starts or []
        self.ends = ends or []

    def insert(self, start: int, end: int) -> tuple[int, int]:
        """Add an interval; returns the period that now holds it."""
        i = bisect_left(self.ends, start - 1)  # the first that reaches start - 1
        j = bisect_right(self.starts, end + 1)  # behind the last that begins by end + 1
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j] = [start]
        self.ends[i:j] = [end]
        return start, end

    def insert_runs(self, starts: list[int], ends: list[int]) -> None:
        """Add intervals that are disjoint and in order."""
        if not self.starts:
            self.starts, self.ends = starts, ends
        else:
            for s, e in zip(starts, ends):
                self.insert(s, e)

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))

    def gaps(self) -> list[tuple[int, int]]:
        return [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:])]


def disjoint(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of each code merged, in the order of code and start: a sort and a running maximum."""
    n = len(start)
    if not n:
        return code, start, end
    by = np.lexsort((start, code))
    code, start, end = code[by], start[by], end[by]
    values, rank = np.unique(end, return_inverse=True)
    reach = np.maximum.accumulate(code * n + rank) % n  # a higher code is above all of the ones before
    before = values[reach[:-1]]
    apart = (start[1:] > before) & (start[1:].view(np.uint64) - before.view(np.uint64) > 1)  # without overflow
    first = np.concatenate([[True], (code[1:] != code[:-1]) | apart])
    last = np.concatenate([first[1:], [True]])
    return code[first], start[first], values[reach[last]]


class Entities:
    """Numbers for entities, which are tuples of texts or nulls."""

    def __init__(self, columns: list[pa.Array], n: int) -> None:
        code = np.zeros(n, dtype=np.int64)
        for c in columns:
            d = c.dictionary_encode(null_encoding="encode")
            _, code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        _, self.at, self.code = np.unique(code, return_index=True, return_inverse=True)
        self.columns = columns

    def keys(self) -> list[tuple]:
        cols = [c.take(pa.array(self.at)).to_pylist() for c in self.columns]
        return list(zip(*cols)) if cols else [()] * len(self.at)


class Maps:
    """The interval maps of a shard, by entity."""

    def __init__(self) -> None:
        self.by: dict[tuple, IntervalMap] = {}
        self.touched: set[tuple] = set()

    def insert(self, columns: list[pa.Array], start: np.ndarray, end: np.ndarray) -> None:
        e = Entities(columns, len(start))
        keys = e.keys()
        code, start, end = disjoint(e.code, start, end)
        cuts = np.searchsorted(code, np.arange(len(keys) + 1))
        for k, key in enumerate(keys):
            a, b = cuts[k], cuts[k + 1]
            self.by.setdefault(key, IntervalMap()).insert_runs(start[a:b].tolist(), end[a:b].tolist())
            self.touched.add(key)

    def pieces(self) -> tuple[list[list], dict[str, np.ndarray]]:
        """Columns of the keys, and _from, _to, _k (number within the shard), _n and _prev (the end of the one before) of each period of the touched entities."""
        keys = list(self.touched)
        sizes = np.array([len(self.by[k].starts) for k in keys], dtype=np.int64)
        starts = np.array([s for k in keys for s in self.by[k].starts], dtype=np.int64)
        ends = np.array([e for k in keys for e in self.by[k].ends], dtype=np.int64)
        at = np.arange(len(starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        which = np.repeat(np.arange(len(keys)), sizes)
        prev = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        cols = [[k[i] for k in keys] for i in range(len(keys[0]))] if keys else []
        return [np.array(c, dtype=object)[which].tolist() for c in cols], {"_from": starts, "_to": ends, "_k": at, "_n": np.repeat(sizes, sizes), "_prev": prev}


@dataclass
class Shards:
    """Where entities go: small ones to one of `common` shards by a hash, large ones to shards of their own from there on, cut at these starts."""

    common: int = 1
    cuts: dict[tuple, tuple[int, list[int]]] = field(default_factory=dict)

    def of(self, entities: Entities, hashes: np.ndarray, code: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each run (code of its entity, start) its shard. hashes: of each entity."""
        out = (hashes % np.uint64(self.common)).astype(np.int64)[code]
        if self.cuts:
            for k, key in enumerate(entities.keys()):
                if key in self.cuts:
                    first, at = self.cuts[key]
                    mine = code == k
                    out[mine] = first + np.searchsorted(at, start[mine], side="right")
        return out


def _shaped(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """k0, k1, .. (texts), _h (hash of the entity), _from, _to of the valid rows."""
    ks = [F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(start) <= F.col(end)).select(*ks, F.col(start).cast("bigint").alias("_from"), F.col(end).cast("bigint").alias("_to"))
    return rows.select(*names, F.xxhash64(F.lit(0), *names).alias("_h"), "_from", "_to")


def plan_shards(df: DataFrame, keys: list[str], start: str, end: str, shard_rows: int = SHARD_ROWS) -> Shards:
    """The shards for a table (or for a stream that looks like it). The driver gets the entities that are larger than a shard, less than MOST_CUTS, and their cuts."""
    rows = _shaped(df, keys, start, end)
    ks = rows.columns[: len(keys)]
    counts = materialize(rows.groupBy(*ks).agg(F.count("*").alias("_n")), "entities") if ks else rows.agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    size = max(shard_rows, total // MOST_CUTS)
    found = Shards(max(1, math.ceil(total / size)))
    large = counts.filter(F.col("_n") > size)
    wanted: dict[int, list[tuple]] = {}
    for r in large.collect():
        wanted.setdefault(1 << math.ceil(math.log2(r["_n"] / size)), []).append(tuple(r[k] for k in ks))
    first = found.common
    for n in sorted(wanted):  # by the power of two that is the number of shards
        which = rows.sparkSession.createDataFrame(wanted[n], ", ".join(f"{k} string" for k in ks)) if ks else None
        mine = join_same(rows.select(*ks, "_from"), which, ks, "left_semi", small=True) if ks else rows
        quantiles = F.percentile_approx("_from", [i / n for i in range(1, n)], max(ACCURACY, 10 * n))
        for r in mine.groupBy(*ks).agg(quantiles.alias("_cuts")).collect():
            at = sorted(set(r["_cuts"]))
            found.cuts[tuple(r[k] for k in ks)] = (first, at)
            first += len(at) + 1
    return found


def partial(rows: DataFrame, n_keys: int, shards: Shards) -> DataFrame:
    """k0, k1, .., _from, _to, _shard: each Arrow batch of `_shaped` rows merged by itself."""
    fields = [pa.field(f"k{i}", pa.string()) for i in range(n_keys)]
    schema = pa.schema([*fields, *(pa.field(c, pa.int64()) for c in ("_from", "_to", "_shard"))])
    known = rows.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns[:n_keys]
            h, start, end = (c.to_numpy(zero_copy_only=False) for c in b.columns[n_keys:])
            e = Entities(columns, b.num_rows)
            code, start, end = disjoint(e.code, start, end)
            shard = known.value.of(e, h[e.at].view(np.uint64), code, start)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(e.at[code])) for c in columns), pa.array(start), pa.array(end), pa.array(shard)], schema=schema)

    return rows.mapInArrow(run, "".join(f"k{i} string, " for i in range(n_keys)) + "_from bigint, _to bigint, _shard bigint")


def piece_columns(n_keys: int) -> list[str]:
    return ["_shard", *(f"k{i}" for i in range(n_keys)), "_from", "_to", "_k", "_n", "_prev"]


def piece_ddl(n_keys: int) -> str:
    return ", ".join(f"{c} {'string' if c[0] == 'k' else 'bigint'}" for c in piece_columns(n_keys))


def merge(df: DataFrame, keys: list[str], start: str, end: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Keys, kind ('period' or 'gap'), from_pos and to_pos, one row for each period and each gap between two."""
    n = len(keys)
    shards = plan_shards(df, keys, start, end, shard_rows)
    types = [pa.int64() if c[0] == "_" else pa.string() for c in piece_columns(n)]

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        maps = Maps()
        t = table.combine_chunks()
        cols = {c: (t[c].chunk(0) if t[c].num_chunks else pa.array([], t[c].type)) for c in t.column_names}
        maps.insert([cols[f"k{i}"] for i in range(n)], *(cols[c].to_numpy(zero_copy_only=False) for c in ("_from", "_to")))
        names, values = maps.pieces()
        arrays = [np.full(len(values["_from"]), key[0].as_py()), *names, *values.values()]
        return pa.Table.from_arrays([pa.array(a, t) for a, t in zip(arrays, types, strict=True)], names=piece_columns(n))

    pieces = partial(_shaped(df, keys, start, end), n, shards).groupBy("_shard").applyInArrow(whole, piece_ddl(n))
    return finish(pieces, df, keys, shards)


def finish(pieces: DataFrame, df: DataFrame, keys: list[str], shards: Shards) -> DataFrame:
    """The result of `merge` from the pieces of all shards, each entity's of the shards it has. df: has the keys' types."""
    ks = [f"k{i}" for i in range(len(keys))]

    def named(result: DataFrame) -> DataFrame:
        types = [df.select(F.col(f"`{c}`")).schema[0].dataType for c in keys]
        return result.select(*[F.col(k).cast(t).alias(c) for k, t, c in zip(ks, types, keys, strict=True)], "kind", "from_pos", "to_pos")

    def both(rows: DataFrame, before: str) -> DataFrame:
        """A period from each row, and the gap before it if there is anything before."""
        period = F.struct(F.lit("period").alias("kind"), F.col("_from").alias("from_pos"), F.col("_to").alias("to_pos"))
        gap = F.struct(F.lit("gap").alias("kind"), (F.col(before) + 1).alias("from_pos"), (F.col("_from") - 1).alias("to_pos"))
        return rows.select(*ks, F.explode(F.when(F.col(before).isNull(), F.array(period)).otherwise(F.array(period, gap))).alias("x")).select(*ks, "x.*")

    first = F.col("_k") == 0
    pieces = pieces.withColumn("_prev", F.when(~first, F.col("_prev")))
    if not shards.cuts:
        return named(both(pieces, "_prev"))
    pieces = materialize(pieces, "intervals")
    small = both(pieces.filter(F.col("_shard") < shards.common), "_prev")
    pieces = pieces.filter(F.col("_shard") >= shards.common)

    # Of entities with several shards: for each, how far the ones before it reach. One row a shard at most.
    ends = pieces.groupBy("_shard", *ks).agg(F.max("_to").alias("_reach"))
    before = Window.partitionBy(*ks).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", F.max("_reach").over(before)).filter(F.col("_carry").isNotNull()).select("_shard", *ks, "_carry")
    joined = join_same(pieces, carry, ["_shard", *ks], small=True)
    joined = joined.withColumn("_absorbed", F.coalesce(F.col("_from") <= F.col("_carry") + 1, F.lit(False)))

    # Absorbed pieces lengthen the last period before them. The last period of a shard and the absorbed ones behind it
    # have the same number of new periods up to them.
    counts = joined.groupBy("_shard", *ks).agg(F.count_if(~F.col("_absorbed")).alias("_new"), F.count_if("_absorbed").alias("_gone"))
    offset = counts.withColumn("_offset", F.coalesce(F.sum("_new").over(before), F.lit(0))).select("_shard", *ks, "_offset", "_gone")
    edge = join_same(joined.filter(F.col("_absorbed") | (F.col("_k") == F.col("_n") - 1)), offset, ["_shard", *ks], small=True)
    number = F.col("_offset") + F.when(F.col("_absorbed"), 0).otherwise(F.col("_k") - F.col("_gone") + 1)
    edge = edge.withColumn("_number", number).groupBy(*ks, "_number").agg(F.min("_from").alias("from_pos"), F.max("_to").alias("to_pos"))
    inner = joined.filter(~F.col("_absorbed") & (F.col("_k") < F.col("_n") - 1))
    periods = inner.select(*ks, F.lit("period").alias("kind"), F.col("_from").alias("from_pos"), F.col("_to").alias("to_pos"))
    periods = periods.unionByName(edge.select(*ks, F.lit("period").alias("kind"), "from_pos", "to_pos"))
    reach = F.greatest("_carry", "_prev")
    gaps = joined.filter(~F.col("_absorbed") & reach.isNotNull()).select(*ks, F.lit("gap").alias("kind"), (reach + 1).alias("from_pos"), (F.col("_from") - 1).alias("to_pos"))
    return named(small.unionByName(periods).unionByName(gaps))
