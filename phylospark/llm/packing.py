"""Items of varying sizes into containers of a fixed capacity.

Only the sizes decide how well items fit, and there are few different ones, no more than the longest item is long. So the packing is planned on the
counts of items by size, and then each item finds its container by its rank among the items of its size. The ranks, from distributed running sums,
do not depend on the capacity: one sort serves any number of capacities. Each piece of an item above the capacity gets its rank from the item's by the counts.

The plan: an item larger than the capacity is split into pieces of the full capacity and a rest; no other is split. Sizes above
a third of the capacity are large: at most two of them go into a container, paired greedily, the largest with the largest that
still fits. The smaller ones follow in falling size, each into the container with the smallest gap that holds it (best
fit), and into a new one where there is none. Runs of equal containers are one step of the plan, whatever their number.

Defined results: null sizes are left out; items of size 0 are spread over the containers, or fill one empty container if there are no
others; negative sizes raise; equal sizes are ranked by the items' ids, which must be unique; empty tables give no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.operators.ranges import running_sum
from phylospark.runtime import materialize

#: Sizes whose steps are sent to the executors at once. More capacities than these have sizes for go by several passes.
SENT_SIZES = 2_000_000


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Steps (size, first rank, first container, items a container) and the number of containers, for counts of items by size (1 to capacity).

    The items of a size with rank r from a step's first rank on (up to the next step of that size) go to container first + (r - first rank) // items.
    """
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    if any(s > capacity for s in left):
        raise ValueError("a size above the capacity")
    steps: list[tuple[int, int, int, int]] = []
    rank = dict.fromkeys(left, 0)
    made = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # runs of containers (first, number) by what is free in them
    order: list[int] = []  # the gaps there are, sorted

    def free(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, number))

    def put(size: int, first: int, number: int, each: int) -> None:
        steps.append((size, rank[size], first, each))
        rank[size] += number * each
        left[size] -= number * each

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            i = bisect_left(large, capacity - size + 1) - 1  # the largest partner that fits
            while i >= 0 and (large[i] > size or left[large[i]] < (2 if large[i] == size else 1)):
                i -= 1
            partner = large[i] if i >= 0 else None
            if partner is None:
                number = left[size]
                put(size, made, number, 1)
                free(capacity - size, made, number)
            elif partner == size:
                number = left[size] // 2
                put(size, made, number, 2)
                free(capacity - 2 * size, made, number)
            else:
                number = min(left[size], left[partner])
                put(size, made, number, 1)
                put(partner, made, number, 1)
                free(capacity - size - partner, made, number)
            made += number
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            i = bisect_left(order, size)
            if i < len(order):
                gap = order[i]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[i]
            else:
                gap, first = capacity, made
                number = -(-left[size] // (capacity // size))
                made += number
            each = gap // size
            full = min(number, left[size] // each)
            if full:
                put(size, first, full, each)
                free(gap - each * size, first, full)
            first, number = first + full, number - full
            if number and left[size]:  # fewer than fill one
                rest = left[size]
                put(size, first, 1, rest)
                free(gap - rest * size, first, 1)
                first, number = first + 1, number - 1
            free(gap, first, number)
    return steps, made


class Placement:
    """Where the items of each size go with a capacity: the plan as arrays, for look-ups by size and rank."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        left = {s: n for s, n in counts.items() if 0 < s <= capacity}
        #: By size above the capacity: the rank of its first whole piece, and that of its first rest.
        self.whole: dict[int, int] = {}
        self.rest: dict[int, int] = {}
        for s in sorted(x for x in counts if x > capacity):
            self.whole[s], left[capacity] = left.get(capacity, 0), left.get(capacity, 0) + counts[s] * (s // capacity)
            if r := s % capacity:
                self.rest[s], left[r] = left.get(r, 0), left.get(r, 0) + counts[s]
        steps, made = plan(left, capacity)
        self.made = max(made, 1)
        by = np.array(sorted(steps), dtype=np.int64).reshape(-1, 4)
        self.rank, self.first, self.each = by[:, 1], by[:, 2], by[:, 3]
        self.sizes, self.at = np.unique(by[:, 0], return_index=True)
        self.at = np.concatenate([self.at, [len(by)]]).astype(np.int64)

    def container(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The container of each item of a size from 1 to the capacity: its step is the last that begins by its rank, found by bisection within the size's steps."""
        k = np.searchsorted(self.sizes, size)
        low, high = self.at[k], self.at[k + 1]
        while (high - low > 1).any():
            middle = (low + high) // 2
            up = (high - low > 1) & (self.rank[np.minimum(middle, len(self.rank) - 1)] <= rank)
            low, high = np.where(up, middle, low), np.where((high - low > 1) & ~up, middle, high)
        return self.first[low] + (rank - self.rank[low]) // self.each[low]

    def pieces(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For items: which of them, piece, size and container of each piece."""
        cap = self.capacity
        n = np.maximum(-(-size // cap), 1)
        of = np.repeat(np.arange(len(size)), n)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        s, r = size[of], rank[of]
        part = np.minimum(cap, s - piece * cap)
        large = s > cap
        if large.any():
            full = large & (part == cap)
            r[full] = np.array([self.whole[x] for x in s[full].tolist()], dtype=np.int64) + r[full] * (s[full] // cap) + piece[full]
            last = large & ~full
            r[last] += np.array([self.rest[x] for x in s[last].tolist()], dtype=np.int64)
        out = r % self.made  # for size 0
        some = part > 0
        out[some] = self.container(part[some], r[some])
        return of, piece, part, out


def ranked(items: DataFrame, item: str, size: str) -> DataFrame:
    """item, size, _rank (from 0, among the items of the size, by their ids). A size may have any share of the items."""
    s = F.col(size).cast("bigint")
    whole = items.filter(s.isNotNull()).select(F.col(item).alias("item"), F.when(s < 0, F.raise_error(F.lit("a negative size"))).otherwise(s).alias("size"), F.lit(1).cast("bigint").alias("_one"))
    sums = running_sum(whole, ["size"], ["item"], "_one", out="_rank", cut="sizes")
    return materialize(sums.select("item", "size", (F.col("_rank") - 1).alias("_rank")), "ranks")


def pack_all(items: DataFrame, item: str, size: str, packs: Iterable[tuple[str, int]]) -> DataFrame:
    """pack_name, capacity, item, piece (0, 1, ..), size, container_id (from 0) for each named capacity: where each item, or piece of an item above the
    capacity, goes. The items are sorted once and read once for as many capacities as have SENT_SIZES sizes."""
    ranks = ranked(items, item, size)
    counts = {r.size: r.n for r in ranks.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row for each different size
    kind = ranks.schema["item"].dataType.simpleString()
    ddl = f"pack_name string, capacity int, item {kind}, piece bigint, size bigint, container_id bigint"
    out: list[DataFrame] = []
    held: list[tuple[str, Placement]] = []

    def passed() -> None:
        known = items.sparkSession.sparkContext.broadcast(list(held))  # bounded by SENT_SIZES and the sizes of one capacity
        held.clear()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s, r = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:3])
                for name, place in known.value:
                    of, piece, part, container = place.pieces(s, r)
                    cols = [pa.array([name] * len(of), pa.string()), pa.array(np.full(len(of), place.capacity, dtype=np.int32)), b.column(0).take(pa.array(of))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(piece), pa.array(part), pa.array(container)], names=["pack_name", "capacity", "item", "piece", "size", "container_id"])

        out.append(ranks.mapInArrow(run, ddl))

    sent = 0
    for name, capacity in packs:
        place = Placement(counts, capacity)
        held.append((name, place))
        sent += len(place.rank) + len(place.whole)
        if sent > SENT_SIZES:
            passed()
            sent = 0
    if held or not out:
        passed()
    return reduce(DataFrame.unionByName, out)


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """item, piece, size, container_id for one capacity."""
    return pack_all(items, item, size, [("", capacity)]).select("item", "piece", "size", "container_id")


def fills(packed: DataFrame, capacity: int, *keys: str) -> DataFrame:
    """n_items, used and fill (share of the capacity) of each container."""
    return packed.groupBy(*keys, "container_id").agg(F.count("*").alias("n_items"), F.sum("size").alias("used")).withColumn("fill", F.col("used") / F.lit(float(capacity)))
