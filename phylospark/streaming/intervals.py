"""Intervals that arrive in a stream: ordered maps of disjoint intervals in keyed state.

The key is the shard of an entity (see `operators.intervals.Shards`), its state the maps of the shard's entities. Each micro-batch merges its
rows, then inserts what is left: an insertion finds the periods that it touches by binary search. What is written is, for each entity that
changed in a shard, its periods there as they are now, with the end of the one before (so with the gaps) and a version that grows; a reader takes an entity's
newest version of each shard. The state is as large as the number of periods, not of intervals.

`merged` runs a stream over what its sources have now and returns the result of `operators.intervals.merge`.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from phylospark.operators import intervals
from phylospark.operators.intervals import IntervalMap, Maps, Shards
from phylospark.operators.ranges import join_same
from phylospark.runtime import scratch_path

STATE = "version bigint, maps binary"


def packed(maps: Maps) -> bytes:
    """The maps as bytes: keys and sizes as JSON, then all starts and all ends."""
    head = json.dumps([[list(k), len(m.starts)] for k, m in maps.by.items()]).encode()
    numbers = np.array([*(s for m in maps.by.values() for s in m.starts), *(e for m in maps.by.values() for e in m.ends)], dtype=np.int64)
    return struct.pack("<q", len(head)) + head + numbers.tobytes()


def unpacked(data: bytes) -> Maps:
    maps = Maps()
    (n,) = struct.unpack_from("<q", data)
    numbers = np.frombuffer(data, dtype=np.int64, offset=8 + n) if (len(data) - 8 - n) % 8 == 0 else np.frombuffer(data[8 + n :], dtype=np.int64)
    at, half = 0, len(numbers) // 2
    for key, size in json.loads(data[8 : 8 + n]):
        maps.by[tuple(key)] = IntervalMap(numbers[at : at + size].tolist(), numbers[half + at : half + at + size].tolist())
        at += size
    return maps


def merge_stream(stream: DataFrame, keys: list[str], start: str, end: str, shards: Shards | None = None) -> DataFrame:
    """version and the columns of `intervals.piece_columns`, for the periods of the entities that a micro-batch changed. Intervals have both ends
    included; inverted ones and those with a null end are left out. shards: of `intervals.plan_shards`, or how many there are to be."""
    n = len(keys)
    columns = [f"k{i}" for i in range(n)]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, held = state.get if state.exists else (0, None)
        maps = unpacked(bytes(held)) if held else Maps()
        for b in batches:
            maps.insert([pa.array(b[c], pa.string(), from_pandas=True) for c in columns], b["_from"].to_numpy(np.int64), b["_to"].to_numpy(np.int64))
        state.update((version + 1, packed(maps)))
        names, values = maps.pieces()
        yield pd.DataFrame({"version": version + 1, "_shard": np.full(len(values["_from"]), key[0]), **dict(zip(columns, names)), **values})

    rows = intervals.partial(intervals._shaped(stream, keys, start, end), n, shards or Shards(200))
    return rows.groupBy("_shard").applyInPandasWithState(update, f"version bigint, {intervals.piece_ddl(n)}", STATE, "append", GroupStateTimeout.NoTimeout)


def newest(pieces: DataFrame, n_keys: int) -> DataFrame:
    """The pieces of each entity's newest version in each shard."""
    if pieces.agg(F.coalesce(F.max("version"), F.lit(1))).first()[0] > 1:
        by = ["_shard", *(f"k{i}" for i in range(n_keys))]
        last = pieces.groupBy(*by).agg(F.max("version").alias("_last"))
        pieces = join_same(pieces, last, by).filter(F.col("version") == F.col("_last")).drop("_last")
    return pieces.drop("version")


def merged(stream: DataFrame, static: DataFrame, keys: list[str], start: str, end: str, shard_rows: int = intervals.SHARD_ROWS) -> DataFrame:
    """The periods and gaps of all that the stream's sources have now, as `intervals.merge` gives them. static: the same rows as a table, by which
    the shards are planned. The stream's checkpoint, with the keyed state, and its output are in the shared folder."""
    shards = intervals.plan_shards(static, keys, start, end, shard_rows)
    out, at = scratch_path(stream.sparkSession, "interval_pieces"), scratch_path(stream.sparkSession, "interval_state")
    pieces = merge_stream(stream, keys, start, end, shards)
    pieces.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = stream.sparkSession.read.schema(pieces.schema).parquet(out)
    return intervals.finish(newest(found, len(keys)), static, keys, shards)
