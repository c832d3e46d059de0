"""A set of hashes as a bitmap of fixed size, sent to all executors: what is surely not in the set needs no shuffle.

With more hashes the bitmap fills up and holds back less; it never drops what is in the set.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits as a power of two: 16 MB.
BITS = 27


def bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The bits of a column of 64-bit hashes. The driver gets one row for each word of 64 bits: at most 2 ** (bits - 6), whatever the number of hashes."""
    bit = F.col(column).bitwiseAND(F.lit(2**bits - 1))
    words = hashes.select(F.shiftright(bit, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("one"))
    found = words.groupBy("word").agg(F.bit_or("one").alias("ones")).toPandas()
    out = np.zeros(2 ** (bits - 6), dtype=np.int64)
    out[found["word"].to_numpy()] = found["ones"].to_numpy()
    return out


def in_bitmap(words: np.ndarray, hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which of these hashes may be in the set."""
    bit = hashes.astype(np.int64).view(np.uint64) & np.uint64(2**bits - 1)
    return (words[(bit >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (bit & np.uint64(63))) & np.uint64(1) == 1


def may_hold(hashes: DataFrame, column: str, bits: int = BITS) -> Callable[[Column], Column]:
    """A condition on a column of hashes: false only where the hash is not among these."""
    known = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes, column, bits))

    @F.pandas_udf(BooleanType())
    def held(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(known.value, h.to_numpy(), bits))

    return held
