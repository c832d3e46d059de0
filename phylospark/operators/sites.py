"""Site statistics of alignments: columns of aligned sequences.

A table with a row for each character would be some forty times as large as the sequences, so none is made. Sequences are counted in NumPy
matrices of (symbol, position), one for each locus and block of positions, in two steps:
1. each task counts what it has: a locus with several sequences becomes one compressed matrix, one with few stays as it is (the partial
   aggregation before the shuffle; of a locus of any size, at most a few matrices a task go on),
2. the parts of a locus and block meet in one task that adds them up.
What is asked for comes out of the matrices as it is: a row for each site, one for each locus with its sums, or a mask of its sites as bits.
`site_states_sql` says the same with one row for each character, for tests and small tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.functions import seqs

#: Positions in a block: of a longer alignment, each block is counted on its own.
BLOCK = 1 << 16
#: Sequences of a locus in a task from which they become a matrix.
FEW = 8
#: Characters that a task holds before it passes on its counts.
HELD = 32_000_000
ASCII = 128

_PART = pa.schema([("locus", pa.string()), ("block", pa.int32()), ("piece", pa.string()), ("n", pa.int64()), ("codes", pa.list_(pa.int32())), ("width", pa.int32()), ("counts", pa.binary())])
_PART_DDL = "locus string, block int, piece string, n bigint, codes array<int>, width int, counts binary"
_SITE = pa.schema([("locus", pa.string()), ("pos", pa.int32()), ("n_states", pa.int32()), ("n_twice", pa.int32()), ("n_missing", pa.int64()), ("n_rows", pa.int64())])
_SITE_DDL = "locus string, pos int, n_states int, n_twice int, n_missing bigint, n_rows bigint"


class Counts:
    """How often each symbol occurs at each position of a block."""

    def __init__(self) -> None:
        self.n = 0  # pieces
        self.table = np.zeros((ASCII, 0), dtype=np.int64)
        self.other: dict[int, np.ndarray] = {}  # symbols outside of ASCII

    def _widen(self, width: int) -> None:
        more = width - self.table.shape[1]
        if more > 0:
            self.table = np.pad(self.table, ((0, 0), (0, more)))
            self.other = {c: np.pad(v, (0, more)) for c, v in self.other.items()}

    def add(self, piece: str) -> None:
        self.n += 1
        n = len(piece)
        self._widen(n)
        at = np.arange(n)
        if piece.isascii():
            self.table[np.frombuffer(piece.encode(), dtype=np.uint8), at] += 1
            return
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        low = codes < ASCII
        self.table[codes[low], at[low]] += 1
        for c in np.unique(codes[~low]):
            self._row(int(c))[:n][codes == c] += 1

    def _row(self, code: int) -> np.ndarray:
        if code < ASCII:
            return self.table[code]
        return self.other.setdefault(code, np.zeros(self.table.shape[1], dtype=np.int64))

    def add_packed(self, pieces: int, codes: list[int], width: int, packed: bytes) -> None:
        self.n += pieces
        self._widen(width)
        rows = np.frombuffer(zlib.decompress(packed), dtype=np.int64).reshape(len(codes), width)
        for c, r in zip(codes, rows):
            self._row(c)[:width] += r

    def packed(self) -> tuple[int, list[int], int, bytes]:
        codes = [int(c) for c in np.flatnonzero(self.table.any(axis=1))] + sorted(self.other)
        rows = np.stack([self._row(c) for c in codes]) if codes else np.zeros((0, self.table.shape[1]), dtype=np.int64)
        return self.n, codes, self.table.shape[1], zlib.compress(np.ascontiguousarray(rows).tobytes(), 1)

    def symbols(self) -> np.ndarray:
        """How often each ASCII symbol occurs, in upper case."""
        out = self.table.sum(axis=1)
        for c, v in self.other.items():
            up = chr(c).upper()
            if len(up) == 1 and up.isascii():
                out[ord(up)] += v.sum()
        low = np.arange(ord("a"), ord("z") + 1)
        out[low - 32] += out[low]
        out[low] = 0
        return out

    def sites(self, datatype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_states, n_twice, n_missing, n_rows by position."""
        others = np.stack(list(self.other.values())) if self.other else np.zeros((0, self.table.shape[1]), dtype=np.int64)
        if datatype == "aa":
            states = np.ones(ASCII, dtype=bool)
            states[[ord(c) for c in seqs.AA_AMBIGUOUS]] = False
            rows = np.concatenate([self.table[states], others])
        else:
            rows = self.table[[ord(c) for c in seqs.DNA_STATES]]
        missing = self.table[[ord(c) for c in seqs.MISSING]].sum(axis=0)
        return (rows > 0).sum(axis=0), (rows >= 2).sum(axis=0), missing, self.table.sum(axis=0) + others.sum(axis=0)


def _partial(batches: Iterator[pa.RecordBatch], width: int, few: int, most: int) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str | None, int], list[str]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows: list[tuple] = []
        for (locus, block), pieces in held.items():
            if len(pieces) < few:
                rows += [(locus, block, p, None, None, None, None) for p in pieces]
                continue
            c = Counts()
            for p in pieces:
                c.add(p)
            rows.append((locus, block, None, *c.packed()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_PART), _PART)], schema=_PART)

    for b in batches:
        for locus, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for i in range(0, len(seq), width) if seq else (0,):
                held.setdefault((locus, i // width), []).append(seq[i : i + width])
            size += len(seq)
            if size > most:
                yield flush()
                size = 0
    yield flush()


def _whole(batches: Iterator[pa.RecordBatch], result: Callable[[str, int, Counts], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by locus and block."""
    key, counts = None, Counts()
    for b in batches:
        for locus, block, piece, n, codes, width, packed in zip(*(c.to_pylist() for c in b.columns)):
            if key != (locus, block):
                if key is not None:
                    yield result(*key, counts)
                key, counts = (locus, block), Counts()
            if piece is not None:
                counts.add(piece)
            else:
                counts.add_packed(n, codes, width, packed)
    if key is not None:
        yield result(*key, counts)


def matrices(aln: DataFrame, result: Callable[[str, int, Counts], pa.RecordBatch], ddl: str, fold_case: bool = False, block: int = BLOCK, few: int = FEW, held: int = HELD) -> DataFrame:
    """What a function makes of the counts of each locus and block of positions. Null sequences count as empty ones."""
    seq = F.coalesce("seq", F.lit(""))
    rows = aln.select(F.col("locus").cast("string"), F.upper(seq).alias("seq") if fold_case else seq.alias("seq"))
    parts = rows.mapInArrow(lambda batches: _partial(batches, block, few, held), _PART_DDL).repartition("locus", "block").sortWithinPartitions("locus", "block")
    return parts.mapInArrow(lambda batches: _whole(batches, result), ddl)


def site_states(aln: DataFrame, datatype: str = "dna", fold_case: bool = False, block: int = BLOCK, few: int = FEW, held: int = HELD) -> DataFrame:
    """locus, pos (from 0), n_states, n_twice, n_missing, n_rows for every site: how many states it has, how many of them at least twice.

    States are case-sensitive unless fold_case; ambiguous symbols are none ('ignore' is treated as 'dna'). Null sequences have no sites;
    a position behind the end of a shorter sequence is not counted for it.
    """

    def result(locus: str, number: int, counts: Counts) -> pa.RecordBatch:
        cols = counts.sites(datatype)
        n = len(cols[0])
        pos = np.arange(n, dtype=np.int64) + number * block
        arrays = [pa.array([locus] * n, pa.string()), pa.array(pos.astype(np.int32)), *(pa.array(c.astype(t)) for c, t in zip(cols, (np.int32, np.int32, np.int64, np.int64)))]
        return pa.RecordBatch.from_arrays(arrays, schema=_SITE)

    return matrices(aln, result, _SITE_DDL, fold_case, block, few, held)


def site_masks(aln: DataFrame, keep: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], datatype: str = "dna", block: int = BLOCK) -> DataFrame:
    """locus, n_kept, masks: how many sites a function of (n_states, n_twice, n_missing, n_rows) keeps, and which, as one bit a site in blocks. The masks of a
    locus together are an eighth as long as one of its sequences."""
    schema = pa.schema([("locus", pa.string()), ("block", pa.int32()), ("kept", pa.int64()), ("mask", pa.binary())])

    def result(locus: str, number: int, counts: Counts) -> pa.RecordBatch:
        kept = keep(*counts.sites(datatype))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((locus, number, int(kept.sum()), np.packbits(kept).tobytes()), schema)], schema=schema)

    rows = matrices(aln, result, "locus string, block int, kept bigint, mask binary", block=block)
    return rows.groupBy("locus").agg(F.sum("kept").alias("n_kept"), F.transform(F.sort_array(F.collect_list(F.struct("block", "mask"))), lambda x: x["mask"]).alias("masks"))


SUMS = ("site_count", "conserved", "variable", "pars_inf")


def locus_sums(aln: DataFrame, datatype: str = "dna", symbols: str = "", fold_case: bool = False, block: int = BLOCK) -> DataFrame:
    """locus, ntax, nchar, site_count, conserved, variable, pars_inf, and n_<code> for each of these symbols, in either case: one pass, one row a locus and block."""
    codes = [ord(c) for c in symbols]
    names = ["ntax", "nchar", *SUMS, *(f"n_{c}" for c in codes)]

    def result(locus: str, number: int, counts: Counts) -> pa.RecordBatch:
        states, twice, _, rows = counts.sites(datatype)
        informative = (states > 1) & (twice >= 2)
        values = [counts.n if number == 0 else 0, number * block + len(rows), (states >= 1).sum(), (states == 1).sum(), (states > 1).sum(), informative.sum(), *counts.symbols()[codes]]
        return pa.RecordBatch.from_arrays([pa.array([locus], pa.string()), *(pa.array([int(v)], pa.int64()) for v in values)], names=["locus", *names])

    rows = matrices(aln, result, "locus string, " + ", ".join(f"{c} bigint" for c in names), fold_case, block)
    return rows.groupBy("locus").agg(*[(F.max if c == "nchar" else F.sum)(c).alias(c) for c in names])


def site_rows(aln: DataFrame) -> DataFrame:
    """locus, pos (from 0), base: one row for each character."""
    return aln.select("locus", F.posexplode(F.split("seq", "")).alias("pos", "base")).filter("base <> ''")


def site_states_sql(aln: DataFrame, datatype: str = "dna") -> DataFrame:
    """As `site_states`, from one row for each character."""
    by_base = site_rows(aln).groupBy("locus", "pos", "base").agg(F.count("*").alias("n"))
    state = ~F.col("base").isin(*seqs.AA_AMBIGUOUS) if datatype == "aa" else F.col("base").isin(*seqs.DNA_STATES)
    return by_base.groupBy("locus", "pos").agg(
        F.count_if(state).cast("int").alias("n_states"),
        F.count_if(state & (F.col("n") >= 2)).cast("int").alias("n_twice"),
        F.sum(F.when(F.col("base").isin(*seqs.MISSING), F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum("n").alias("n_rows"),
    )


def with_shares(sums: DataFrame) -> DataFrame:
    """The shares of the three kinds of sites among those that count."""
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("site_count").cast("double"))
    return sums.withColumns({"prop_cons": share("conserved"), "prop_var": share("variable"), "prop_pinf": share("pars_inf")})


def locus_sites(aln: DataFrame, datatype: str = "dna", fold_case: bool = False) -> DataFrame:
    """locus, site_count, conserved, variable, pars_inf and their shares of the site count. Sites without any state are not counted; a locus without any position has no row."""
    return with_shares(locus_sums(aln, datatype, fold_case=fold_case).filter("nchar > 0").select("locus", *SUMS))


def site_pinf_counts(aln: DataFrame, datatype: str = "dna") -> DataFrame:
    """locus, pos, n_twice of the sites with at least two states that occur twice."""
    return site_states(aln, datatype).filter("n_twice >= 2").select("locus", "pos", "n_twice")


def site_missing(aln: DataFrame) -> DataFrame:
    """locus, pos, prop_missing: the share of the sequences that reach a site, in an alignment all, that have no data there."""
    return site_states(aln).select("locus", "pos", (F.col("n_missing") / F.col("n_rows")).alias("prop_missing"))
