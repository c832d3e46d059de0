"""Summaries of reads and contigs, and alignments out of MAF blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospark.functions import seqs
from phylospark.functions.batches import text_bytes
from phylospark.operators.ranges import join_same, running_sum
from phylospark.operators.stats import ratio
from phylospark.runtime import is_small, materialize

LOW_Q = 20
THRESHOLDS = (750, 1000, 1500)

# --- reads: columns path, seq, qual


def read_counts(reads: DataFrame) -> DataFrame:
    """path, read_count."""
    return reads.groupBy("path").agg(F.count("*").alias("read_count"))


_LETTERS = "GCAT"
_KIND = np.full(256, 5, dtype=np.int64)  # 0 to 3: G, C, A, T in either case; 4: N; 5: others
for _k, _c in enumerate(_LETTERS + "N"):
    _KIND[[ord(_c), ord(_c.lower())]] = _k
_SUMS = ["read_count", "base_count", *(f"{c}_count" for c in "gcatn"), "_qn", "_qs", "low_qscore"]
_LOWS, _HIGHS = ["min_read_len", "min_qscore"], ["max_read_len", "max_qscore"]
NO_LOW, NO_HIGH = 1 << 60, -1


def _quality(data: np.ndarray) -> np.ndarray:
    """Qualities of their characters: the code less 33. A character above 'J' raises."""
    if data.size and data.max() > 74:
        raise ValueError("a quality character above J")
    return data.astype(np.int64) - 33


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by path of each batch of reads: histograms of (path, kind of base) and of (path, quality)."""
    for b in batches:
        if not b.num_rows:
            continue
        paths = b.column(0).dictionary_encode(null_encoding="encode")
        of, n = paths.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(paths.dictionary)
        bases, sizes = text_bytes(b.column(1))
        kinds = np.bincount(np.repeat(of, sizes) * 6 + _KIND[bases], minlength=n * 6).reshape(n, 6)
        quals, sizes = text_bytes(b.column(2))
        q = np.bincount(np.repeat(of, sizes) * 256 + (_quality(quals) + 128), minlength=n * 256).reshape(n, 256)
        value = np.arange(256) - 128
        length = pc.utf8_length(b.column(1))
        known = pc.is_valid(length).to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = np.full(n, NO_LOW), np.full(n, NO_HIGH)
        np.minimum.at(low, of[known], lengths[known])
        np.maximum.at(high, of[known], lengths[known])
        some = q.any(axis=1)
        total = np.zeros(n, dtype=np.int64)
        np.add.at(total, of, lengths)
        cols = {
            "read_count": np.bincount(of, minlength=n), "base_count": total, **{f"{c}_count": kinds[:, k] for k, c in enumerate("gcatn")},
            "_qn": q.sum(axis=1), "_qs": q @ value, "low_qscore": q[:, value < LOW_Q].sum(axis=1),
            "min_read_len": low, "min_qscore": np.where(some, value[(q > 0).argmax(axis=1)], NO_LOW),
            "max_read_len": high, "max_qscore": np.where(some, value[255 - (q[:, ::-1] > 0).argmax(axis=1)], NO_HIGH),
        }
        names = [*_SUMS, *_LOWS, *_HIGHS]
        yield pa.RecordBatch.from_arrays([paths.dictionary.cast(pa.string()), *(pa.array(cols[c].astype(np.int64)) for c in names)], names=["path", *names])


def read_summary(reads: DataFrame) -> DataFrame:
    """One row a file: counts, lengths, bases, contents and qualities. One pass over the reads; each Arrow batch becomes a row for each file in it."""
    ddl = "path string, " + ", ".join(f"{c} bigint" for c in (*_SUMS, *_LOWS, *_HIGHS))
    out = reads.select("path", "seq", "qual").mapInArrow(_summary, ddl).groupBy("path").agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.min(c).alias(c) for c in _LOWS], *[F.max(c).alias(c) for c in _HIGHS])
    out = out.withColumns({c: F.when(F.col(c) < NO_LOW, F.col(c)) for c in _LOWS} | {c: F.when(F.col(c) > NO_HIGH, F.col(c)) for c in _HIGHS})
    gc, at = F.col("g_count") + F.col("c_count"), F.col("a_count") + F.col("t_count")
    out = out.withColumns({"mean_read_len": ratio("base_count", "read_count"), "gc_count": gc, "at_count": at, "gc_content": ratio(gc, "base_count"), "at_content": ratio(at, "base_count"), "n_content": ratio("n_count", "base_count"), "mean_qscore": ratio("_qs", "_qn")})
    return out.drop("_qn", "_qs")


def quality_histogram(reads: DataFrame) -> DataFrame:
    """path, q, n: how often each quality occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).dictionary_encode(null_encoding="encode")
            of, n = paths.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(paths.dictionary)
            quals, sizes = text_bytes(b.column(1))
            counts = np.bincount(np.repeat(of, sizes) * 256 + _quality(quals) + 128, minlength=n * 256)
            at = np.flatnonzero(counts)
            path = paths.dictionary.cast(pa.string()).take(pa.array(at // 256))
            yield pa.RecordBatch.from_arrays([path, pa.array((at % 256 - 128).astype(np.int32)), pa.array(counts[at].astype(np.int64))], names=["path", "q", "n"])

    return reads.filter("qual <> ''").select("path", "qual").mapInArrow(run, "path string, q int, n bigint").groupBy("path", "q").agg(F.sum("n").alias("n"))


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by path and position of each batch of reads, for the positions that any of its reads of the path has."""
    for b in batches:
        if not b.num_rows:
            continue
        paths = b.column(0).dictionary_encode(null_encoding="encode")
        of, n = paths.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(paths.dictionary)
        bases, sizes = text_bytes(b.column(1))
        quals, q_sizes = text_bytes(b.column(2))
        longest = np.zeros(n, dtype=np.int64)
        np.maximum.at(longest, of, sizes)
        first = np.concatenate([[0], np.cumsum(longest)])
        total = int(first[-1])

        def cells(sizes: np.ndarray) -> np.ndarray:
            """For each byte its cell: where its path begins, and its position in the read."""
            start = np.repeat(np.cumsum(sizes) - sizes, sizes)
            return np.repeat(first[of], sizes) + np.arange(int(sizes.sum())) - start

        at = cells(sizes)
        counts = np.bincount(at * 6 + _KIND[bases], minlength=total * 6).reshape(total, 6)
        inside = np.arange(len(quals)) - np.repeat(np.cumsum(q_sizes) - q_sizes, q_sizes) < np.repeat(sizes, q_sizes)  # qualities behind a shorter sequence do not count
        q_at, q = cells(q_sizes)[inside], _quality(quals)[inside]
        low, high = np.full(total, NO_LOW), np.full(total, -NO_LOW)
        np.minimum.at(low, q_at, q)
        np.maximum.at(high, q_at, q)
        cols = {"pos": np.arange(total) - np.repeat(first[:-1], longest) + 1, **{f"{c}_count": counts[:, k] for k, c in enumerate("gcat")}, "_n": np.bincount(q_at, minlength=total), "_s": np.bincount(q_at, weights=q, minlength=total), "_lo": low, "_hi": high}
        path = paths.dictionary.cast(pa.string()).take(pa.array(np.repeat(np.arange(n), longest)))
        yield pa.RecordBatch.from_arrays([path, *(pa.array(v.astype(np.int64)) for v in cols.values())], names=["path", *cols])


def read_positions(reads: DataFrame) -> DataFrame:
    """path, pos (from 1), counts of G, C, A, T, their shares among these four, mean, least and most quality. Positions count bytes, which for
    sequences are characters."""
    sums = ["g_count", "c_count", "a_count", "t_count", "_n", "_s"]
    ddl = "path string, pos bigint, " + ", ".join(f"{c} bigint" for c in (*sums, "_lo", "_hi"))
    rows = reads.filter("seq is not null").select("path", "seq", "qual").mapInArrow(_positions, ddl)
    out = rows.groupBy("path", F.col("pos").cast("int").alias("pos")).agg(*[F.sum(c).alias(c) for c in sums], F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    out = out.withColumns({"min_qscore": F.when(F.col("_n") > 0, F.col("_lo")), "max_qscore": F.when(F.col("_n") > 0, F.col("_hi"))})
    total = F.col("g_count") + F.col("c_count") + F.col("a_count") + F.col("t_count")
    return out.withColumns({f"{c}_prop": ratio(f"{c}_count", total) for c in "gcat"} | {"mean_qscore": ratio("_s", "_n")}).drop("_s", "_n", "_lo", "_hi")


# --- contigs: columns path, seq


def contig_summary(contigs: DataFrame) -> DataFrame:
    """One row an assembly: bases, contents over known bases, lengths with unknown ones, median, deviation, N50/N75/N90, numbers of long contigs.

    Median and N statistics come from the counts of contigs by length, with running sums over ranges, one sort for both: an assembly of any size is spread.
    """
    up = F.upper("seq")
    n = F.length("seq").cast("bigint")
    rows = contigs.select("path", n.alias("len"), *[seqs.count_of(up, c).alias(f"_{c}") for c in "GCATN"])
    base = rows.groupBy("path").agg(
        F.count("*").alias("contig_count"), F.count("len").alias("_known"), *[F.sum(f"_{c}").alias(f"{c.lower()}_count") for c in "GCATN"],
        F.sum("len").alias("len_sum"), F.min("len").alias("len_min"), F.max("len").alias("len_max"), F.stddev_samp("len").alias("len_stdev"),
        *[F.count_if(F.col("len") > t).alias(f"contig_{t}") for t in THRESHOLDS],
    )
    nucleotide = F.col("g_count") + F.col("c_count") + F.col("a_count") + F.col("t_count")
    base = base.withColumns({"nucleotide": nucleotide, "base_count": nucleotide + F.col("n_count")})
    base = base.withColumns({"gc_content": ratio(F.col("g_count") + F.col("c_count"), "base_count"), "at_content": ratio(F.col("a_count") + F.col("t_count"), "base_count"), "len_mean": ratio("len_sum", "contig_count")})
    base = materialize(base, "assemblies")
    lengths = contigs.select("path", n.alias("len")).filter("len is not null").groupBy("path", "len").agg(F.count("*").alias("_n"))
    down = lengths.withColumn("_down", -F.col("len")).withColumn("_sum", F.col("len") * F.col("_n"))
    r = running_sum(down, ["path"], ["_down"], ["_n", "_sum"], ["_upto", "_reached"], cut="lengths")
    r = join_same(r, base.select("path", F.col("_known").alias("_all"), F.col("len_sum").alias("_total")), ["path"], small=is_small(base))
    found = r.groupBy("path").agg(*_n_columns("_reached", "_total"), _median_column())
    return join_same(base.drop("_known"), found, ["path"])


def _median_column() -> Column:
    """The middle length, or the mean of the two, of rows with _n lengths each up to the rank _upto of _all; from either end."""
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    has = lambda k: (k <= F.col("_upto")) & (k > F.col("_upto") - F.col("_n"))
    return ((F.max(F.when(has(low), F.col("len"))) + F.max(F.when(has(high), F.col("len")))) / 2.0).alias("len_median")


def _n_columns(reached: str, total: str) -> list[Column]:
    at = lambda p: F.max(F.when(F.col(reached) >= F.floor(F.col(total) * F.lit(p)), F.col("len")))
    return [at(0.5).alias("n50"), at(0.75).alias("n75"), at(0.9).alias("n90")]


def medians(lengths: DataFrame) -> DataFrame:
    """path, len_median from path, len, _n: the middle value, or the mean of the two."""
    return running_sum(lengths, ["path"], ["len"], "_n", out="_upto", total="_all", cut="medians").groupBy("path").agg(_median_column())


def n_stats(lengths: DataFrame) -> DataFrame:
    """path, n50, n75, n90 from path, len, _n: going down from the longest, the length at which the sum reaches that share (cut to a whole number) of all."""
    w = lengths.withColumn("_down", -F.col("len")).withColumn("_sum", F.col("len") * F.col("_n"))
    return running_sum(w, ["path"], ["_down"], "_sum", out="_upto", total="_all", cut="nstats").groupBy("path").agg(*_n_columns("_upto", "_all"))


# --- MAF blocks: columns path, block_idx, score, sequences (source, start, size, strand, src_size, text)


def maf_rows(blocks: DataFrame) -> DataFrame:
    """path, block_idx, name (the block's first source), seq_idx, taxon, seq: every block as an alignment of its own."""
    rows = blocks.select("path", "block_idx", F.get(F.col("sequences"), F.lit(0))["source"].alias("name"), F.posexplode("sequences").alias("seq_idx", "s"))
    return rows.select("path", "block_idx", "name", "seq_idx", F.col("s.source").alias("taxon"), F.col("s.text").alias("seq"))


def maf_named(blocks: DataFrame, bed: DataFrame, append: bool = False, by_chrom: bool = False) -> DataFrame:
    """path, block_idx, locus, seq_idx, taxon, seq, is_missing: blocks named name-chrom-start-end by the BED record that starts where the first source does.

    Blocks without a record are named by their source with is_missing. Several blocks of one name: the last row of each taxon
    wins, or all are put behind one another if append. by_chrom: the record's chrom must be the end of the source's name too. If several
    records start there, the first by chrom, end and name counts.
    """
    first = F.get(F.col("sequences"), F.lit(0))
    b = blocks.withColumn("_start", first["start"]).withColumn("_source", first["source"])
    keys = ["chrom_start", "chrom"] if by_chrom else ["chrom_start"]
    r = bed.groupBy(*keys).agg(F.min(F.struct("chrom", "chrom_end", "name")).alias("_r"))
    on = F.col("_start") == F.col("chrom_start")
    if by_chrom:
        on = on & (F.substring_index("_source", ".", -1) == F.col("chrom"))
    j = b.join(r, on, "left")
    name = F.concat_ws("-", F.col("_r.name"), F.col("_r.chrom"), F.col("_start").cast("string"), F.col("_r.chrom_end").cast("string"))
    locus = F.replace(F.coalesce(F.when(F.col("_r").isNotNull(), name), F.col("_source")), F.lit("."), F.lit("_"))
    rows = j.select("path", "block_idx", locus.alias("locus"), F.col("_r").isNull().alias("is_missing"), F.posexplode("sequences").alias("seq_idx", "s"))
    rows = rows.select("path", "block_idx", "locus", "seq_idx", F.col("s.source").alias("taxon"), F.col("s.text").alias("seq"), "is_missing")
    keys = ["locus", "taxon"]
    if append:
        return rows.groupBy(*keys, "is_missing").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "block_idx", "seq_idx", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    last = F.max_by(F.struct("path", "block_idx", "seq_idx", "seq"), F.struct("path", "block_idx", "seq_idx"))
    return rows.groupBy(*keys, "is_missing").agg(last.alias("r")).select("locus", "taxon", "is_missing", "r.block_idx", "r.seq")
