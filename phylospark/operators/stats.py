"""Summaries of alignments by locus, by taxon and of a whole dataset.

An alignment is a table with locus, seq_idx, taxon, seq: one row for each taxon of a locus. Symbols are counted in NumPy, an Arrow batch at a time, and
each batch goes on as one row for each key in it; where sites are counted as well, in their matrices. Ratios with a zero denominator are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phylospark.functions import seqs
from phylospark.operators import sites
from phylospark.functions.batches import text_bytes
from phylospark.operators.ranges import running_sum

#: Cells that a batch is counted in at once.
MOST_CELLS = 4_000_000


def symbols(datatype: str) -> str:
    return seqs.AA_SYMBOLS if datatype == "aa" else seqs.DNA_SYMBOLS


def ratio(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def headers(aln: DataFrame) -> DataFrame:
    """locus, ntax, nchar, aligned."""
    n = F.length("seq")
    return aln.groupBy("locus").agg(F.count("*").alias("ntax"), F.max(n).cast("bigint").alias("nchar"), (F.max(n) == F.min(n)).alias("aligned"))


_UPPER = np.arange(256, dtype=np.int64)
_UPPER[ord("a") : ord("z") + 1] -= 32
_KINDS = {"missing": seqs.MISSING, "gc": "GC", "at": "AT", "nucleotides": "GCAT"}


def _count_columns(datatype: str) -> dict[str, list[int]]:
    """By column, the codes of the symbols that it counts."""
    return {k: [ord(c) for c in v] for k, v in _KINDS.items()} | {f"sym_{c}": [ord(c)] for c in symbols(datatype)}


def char_counts(aln: DataFrame, keys: list[str], datatype: str, each: bool = False) -> DataFrame:
    """keys, n (rows), len_sum, len_max, missing, gc, at, nucleotides, sym_<symbol> (in either case): one row for each key of a batch, to be summed up, or,
    with `each`, one for each row. Null sequences count as rows only."""
    columns = _count_columns(datatype)
    rows = aln.select(*keys, "seq")
    names = ["n", "len_sum", "len_max", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if each:
                at = of = np.arange(b.num_rows)
            else:
                code = np.zeros(b.num_rows, dtype=np.int64)
                for c in b.columns[:-1]:
                    d = c.dictionary_encode(null_encoding="encode")
                    code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
                    _, at, code = np.unique(code, return_index=True, return_inverse=True)
                of = code
            n = len(at)
            seq = pc.fill_null(b.column(b.num_columns - 1), "")
            length = pc.utf8_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
            data, sizes = text_bytes(seq)
            if data.size and data.max() > 127:  # a symbol outside of ASCII may have one inside as its upper case
                data, sizes = text_bytes(pc.utf8_upper(seq))
            table = np.zeros((n, 256), dtype=np.int64)
            width = max(1, MOST_CELLS // max(1, int(sizes.max(initial=0))))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for i in range(0, b.num_rows, width):  # so many rows that the index of their bytes stays small
                j = min(i + width, b.num_rows)
                here = _UPPER[data[ends[i] : ends[j]]] + 256 * np.repeat(of[i:j], sizes[i:j])
                if len(here) * 8 > n * 256:
                    table += np.bincount(here, minlength=n * 256).reshape(n, 256)
                else:
                    np.add.at(table.reshape(-1), here, 1)
            most = np.zeros(n, dtype=np.int64)
            np.maximum.at(most, of, length)
            values = [np.bincount(of, minlength=n), np.bincount(of, weights=length, minlength=n), most, *(table[:, c].sum(axis=1) for c in columns.values())]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns[:-1]), *(pa.array(v.astype(np.int64)) for v in values)], names=[*b.schema.names[:-1], *names])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"`{c}` bigint" for c in names])
    return rows.mapInArrow(run, ddl)


def _sums(datatype: str) -> list[Column]:
    return [F.sum(F.col(f"`{c}`")).alias(c) for c in _count_columns(datatype)]


def locus_chars(aln: DataFrame, datatype: str = "dna") -> DataFrame:
    """locus, ntax, nchar, total_chars, missing, gc, at, nucleotides, sym_<symbol>."""
    out = char_counts(aln, ["locus"], datatype).groupBy("locus").agg(F.sum("n").alias("ntax"), F.max("len_max").alias("nchar"), *_sums(datatype))
    return out.withColumn("total_chars", F.col("ntax") * F.col("nchar"))


def locus_summary(aln: DataFrame, datatype: str = "dna") -> DataFrame:
    """One row for each locus with the columns of the locus summary file (see `sinks.csv_columns`), all from the site matrices: one pass, one shuffle.
    The numbers of sites are null for a locus without any position."""
    columns = _count_columns(datatype)
    every = "".join(sorted({chr(c) for cs in columns.values() for c in cs}))
    sums = sites.locus_sums(aln, datatype, every)
    sums = sites.with_shares(sums.withColumns({c: F.when(F.col("nchar") > 0, F.col(c)) for c in sites.SUMS}))
    counts = {k: reduce(lambda a, b: a + b, [F.col(f"n_{c}") for c in cs]) for k, cs in columns.items()}
    out = sums.withColumn("total_chars", F.col("ntax") * F.col("nchar")).withColumns(counts).drop(*[f"n_{ord(c)}" for c in every])
    return out.withColumn("prop_missing", ratio("missing", "total_chars"))


_PROPS = {"prop_missing": "missing", "gc_content": "gc", "at_content": "at", "prop_nucleotides": "nucleotides"}


def taxon_summary(aln: DataFrame, datatype: str = "dna") -> DataFrame:
    """taxon, locus_counts, total_chars, missing, proportions, and counts by symbol over all loci."""
    by = char_counts(aln, ["taxon", "locus"], datatype).groupBy("taxon", "locus").agg(F.sum("len_sum").alias("total_chars"), *_sums(datatype))
    out = by.groupBy("taxon").agg(F.count("locus").alias("locus_counts"), F.sum("total_chars").alias("total_chars"), *_sums(datatype))
    return out.withColumns({k: ratio(c, "total_chars") for k, c in _PROPS.items()})


def per_locus_taxon(aln: DataFrame, datatype: str = "dna") -> DataFrame:
    """As taxon_summary for each sequence of each locus; a map, no shuffle."""
    out = char_counts(aln, ["locus", "taxon"], datatype, each=True).drop("n", "len_max").withColumnRenamed("len_sum", "total_chars")
    return out.withColumns({k: ratio(c, "total_chars") for k, c in _PROPS.items()})


def char_histogram(aln: DataFrame, by: str = "locus") -> DataFrame:
    """by, symbol, n: how often each symbol occurs, in upper case; any symbol, also those outside of the alphabets."""
    return aln.select(by, F.explode(F.split(F.upper("seq"), "")).alias("symbol")).filter("symbol <> ''").groupBy(by, "symbol").agg(F.count("*").alias("n"))


def dataset_site_summary(locus: DataFrame) -> DataFrame:
    """One row over the loci of `locus_sites`. The means of the three kinds are their shares of all sites."""
    kinds = {"cons": "conserved", "var": "variable", "inf": "pars_inf"}
    out = locus.agg(
        F.count("*").alias("loci"), F.sum("site_count").alias("total_sites"), F.min("site_count").alias("min_sites"), F.max("site_count").alias("max_sites"),
        *[f for k, c in kinds.items() for f in (F.count_if(F.col(c) > 0).alias(f"{k}_loci"), F.sum(c).alias(f"total_{k}"), F.min(c).alias(f"min_{k}"), F.max(c).alias(f"max_{k}"))],
    )
    out = out.withColumn("mean_sites", ratio("total_sites", "loci"))
    for k in kinds:
        out = out.withColumns({f"prop_{k}_loci": ratio(f"{k}_loci", "loci"), f"prop_{k}": ratio(f"total_{k}", "total_sites"), f"mean_{k}": ratio(f"total_{k}", "total_sites")})
    return out


def dataset_char_summary(locus: DataFrame, datatype: str = "dna") -> DataFrame:
    """One row over the loci of `locus_chars`."""
    out = locus.agg(
        F.min("ntax").alias("min_tax"), F.max("ntax").alias("max_tax"), F.sum("ntax").alias("_tax"), F.count("*").alias("_loci"),
        *[F.sum(F.col(f"`{c}`")).alias(c) for c in ("total_chars", "missing", "gc", "at", "nucleotides", *(f"sym_{s}" for s in symbols(datatype)))],
    )
    out = out.withColumns({"mean_tax": ratio("_tax", "_loci"), "prop_missing": ratio("missing", "total_chars"), "gc_content": ratio("gc", "total_chars"), "at_content": ratio("at", "total_chars")})
    return out.drop("_tax", "_loci")


def matrix_completeness(header: DataFrame, total_taxa: DataFrame, step: int = 5) -> DataFrame:
    """percent, n_loci: loci with at least so many percent of all taxa, for 100, 100 - step, .. until all loci have.

    total_taxa: one row with total_taxa. The loci are first counted by their number of taxa, so that little is multiplied by the percents.
    """
    if step not in (1, 2, 5, 10):
        raise ValueError("the step is 1, 2, 5 or 10")
    by_size = header.groupBy("ntax").agg(F.count("*").alias("n"))
    at = by_size.crossJoin(F.broadcast(total_taxa)).withColumn("percent", F.explode(F.sequence(F.lit(100), F.lit(0), F.lit(-step))))  # one row
    need = F.floor(F.col("total_taxa") * (F.col("percent") / 100.0))
    counts = at.groupBy("percent").agg(F.sum(F.when(F.col("ntax") >= need, F.col("n")).otherwise(0)).alias("n_loci"), F.sum("n").alias("_all"))
    every = Window.orderBy(F.col("percent").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most 101 rows
    full = F.max(F.when(F.col("n_loci") == F.col("_all"), 1).otherwise(0)).over(every)
    return counts.withColumn("_full", F.coalesce(full, F.lit(0))).filter("_full = 0").select("percent", "n_loci")


def unique_ids(aln: DataFrame) -> DataFrame:
    return aln.select("taxon").distinct()


def id_map(aln: DataFrame) -> DataFrame:
    """locus, taxon: which locus has which id. The long form, which grows with the data; `id_map_wide` has it as rows over all ids."""
    return aln.select("locus", "taxon").distinct()


def id_map_wide(aln: DataFrame) -> DataFrame:
    """locus, present: for each of all ids in their order (byte for byte) a '1' if the locus has it, else a '0'. A row is as long as the list of ids, as
    is a line of the file it is for; no table of all loci and ids is made."""
    ids = running_sum(unique_ids(aln).withColumn("_one", F.lit(1).cast("bigint")), [], ["taxon"], "_one", "_at", cut="ids").select("taxon", "_at")
    total = ids.agg(F.coalesce(F.max("_at"), F.lit(0)).alias("_total"))  # one row
    by = id_map(aln).join(ids, "taxon").groupBy("locus").agg(F.sort_array(F.collect_list("_at")).alias("_s"))
    zeros = lambda n: F.repeat(F.lit("0"), n.cast("int"))
    before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("_s"), i - 1))
    ones = F.array_join(F.transform("_s", lambda x, i: F.concat(zeros(x - before(i) - 1), F.lit("1"))), "")
    return by.crossJoin(F.broadcast(total)).select("locus", F.concat(ones, zeros(F.col("_total") - F.get(F.col("_s"), F.size("_s") - 1))).alias("present"))
