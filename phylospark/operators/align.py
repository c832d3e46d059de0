"""Operators on whole alignments: filters of loci, concatenation, splitting, trimming, unaligning.

Locus-level decisions are small tables keyed by locus; the sequences meet them in one semi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from phylospark.functions import seqs
from phylospark.operators import sites, stats
from phylospark.operators.ranges import join_skewed, previous, running_sum
from phylospark.runtime import BROADCAST_ROWS, is_small, long_values, materialize


class NothingLeft(ValueError):
    """No alignment passed a filter."""


# --- filters


def keep_loci(aln: DataFrame, loci: DataFrame) -> DataFrame:
    return aln.join(loci.select("locus"), "locus", "left_semi")


def not_empty(aln: DataFrame) -> DataFrame:
    """The frame itself; raises if it has no row. Runs it up to the first one."""
    if aln.isEmpty():
        raise NothingLeft("no alignments left")
    return aln


def loci_min_taxa(aln: DataFrame, n: int) -> DataFrame:
    return stats.headers(aln).filter(F.col("ntax") >= n)


def loci_percent_taxa(aln: DataFrame, percents: list[float]) -> DataFrame:
    """percent, locus: loci with at least floor(all ids * percent) taxa, for each percent. One row of totals is all that is multiplied."""
    total = stats.unique_ids(aln).agg(F.count("*").alias("_total"))
    at = stats.headers(aln).crossJoin(F.broadcast(total)).withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    return at.filter(F.col("ntax") >= F.floor(F.col("_total") * F.col("percent"))).select("percent", "locus")


def loci_min_len(aln: DataFrame, n: int) -> DataFrame:
    return stats.headers(aln).filter(F.col("nchar") >= n)


def loci_max_len(aln: DataFrame, n: int) -> DataFrame:
    return stats.headers(aln).filter(F.col("nchar") <= n)


def loci_min_pinf(aln: DataFrame, n: int, datatype: str = "dna") -> DataFrame:
    return _pinf(aln, datatype).filter(F.col("pars_inf") >= n)


def loci_max_pinf(aln: DataFrame, n: int, datatype: str = "dna") -> DataFrame:
    return _pinf(aln, datatype).filter(F.col("pars_inf") <= n)


def _pinf(aln: DataFrame, datatype: str) -> DataFrame:
    """locus, pars_inf for every locus, also those without any site."""
    return sites.locus_sums(aln, datatype).select("locus", "pars_inf")


def loci_percent_pinf(aln: DataFrame, percent: float, datatype: str = "dna") -> DataFrame:
    """Loci with at least floor(the most of any locus * percent) informative sites."""
    p = materialize(_pinf(aln, datatype), "pinf")  # a row for each locus
    most = p.agg(F.max("pars_inf").alias("_most"))  # one row
    return p.crossJoin(F.broadcast(most)).filter(F.col("pars_inf") >= F.floor(F.col("_most") * F.lit(float(percent)))).select("locus", "pars_inf")


def loci_max_missing(aln: DataFrame, percent: float) -> DataFrame:
    """Loci with at most this share of missing data."""
    n = aln.groupBy("locus").agg(F.sum(seqs.missing(F.col("seq"))).alias("missing"), (F.max(F.length("seq")).cast("bigint") * F.count("*")).alias("total"))
    return n.filter(F.coalesce(stats.ratio("missing", "total"), F.lit(0.0)) <= F.lit(float(percent)))


def loci_with_all(aln: DataFrame, ids: list[str]) -> DataFrame:
    """Loci that contain every listed id."""
    wanted = sorted(set(ids))
    return aln.filter(F.col("taxon").isin(wanted)).groupBy("locus").agg(F.countDistinct("taxon").alias("n")).filter(F.col("n") == len(wanted))


#: In the order in which one wins over the next if several are given.
FILTERS = ["percent", "max_len", "min_len", "max_pinf", "min_pinf", "percent_inf", "taxon_all", "missing_data", "min_ntax"]


def filter_loci(aln: DataFrame, datatype: str = "dna", **options) -> DataFrame:
    """The alignments that pass the one criterion that wins among those given (see FILTERS)."""
    given = [f for f in FILTERS if options.get(f) is not None]
    unknown = set(options) - set(FILTERS)
    if unknown or not given:
        raise ValueError(f"unknown filters {sorted(unknown)}" if unknown else "no filter given")
    name, v = given[0], options[given[0]]
    loci = {
        "percent": lambda: loci_percent_taxa(aln, [v]),
        "max_len": lambda: loci_max_len(aln, v),
        "min_len": lambda: loci_min_len(aln, v),
        "max_pinf": lambda: loci_max_pinf(aln, v, datatype),
        "min_pinf": lambda: loci_min_pinf(aln, v, datatype),
        "percent_inf": lambda: loci_percent_pinf(aln, v, datatype),
        "taxon_all": lambda: loci_with_all(aln, v),
        "missing_data": lambda: loci_max_missing(aln, v),
        "min_ntax": lambda: loci_min_taxa(aln, v),
    }[name]()
    return keep_loci(aln, loci)


# --- concatenation


def partitions(aln: DataFrame, codon: bool = False) -> DataFrame:
    """part_idx, gene, start, end (1-based, both included): the loci in natural order, one behind the other.

    With codon, three rows a locus, each from one of its first three positions on, with codon_pos. Offsets are running sums over ranges of
    loci, so that there may be any number of them.
    """
    h = stats.headers(aln).select(F.col("locus").alias("gene"), "nchar", seqs.natural_key(F.col("locus")).alias("_key"), F.lit(1).cast("bigint").alias("_one"))
    p = running_sum(h, [], ["_key", "gene"], ["_one", "nchar"], ["_row", "end"], cut="partitions")
    p = p.select((F.col("_row") - 1).alias("part_idx"), "gene", (F.col("end") - F.col("nchar") + 1).alias("start"), "end")
    return codon_positions(p) if codon else p


def codon_positions(parts: DataFrame) -> DataFrame:
    """A row for each of the three codon positions of each part: its start is that much later."""
    return parts.withColumn("codon_pos", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("start", F.col("start") + F.col("codon_pos") - 1)


def segments(aln: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """taxon, part_idx, gene, start, end, seq: the concatenated alignment without the stretches that a taxon lacks."""
    parts = partitions(aln) if parts is None else parts
    return aln.join(parts, F.col("locus") == F.col("gene")).select("taxon", "part_idx", "gene", "start", "end", "seq")


def concat(aln: DataFrame) -> DataFrame:
    """taxon, seq: one sequence for each taxon over all loci, '?' where it has none.

    No table of all taxa and loci is made: a taxon's sequences lie apart by what it lacks, which is filled in when they are put together.
    A concatenated sequence is one value, so it is here that a taxon's segments come together; `segments` is the form that grows.
    """
    parts = partitions(aln)
    return joined(segments(aln, parts), parts.agg(F.coalesce(F.max("end"), F.lit(0)).alias("_total")))


def joined(segs: DataFrame, total: DataFrame) -> DataFrame:
    """taxon, seq: the segments (taxon, start, end, seq) of each taxon put together, '?' between them and up to `_total`, which is the one row of the other frame."""
    by = segs.groupBy("taxon").agg(F.sort_array(F.collect_list(F.struct("start", "end", "seq"))).alias("s"))
    before = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(F.col("s"), i - 1)["end"])
    fill = lambda n: F.repeat(F.lit("?"), n.cast("int"))
    pieces = F.flatten(F.transform("s", lambda x, i: F.array(fill(x["start"] - before(i) - 1), x["seq"])))
    out = by.crossJoin(F.broadcast(total))
    # concat_ws sums up the lengths first, so that a long value is made once
    return long_values(out.select("taxon", F.concat_ws("", pieces, fill(F.col("_total") - F.get(F.col("s"), F.size("s") - 1)["end"])).alias("seq")))


# --- splitting

#: Parts of a block, and the columns of the pieces.
BLOCK_PARTS = 1_000
#: Characters of pieces that a task holds before it passes them on.
HELD_CHARS = 4_000_000
_PIECE = "locus string, seq_idx int, taxon string, seq string"


def split(aln: DataFrame, parts: DataFrame, prefix: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """locus, seq_idx, taxon, seq: the stretch of each part (gene, start, end) of each sequence; those without any data are dropped.

    The parts are a partition table, which describes one alignment. It is sent to all executors if it has at most so many rows, and each
    sequence is cut in one pass; a larger one is cut block by block. A part beyond a sequence raises.
    """
    rows = aln.filter("seq is not null").select(F.col("seq_idx").cast("int"), "taxon", "seq")
    named = parts.withColumn("gene", F.concat(F.lit(f"{prefix}_"), "gene")) if prefix else parts
    if not is_small(parts, broadcast_rows):
        return _split_blocks(rows, named)
    known = aln.sparkSession.sparkContext.broadcast(_bounds([tuple(r) for r in named.orderBy("part_idx").select("gene", "start", "end").collect()]))

    def pieces(idx: int, taxon: str, seq: str) -> Iterator[tuple]:
        for gene, piece in _cut(seq, *known.value):
            yield gene, idx, taxon, piece

    return _each(rows, pieces, _PIECE)


def _bounds(parts: list[tuple[str, int, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, starts (from 0) and ends (behind the last position) of parts."""
    return [g for g, _, _ in parts], np.array([s - 1 for _, s, _ in parts], dtype=np.int64), np.array([e for _, _, e in parts], dtype=np.int64)


def _cut(seq: str, names: list[str], starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, str]]:
    """(name, stretch) of the parts in which the sequence has data: they are found by a running count of its data, so that the others cost nothing."""
    if len(starts) and (starts.min() < 0 or ends.max() > len(seq)):
        wrong = int(np.flatnonzero((starts < 0) | (ends > len(seq)))[0])
        raise ValueError(f"a part beyond the alignment: {names[wrong]}")
    codes = np.frombuffer(seq.encode(), dtype=np.uint8) if seq.isascii() else np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    data = np.ones(len(codes), dtype=bool)
    for c in seqs.MISSING:
        data &= codes != ord(c)
    before = np.concatenate([[0], np.cumsum(data)])
    for k in np.flatnonzero(before[np.maximum(starts, ends)] > before[starts]):
        yield names[k], seq[starts[k] : ends[k]]


def _split_blocks(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The split by any number of parts. They are numbered by start over ranges and put in blocks of BLOCK_PARTS; all executors get one row
    a block, by which each sequence is cut into stretches, and a stretch meets only the parts of its block."""
    one = parts.select("gene", "start", "end", F.lit(1).cast("bigint").alias("_one"))
    numbered = running_sum(one, [], ["start", "end", "gene"], "_one", "_row", cut="split_parts").withColumn("block", F.floor((F.col("_row") - 1) / BLOCK_PARTS))
    blocks = numbered.groupBy("block").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.max_by("gene", "end").alias("last"), F.collect_list(F.struct("gene", "start", "end")).alias("parts"))
    blocks = materialize(blocks, "split_blocks")
    known = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in blocks.select("block", "lo", "hi", "last").collect()])

    def stretches(idx: int, taxon: str, seq: str) -> Iterator[tuple]:
        for block, lo, hi, last in known.value:
            for _, stretch in _cut(seq, *_bounds([(last, lo, hi)])):
                yield block, lo, idx, taxon, stretch

    def pieces(lo: int, idx: int, taxon: str, stretch: str, parts: list[dict]) -> Iterator[tuple]:
        for gene, piece in _cut(stretch, *_bounds([(p["gene"], p["start"] - lo + 1, p["end"] - lo + 1) for p in parts])):
            yield gene, idx, taxon, piece

    met = _each(rows, stretches, "block long, lo long, seq_idx int, taxon string, seq string").join(blocks.select("block", "parts"), "block")
    return _each(met.select("lo", "seq_idx", "taxon", "seq", "parts"), pieces, _PIECE)


def _each(rows: DataFrame, made: Callable[..., Iterator[tuple]], ddl: str) -> DataFrame:
    """The rows that a function makes of the columns of each row, passed on when they have HELD_CHARS characters."""
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = zip(*out) if out else [[]] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            out.clear()
            return batch

        for b in batches:
            for k in range(b.num_rows):  # a row may hold a long sequence
                for row in made(*(c[k].as_py() for c in b.columns)):
                    out.append(row)
                    size += len(row[-1])
                    if size > HELD_CHARS:
                        yield flush()
                        size = 0
        yield flush()

    return rows.mapInArrow(run, ddl)


#: Positions of a stretch, by which segments and parts find each other.
STRETCH = 2_000


def split_segments(segs: DataFrame, parts: DataFrame) -> DataFrame:
    """locus, taxon, seq: what `split` makes of the concatenated alignment, out of its `segments` (taxon, start, end, seq), so that what taxa lack is never made.

    Both are found by positions alone: segments are cut at every STRETCH positions, a stretch meets the parts that overlap it, and what a part has of a
    taxon is put together, '?' where there is none. part_idx must be unique. A part beyond the alignment raises, and so does a segment of another length than its stretch.
    """
    at = lambda c: F.floor((F.col(c) - 1) / STRETCH)
    beyond = lambda fine, gene: F.when(fine, F.col("end")).otherwise(F.raise_error(F.concat(F.lit("a part beyond the alignment: "), gene)))
    total = segs.agg(F.coalesce(F.max("end"), F.lit(0)).alias("_total"))  # one row
    known = parts.select("part_idx", "gene", "start", "end").crossJoin(F.broadcast(total))
    known = known.withColumn("end", beyond((F.col("start") >= 1) & (F.col("end") <= F.col("_total")), F.col("gene"))).filter("start <= end")
    known = materialize(known.select("part_idx", F.col("gene").alias("locus"), F.col("start").alias("_from"), F.col("end").alias("_to"), F.explode(F.sequence(at("start"), at("end"))).alias("_of")), "split_parts")
    cut = segs.withColumn("end", beyond(F.length("seq") == F.col("end") - F.col("start") + 1, F.concat(F.col("taxon"), F.lit(" at "), F.col("start").cast("string"))))
    cut = cut.select("taxon", "start", "end", "seq", F.explode(F.sequence(at("start"), at("end"))).alias("_at"))
    cut = cut.withColumns({"_lo": F.greatest("start", F.col("_at") * STRETCH + 1), "_hi": F.least("end", (F.col("_at") + 1) * STRETCH)})
    piece = lambda seq, lo, hi, first: F.substring(seq, (lo - first + 1).cast("int"), (hi - lo + 1).cast("int"))
    cut = cut.select("taxon", "_at", "_lo", "_hi", piece(F.col("seq"), F.col("_lo"), F.col("_hi"), F.col("start")).alias("_piece"))
    met = join_skewed(cut, "_at", known, "_of", "inner", (F.col("_from") <= F.col("_hi")) & (F.col("_to") >= F.col("_lo")), small=is_small(known))
    lo, hi = F.greatest("_lo", "_from"), F.least("_hi", "_to")
    met = met.select("part_idx", "locus", "_from", "_to", "taxon", lo.alias("lo"), hi.alias("hi"), piece(F.col("_piece"), lo, hi, F.col("_lo")).alias("piece"))
    by = met.groupBy("part_idx", "locus", "_from", "_to", "taxon").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "piece"))).alias("s"))
    before = lambda i: F.when(i == 0, F.col("_from") - 1).otherwise(F.get(F.col("s"), i - 1)["hi"])
    fill = lambda n: F.repeat(F.lit("?"), n.cast("int"))
    pieces = F.flatten(F.transform("s", lambda x, i: F.array(fill(x["lo"] - before(i) - 1), x["piece"])))
    out = by.select("locus", "taxon", F.concat_ws("", pieces, fill(F.col("_to") - F.get(F.col("s"), F.size("s") - 1)["hi"])).alias("seq"))
    return out.filter(seqs.ungapped(F.col("seq")) != "")


# --- trimming


#: Loci up to which the masks of all of them, an eighth of a sequence each, are sent to all executors.
SENT_MASKS = 10_000


def _picked(seq: pa.Array, masks: pa.Array) -> pa.Array:
    """The characters of each sequence that its masks keep; the whole sequence where there are no masks."""
    out = []
    for s, m in zip(seq.to_pylist(), masks.to_pylist()):
        if s is None or m is None:
            out.append(s)
            continue
        keep = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8)) for x in m])[: len(s)].astype(bool) if m else np.zeros(0, dtype=bool)
        if s.isascii():
            out.append(np.frombuffer(s.encode(), dtype=np.uint8)[: len(keep)][keep].tobytes().decode())
        else:
            out.append("".join(s[i] for i in np.flatnonzero(keep)))
    return pa.array(out, pa.string())


def _trimmed(aln: DataFrame, masks: DataFrame, all_gone: str) -> DataFrame:
    """The sites of each locus that its masks keep. Of a locus without any, all sequences are kept as they are ('stay') or dropped ('drop')."""
    masks = materialize(masks, "masks")
    small = is_small(masks, SENT_MASKS)
    known = masks.filter("n_kept > 0").select(F.col("locus").alias("_of"), "masks")
    pick = F.arrow_udf("string")(_picked)
    rows = join_skewed(aln, "locus", known, "_of", "inner", small=small)
    trimmed = rows.withColumn("seq", pick("seq", "masks")).drop("masks")
    if all_gone == "drop":
        return trimmed
    return trimmed.unionByName(join_skewed(aln, "locus", known.select("_of"), "_of", "left_anti", small=small))


def trim_missing(aln: DataFrame, percent: float) -> DataFrame:
    """Keep the sites with less than this share of missing data. A locus of which no site is left stays as it is."""
    share = float(percent)
    return _trimmed(aln, sites.site_masks(aln, lambda states, twice, missing, rows: missing / np.maximum(rows, 1) < share), "stay")


def trim_pinf(aln: DataFrame, least: int, datatype: str = "dna") -> DataFrame:
    """Keep the informative sites with at least so many states that occur twice. A locus of which none is left is dropped."""
    return _trimmed(aln, sites.site_masks(aln, lambda states, twice, missing, rows: twice >= max(2, least), datatype), "drop")


def trim_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """locus, ntax, before, after, removed: numbers of sites."""
    b = stats.headers(before).select("locus", "ntax", F.col("nchar").alias("before"))
    a = stats.headers(after).select("locus", F.col("nchar").alias("after"))
    out = b.join(a, "locus", "left").withColumn("after", F.coalesce("after", F.lit(0).cast("bigint")))
    return out.withColumn("removed", F.col("before") - F.col("after"))


# --- rewriting


def unalign(aln: DataFrame) -> DataFrame:
    """All gaps and missing data removed. A projection."""
    return aln.withColumn("seq", seqs.ungapped(F.col("seq")))


def sort_by_id(aln: DataFrame) -> DataFrame:
    """seq_idx by the order of ids, byte for byte, within each locus. A locus of any size is spread over ranges."""
    one = aln.withColumn("_one", F.lit(1).cast("bigint"))
    order = ["taxon", "seq_idx"] if "seq_idx" in aln.columns else ["taxon"]
    ranked = running_sum(one, ["locus"], order, "_one", "_at", cut="sorted")
    return ranked.withColumn("seq_idx", (F.col("_at") - 1).cast("int")).drop("_one", "_at")


def violations(aln: DataFrame, datatype: str) -> DataFrame:
    """The sequences that have symbols outside of their type."""
    return aln.filter(~seqs.valid(F.col("seq"), datatype))


def contiguity(parts: DataFrame, by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """The parts that do not begin right behind the one before (the first one at 1), with `expected`, the start they should have. Tables of any size are spread."""
    rows = previous(parts, by or [], ["part_idx", "start", "end", *(tie or [])], "end", "_before", cut="parts")
    return rows.withColumn("expected", F.coalesce(F.col("_before") + 1, F.lit(1))).drop("_before").filter(~F.col("start").eqNullSafe(F.col("expected")))
