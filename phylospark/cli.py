"""Command line: the commands of the operators over files. `python -m phylospark.cli --help`."""

from __future__ import annotations

import argparse
import glob
import logging
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.functions import seqs
from phylospark.functions.codes import DELTAS
from phylospark.operators import align, genomics, sequence, stats
from phylospark.runtime import qualified
from phylospark.session import local_session
from phylospark.sources import files, sinks

log = logging.getLogger("phylospark")
OUTPUTS = list(sinks.SEQUENCE_FORMATS)
FASTA = ["fasta", "fasta-int"]


# --- arguments


def _io(p: argparse.ArgumentParser, output: str, fmt: bool = True, out_fmt: bool = True, outputs: list[str] = OUTPUTS, first: str = "nexus", short: str = "-F") -> None:
    where = p.add_mutually_exclusive_group(required=True)
    where.add_argument("-d", "--dir", help="a folder with the input files")
    where.add_argument("-i", "--input", nargs="+", help="input files; wildcards are allowed")
    p.add_argument("-o", "--output", default=output)
    p.add_argument("--force", action="store_true", help="overwrite existing output")
    p.add_argument("--recursive", action="store_true", help="search the folder's folders too")
    if fmt:
        p.add_argument("-f", "--input-format", default="auto", choices=["auto", *files.ALIGNMENTS])
        p.add_argument("--datatype", default="dna", choices=["dna", "aa", "ignore"])
    if out_fmt:
        p.add_argument(short, "--output-format", default=first, choices=outputs)


def _concat(p: argparse.ArgumentParser) -> None:
    p.add_argument("-p", "--partition-format", default="nexus", choices=["charset", "nexus", "raxml"])
    p.add_argument("--codon", action="store_true")
    p.add_argument("--prefix")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phylospark", description="Phylogenomic data on Spark")
    top.add_argument("--log", help="also write the log to this file")
    groups = top.add_subparsers(dest="group", required=True)

    g = groups.add_parser("read").add_subparsers(dest="command", required=True)
    p = g.add_parser("summary")
    _io(p, "Read-Summary", fmt=False, out_fmt=False)
    p.add_argument("-f", "--input-format", default="auto", choices=["auto", "fastq", "gzip"])
    p.add_argument("--mode", default="default", choices=["minimal", "default", "complete"])
    p.add_argument("--prefix")

    g = groups.add_parser("contig").add_subparsers(dest="command", required=True)
    p = g.add_parser("summary")
    _io(p, "Contig-Summary", fmt=False, out_fmt=False)
    p.add_argument("-f", "--input-format", default="auto", choices=["auto", "fasta", "gzip"])
    p.add_argument("--prefix")

    g = groups.add_parser("maf").add_subparsers(dest="command", required=True)
    p = g.add_parser("convert", aliases=["maf"])
    _io(p, "Genomic-Convert", fmt=False, outputs=[f for f in OUTPUTS if not f.startswith("nexus")], first="fasta-int", short="-t")
    p.add_argument("--reference", help="a file with the names")
    p.add_argument("--from-bed", action="store_true", help="the names are in a BED file")
    p.add_argument("--append", action="store_true", help="put blocks of one name behind each other")
    p.add_argument("--by-chrom", action="store_true", help="match the chromosome as well as the start")
    p.add_argument("--prefix")

    g = groups.add_parser("align").add_subparsers(dest="command", required=True)
    p = g.add_parser("concat")
    _io(p, "Align-Concat")
    _concat(p)
    p.add_argument("--sort", action="store_true")
    p = g.add_parser("convert")
    _io(p, "Align-Convert")
    p.add_argument("--sort", action="store_true")
    p = g.add_parser("filter")
    _io(p, "Align-Filter")
    _concat(p)
    p.add_argument("--concat", action="store_true")
    for name, kind in (("min-len", int), ("max-len", int), ("missing-data", float), ("min-ntax", int), ("percent", float), ("percent-inf", float), ("min-pinf", int), ("max-pinf", int)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--npercent", type=float, nargs="+")
    p.add_argument("--taxon-id", help="a text file with ids")
    p = g.add_parser("split")
    _io(p, "Align-Split")
    p.add_argument("-I", "--input-partition", help="the partition table; without it the alignment's own charsets")
    p.add_argument("-p", "--partition-format", default="auto", choices=["auto", "charset", "nexus", "raxml"])
    p.add_argument("--skip-checking", action="store_true")
    p.add_argument("--prefix")
    p = g.add_parser("summary")
    _io(p, "Align-Summary", out_fmt=False)
    p.add_argument("--prefix")
    p.add_argument("--interval", type=int, default=5, choices=[1, 2, 5, 10])
    p.add_argument("--per-locus", action="store_true")
    p = g.add_parser("trim")
    _io(p, "Align-Trim")
    how = p.add_mutually_exclusive_group(required=True)
    how.add_argument("--missing-data", type=float)
    how.add_argument("--pinf", type=int)
    p = g.add_parser("unalign")
    _io(p, "Align-Unalign", outputs=FASTA, first="fasta")

    g = groups.add_parser("partition").add_subparsers(dest="command", required=True)
    p = g.add_parser("convert")
    p.add_argument("-i", "--input", nargs="+", required=True)
    p.add_argument("-o", "--output", default="Partition-Convert")
    p.add_argument("-p", "--input-partition", default="auto", choices=["auto", "charset", "nexus", "raxml"])
    p.add_argument("-P", "--output-partition", default="nexus", choices=["charset", "nexus", "raxml"])
    p.add_argument("--codon", action="store_true")
    p.add_argument("--datatype", default="dna", choices=["dna", "aa", "ignore"])
    p.add_argument("--skip-checking", action="store_true")
    p.add_argument("--force", action="store_true")

    g = groups.add_parser("sequence").add_subparsers(dest="command", required=True)
    p = g.add_parser("add")
    _io(p, "Sequence-Addition", outputs=FASTA, first="fasta-int")
    to = p.add_mutually_exclusive_group(required=True)
    to.add_argument("--to-dir")
    to.add_argument("--to-input", nargs="+")
    to.add_argument("--to-file", help="one file with all sequences")
    p.add_argument("--destination-format", default="auto", choices=["auto", *files.ALIGNMENTS])
    p.add_argument("--added-only", action="store_true")
    p.add_argument("--include-filename", action="store_true")
    p = g.add_parser("extract")
    _io(p, "Sequence-Extract")
    how = p.add_mutually_exclusive_group(required=True)
    for name in ("re", "id", "file"):
        how.add_argument(f"--{name}")
    p = g.add_parser("filter")
    _io(p, "Sequence-Filter")
    how = p.add_mutually_exclusive_group(required=True)
    how.add_argument("--max-gap", type=float)
    how.add_argument("--min-length", type=int)
    how.add_argument("--max-length", type=int)
    p = g.add_parser("id")
    _io(p, "Sequence-ID", out_fmt=False)
    p.add_argument("--prefix")
    p.add_argument("--map", action="store_true")
    p = g.add_parser("remove")
    _io(p, "Sequence-Remove")
    how = p.add_mutually_exclusive_group(required=True)
    for name in ("re", "id"):
        how.add_argument(f"--{name}")
    p = g.add_parser("rename")
    _io(p, "Sequence-Rename")
    for name in ("replace-id", "remove", "remove-re", "remove-re-all", "replace-from", "replace-from-re", "replace-from-re-all", "replace-to"):
        p.add_argument(f"--{name}")
    p.add_argument("--dry-run", action="store_true")
    p = g.add_parser("translate")
    _io(p, "Sequence-Translate")
    p.add_argument("--table", type=int, default=1, choices=list(DELTAS))
    p.add_argument("--reading-frame", type=int, default=1, choices=[1, 2, 3])
    p.add_argument("--auto-read", action="store_true")
    g.add_parser("show-tables")
    return top


# --- helpers


def paths(spark: SparkSession, a: argparse.Namespace, formats: list[str]) -> list[str]:
    given = sorted(p for x in a.input for p in (glob.glob(x) or [x])) if a.input else None
    return files.input_paths(spark, formats, a.dir, given, a.recursive)


def load(spark: SparkSession, a: argparse.Namespace, aligned: bool = False) -> DataFrame:
    return files.scan_alignments(spark, paths(spark, a, files.ALIGNMENTS), a.input_format, a.datatype, aligned)


def kind(a: argparse.Namespace) -> str:
    return "aa" if a.datatype == "aa" else "dna"


def save(a: argparse.Namespace, aln: DataFrame, folder: str | None = None, nchar: bool = False) -> list[str]:
    if aln.isEmpty():
        raise align.NothingLeft("nothing is left to write")
    return sinks.write_alignments(aln, folder or a.output, a.output_format, a.datatype, a.force, nchar)


def save_concat(a: argparse.Namespace, aln: DataFrame, folder: str) -> list[str]:
    path = f"{folder}/{a.prefix or os.path.basename(folder)}.{sinks.SEQUENCE_FORMATS[a.output_format]}"
    sinks.write_one(align.concat(aln), path, a.output_format, a.datatype, a.force)
    return [path, sinks.write_partition(align.partitions(aln), path, a.partition_format + "-codon" * a.codon, kind(a), a.force)]


def named(a: argparse.Namespace, name: str) -> str:
    return f"{a.output}/{a.prefix + '_' if a.prefix else ''}{name}"


# --- commands


def read_summary(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    reads = files.scan_fastq(spark, paths(spark, a, ["fastq"]), fmt=a.input_format)
    if a.mode == "minimal":
        return [sinks.write_csv(sinks.with_file_name(genomics.read_counts(reads)), named(a, "read-summary-minimal.csv"), sinks.READ_MINIMAL_COLUMNS, ["path"], a.force)]
    out = [sinks.write_csv(sinks.with_file_name(genomics.read_summary(reads)), named(a, "default-read-summary.csv"), sinks.READ_COLUMNS, ["path"], a.force)]
    if a.mode == "complete":
        out.append(sinks.write_zip(named(a, "read-pos-summary.zip"), sinks.position_members(genomics.read_positions(reads)), a.force))
    return out


def contig_summary(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    found = genomics.contig_summary(files.scan_contigs(spark, paths(spark, a, ["contig"]), a.input_format))
    return [sinks.write_csv(sinks.with_file_name(found), named(a, "contig-summary.csv"), sinks.CONTIG_COLUMNS, ["path"], a.force)]


def maf_convert(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    a.datatype = "dna"
    blocks = files.scan_maf(spark, paths(spark, a, ["maf"]))
    if not a.reference:
        stem = seqs.file_stem(F.col("path"))
        rows = genomics.maf_rows(blocks).withColumn("locus", F.concat_ws("-", stem, F.replace("name", F.lit("."), F.lit("_")), F.col("block_idx").cast("string")))
        return save(a, rows)
    rows = genomics.maf_named(blocks, files.scan_bed(spark, [a.reference]), a.append, a.by_chrom)
    if "seq_idx" not in rows.columns:
        rows = align.sort_by_id(rows.withColumn("seq_idx", F.lit(0)))
    out = []
    for missing, folder in ((False, a.output), (True, f"{a.output}/missing-refs")):
        part = rows.filter(F.col("is_missing") == missing)
        if not part.isEmpty():
            out += sinks.write_alignments(part, folder, a.output_format, "dna", a.force)
    return out


def align_concat(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    return save_concat(a, load(spark, a, aligned=True), a.output)


def align_convert(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a)
    return save(a, align.sort_by_id(aln) if a.sort else aln)


#: What the folder of filtered alignments is called by the criterion.
SUFFIXES = {"percent": "{:g}p", "max_len": "{}bp", "min_len": "{}bp", "max_pinf": "{}pinf", "min_pinf": "{}pinf", "percent_inf": "{:g}percent_pinf", "taxon_all": "taxonID", "missing_data": "{:g}percent_missing", "min_ntax": "{}taxa"}


def filter_folder(output: str, name: str, value: object) -> str:
    share = round(100 * value, 9) if isinstance(value, float) else value
    return f"{output}_{SUFFIXES[name].format(share)}"


def align_filter(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Alignments that are kept are copied as they are, unless they are put together."""
    aln = load(spark, a, aligned=True)
    ids = [r.item.strip() for r in files.scan_list(spark, a.taxon_id).collect() if r.item.strip()] if a.taxon_id else None
    given = {"percent": a.percent, "max_len": a.max_len, "min_len": a.min_len, "max_pinf": a.max_pinf, "min_pinf": a.min_pinf, "percent_inf": a.percent_inf, "taxon_all": ids, "missing_data": a.missing_data, "min_ntax": a.min_ntax}
    first = [f for f in align.FILTERS if given.get(f) is not None][:1]
    runs = [{"percent": p} for p in a.npercent] if a.npercent else [{f: given[f]} for f in first] or [{}]
    out = []
    for options in runs:
        kept = align.not_empty(align.filter_loci(aln, kind(a), **options))
        folder = filter_folder(a.output, *next(iter(options.items())))
        out += save_concat(a, kept, folder) if a.concat else sinks.copy_files(kept, folder, a.force)
    return out


def align_split(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a, aligned=True)
    source = a.input_partition or paths(spark, a, files.ALIGNMENTS)[0]
    fmt = a.partition_format if a.input_partition else "charset"
    return save(a, align.split(aln, files.scan_partitions(spark, [source], fmt, not a.skip_checking), a.prefix))


def align_summary(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a, aligned=True).cache()
    if a.per_locus:
        return sinks.write_csv_each(stats.per_locus_taxon(aln, kind(a)), "locus", lambda x: named(a, f"{x}.csv"), sinks.taxon_columns(kind(a), by_locus=True), ["taxon"], a.force)
    path = aln.groupBy("locus").agg(F.min("path").alias("path"))
    loci = stats.locus_summary(aln, kind(a)).join(path, "locus").withColumns({"gc_content": stats.ratio("gc", "total_chars"), "at_content": stats.ratio("at", "total_chars"), "_key": seqs.natural_key(F.col("locus"))}).cache()
    total = stats.unique_ids(aln).agg(F.count("*").alias("total_taxa"))
    site = stats.dataset_site_summary(loci.fillna(0, ["site_count", "conserved", "variable", "pars_inf"])).first()
    chars = stats.dataset_char_summary(loci, kind(a)).first()
    complete = stats.matrix_completeness(loci.select("locus", "ntax"), total, a.interval).orderBy(F.col("percent").desc()).collect()
    report = named(a, "alignment_summary.txt")
    sinks.write_file(report, sinks.report_text(total.first().total_taxa, site, chars, complete, kind(a)), a.force)
    return [
        report,
        sinks.write_csv(stats.taxon_summary(aln, kind(a)), named(a, "taxon_summary.csv"), sinks.taxon_columns(kind(a)), ["taxon"], a.force),
        sinks.write_csv(loci, named(a, "locus_summary.csv"), sinks.locus_columns(kind(a)), ["_key", "locus"], a.force),
    ]


def align_trim(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a, aligned=True)
    trimmed = align.trim_missing(aln, a.missing_data) if a.missing_data is not None else align.trim_pinf(aln, a.pinf, kind(a))
    out = save(a, trimmed)
    return [*out, sinks.write_csv(align.trim_summary(aln, trimmed), f"{a.output}/trimming_summary.csv", sinks.TRIM_COLUMNS, ["locus"], a.force)]


def align_unalign(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a, aligned=True)
    return save(a, align.unalign(aln.withColumn("nchar", F.length("seq"))), nchar=True)


def partition_convert(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    given = [qualified(spark, p) for p in sorted(p for x in a.input for p in (glob.glob(x) or [x]))]
    out = []
    fmt = a.output_partition + "-codon" * a.codon
    for path in given:
        parts = files.scan_partitions(spark, [path], a.input_partition, not a.skip_checking)
        rows = [(r.gene, r.start, r.end) for r in parts.orderBy("part_idx").select("gene", "start", "end").toLocalIterator()]
        to = f"{a.output}/{os.path.splitext(os.path.basename(path))[0]}_partition.{'txt' if fmt.startswith('raxml') else 'nex'}"
        sinks.write_file(to, sinks.partition_text(rows, fmt, kind(a)), a.force)
        out.append(to)
    return out


def sequence_add(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    source = load(spark, a)
    if a.to_file and not a.to_dir and not a.to_input:
        return [sinks.write_one(sequence.add_single(source, a.include_filename), a.to_file, "fasta-int", a.datatype, a.force)]
    given = sorted(p for x in a.to_input for p in (glob.glob(x) or [x])) if a.to_input else None
    dest = files.scan_alignments(spark, files.input_paths(spark, files.ALIGNMENTS, a.to_dir, given), a.destination_format, a.datatype)
    log.info("%s", sequence.add_counters(dest, source).first())
    return save(a, sequence.add(dest, source, a.added_only))


def sequence_extract(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a)
    if a.re:
        return save(a, sequence.extract_regex(aln, a.re))
    ids = sequence.parse_ids(a.id) if a.id else files.scan_list(spark, a.file).select(F.trim("item"))
    return save(a, sequence.extract_ids(aln, ids))


def sequence_filter(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a)
    if a.max_gap is not None:
        return save(a, sequence.filter_max_gap(aln, a.max_gap))
    return save(a, sequence.filter_min_length(aln, a.min_length) if a.min_length is not None else sequence.filter_max_length(aln, a.max_length))


def sequence_id(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    ids = files.scan_ids(spark, paths(spark, a, files.ALIGNMENTS), a.input_format)
    every = stats.unique_ids(ids)
    out = [sinks.write_ordered(every.select(F.concat("taxon", F.lit("\n")).alias("text"), "taxon"), ["taxon"], named(a, "id.txt"), sinks.first_column, force=a.force)]
    if a.map:
        head = sinks.csv_text(["locus", *(r.taxon for r in every.orderBy("taxon").toLocalIterator())], [])  # a line of the file
        wide = stats.id_map_wide(ids)
        cells = F.array_join(F.transform(F.split("present", ""), lambda c: F.when(c == "1", "true").otherwise("false")), ",")
        lines = wide.select("locus", cells.alias("cells"), seqs.natural_key(F.col("locus")).alias("_key"))
        out.append(sinks.write_ordered(lines, ["_key", "locus"], named(a, "map.csv"), lambda b: "".join(sinks.csv_text([x], []).rstrip("\n") + f",{c}\n" for x, c in zip(*(c.to_pylist() for c in b.columns[:2]))), head, force=a.force))
    return out


def sequence_remove(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a)
    return save(a, sequence.remove_regex(aln, a.re) if a.re else sequence.remove_ids(aln, sequence.parse_ids(a.id)))


def sequence_rename(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a)
    to = a.replace_to or ""
    options = {"remove": a.remove, "remove_re": a.remove_re, "remove_re_all": a.remove_re_all}
    options |= {k: (v, to) for k, v in (("replace", a.replace_from), ("replace_re", a.replace_from_re), ("replace_re_all", a.replace_from_re_all)) if v is not None}
    if a.replace_id:
        names = files.scan_mapping(spark, a.replace_id)
        if a.dry_run:
            return _dry(sequence.dry_run_table(aln, names))
        return save(a, sequence.rename_table(aln, names))
    first = next((k for k in sequence.RENAMES if options.get(k) is not None), None)
    if first is None:
        raise SystemExit("give one of the ways to rename")
    if a.dry_run:
        return _dry(sequence.dry_run(aln, **{first: options[first]}))
    return save(a, sequence.rename_by(aln, **{first: options[first]}))


def _dry(found: DataFrame) -> list[str]:
    for r in found.orderBy("old").toLocalIterator():
        print(f"{r.old} -> {r.new}" if r.changed else f"{r.old} unchanged")
    return []


def sequence_translate(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    aln = load(spark, a)
    if not a.auto_read:
        a.datatype = "aa"
        return save(a, sequence.translate(aln, a.table, a.reading_frame))
    done = sequence.translate_auto(aln, a.table).cache()
    a.datatype = "aa"
    out = []
    for r in done.select("frame").distinct().orderBy("frame").collect():
        out += save(a, done.filter(F.col("frame") == r.frame), f"{a.output}/RF-{r.frame}")
    return out


COMMANDS = {
    ("read", "summary"): read_summary, ("contig", "summary"): contig_summary, ("maf", "convert"): maf_convert, ("maf", "maf"): maf_convert,
    ("align", "concat"): align_concat, ("align", "convert"): align_convert, ("align", "filter"): align_filter, ("align", "split"): align_split,
    ("align", "summary"): align_summary, ("align", "trim"): align_trim, ("align", "unalign"): align_unalign, ("partition", "convert"): partition_convert,
    ("sequence", "add"): sequence_add, ("sequence", "extract"): sequence_extract, ("sequence", "filter"): sequence_filter, ("sequence", "id"): sequence_id,
    ("sequence", "remove"): sequence_remove, ("sequence", "rename"): sequence_rename, ("sequence", "translate"): sequence_translate,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run a command; returns the paths it wrote."""
    a = parser().parse_args(argv)
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)] + ([logging.FileHandler(a.log)] if a.log else [])
    logging.basicConfig(level=logging.INFO, handlers=handlers, format="%(message)s")
    if (a.group, a.command) == ("sequence", "show-tables"):
        print("\n".join(f"{t}" for t in DELTAS))
        return []
    began = time.time()
    out = COMMANDS[a.group, a.command](spark or local_session(), a)
    log.info("%d files in %s", len(out), time.strftime("%H:%M:%S", time.gmtime(time.time() - began)))
    return out


if __name__ == "__main__":
    main()
