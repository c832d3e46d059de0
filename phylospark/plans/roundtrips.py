"""Queries that write tables as files of each format into the shared folder, read them back and return what was read, with SQL on the tables they come from.

Formats have rules that the tables do not keep. They are kept by expressions on whole tables, the same in SQL: sequences of a locus are filled up with gaps
to one length where a format wants that, and characters that separate fields are replaced.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phylospark import cli
from phylospark.operators import align, genomics, stats
from phylospark.plans import catalog
from phylospark.plans.catalog import table
from phylospark.runtime import materialize, names_in, qualified, scratch_path
from phylospark.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _folder(spark: SparkSession) -> str:
    return qualified(spark, scratch_path(spark, "files"))


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """The files of a table that Spark wrote."""
    return [f"{folder}/{n}" for n in names_in(spark, folder) if n.startswith("part-")]


# --- alignments (the formats, ids, discovery)


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    """locus, seq_idx, taxon, seq: the first row of each id of a locus, ids made unique by its number, sequences filled up to one length."""
    rows = table(spark, folder, "sequences").filter("locus is not null and taxon is not null and seq <> ''")
    first = rows.groupBy("locus", "taxon").agg(F.min_by("seq", "row_id").alias("seq"), F.min("row_id").alias("row_id"))
    nchar = F.max(F.length("seq")).over(Window.partitionBy("locus"))
    at = F.row_number().over(Window.partitionBy("locus").orderBy("row_id"))
    return first.select("locus", (at - 1).cast("int").alias("seq_idx"), F.concat(F.lit("r"), F.col("row_id").cast("string")).alias("taxon"), F.rpad("seq", nchar, "-").alias("seq"))


_NUMBERED = """
with f as (select locus, taxon, arg_min(seq, row_id) as seq, min(row_id) as row_id from sequences where locus is not null and taxon is not null and seq <> '' group by locus, taxon),
n as (select locus, cast(row_number() over (partition by locus order by row_id) - 1 as int) as seq_idx, 'r' || row_id as taxon, rpad(seq, (max(length(seq)) over (partition by locus))::int, '-') as seq from f)
"""


def _written(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        paths = sinks.write_alignments(_numbered(spark, folder), _folder(spark), fmt, "ignore")
        return files.scan_alignments(spark, paths, datatype="ignore", aligned=True).select("locus", "seq_idx", "taxon", "seq")

    return query


for _fmt in sinks.SEQUENCE_FORMATS:
    add(f"files_{_fmt.replace('-', '_')}", _written(_fmt), _NUMBERED + "select * from n")


def _mixed(spark: SparkSession, folder: str) -> list[str]:
    """Each format for a third of the loci, in folders below one another, found by their names."""
    root, rows = _folder(spark), _numbered(spark, folder)
    third = F.pmod(F.xxhash64("locus"), F.lit(3))
    for k, (fmt, sub) in enumerate((("fasta-int", "a"), ("nexus", "a/b"), ("phylip-int", "a/b/c"))):
        part = rows.filter(third == k)
        if not part.isEmpty():
            sinks.write_alignments(part, f"{root}/{sub}", fmt, "ignore", force=True)
    return files.input_paths(spark, files.ALIGNMENTS, root, recursive=True)


add("files_auto", lambda s, d: files.scan_alignments(s, _mixed(s, d), datatype="ignore").select("locus", "seq_idx", "taxon", "seq"), _NUMBERED + "select * from n")
add("files_ids", lambda s, d: files.scan_ids(s, _mixed(s, d)).select("locus", "seq_idx", "taxon"), _NUMBERED + "select locus, seq_idx, taxon from n")


def _concatenated(spark: SparkSession, folder: str) -> DataFrame:
    """All taxa over all DNA loci as one packed file, and read again. What was read is written once, as segments."""
    aln = catalog.dna(spark, folder)
    aln = aln.withColumn("taxon", F.concat(F.lit("x"), F.hex("taxon")))
    parts = materialize(align.partitions(aln), "parts")
    nchar = parts.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    path = sinks.write_segments(align.segments(aln, parts), nchar, f"{_folder(spark)}/all.nex.gz")
    back = materialize(files.scan_nexus_segments(spark, [path]), "back")
    return align.joined(back, back.agg(F.coalesce(F.max("end"), F.lit(0)).alias("_total")))


add("files_concat", _concatenated, catalog._DNA + catalog._PARTS + catalog._CONCAT + "select 'x' || hex(encode(taxon)) as taxon, seq from con")


def _copied(spark: SparkSession, folder: str) -> DataFrame:
    paths = sinks.write_alignments(_numbered(spark, folder), _folder(spark), "fasta", "ignore")
    aln = files.scan_alignments(spark, paths, datatype="ignore")
    kept = sinks.copy_files(align.filter_loci(aln, min_ntax=20), _folder(spark))
    return files.scan_alignments(spark, kept, datatype="ignore").select("locus", "seq_idx", "taxon", "seq")


add("files_filtered", _copied, _NUMBERED + "select * from n where locus in (select locus from n group by locus having count(*) >= 20)")


# --- partition tables


def _partitions(fmt: str, then: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Written in a format, read, and, if there is another one, written and read once more."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        parts = align.partitions(catalog.dna(spark, folder))
        for kind in [fmt] if then is None else [fmt, then]:
            path = f"{_folder(spark)}/all.nex"
            sinks.write_file(path, "#NEXUS\n") if kind.startswith("charset") else None
            at = sinks.write_partition(parts, path, kind)
            parts = files.scan_partitions(spark, [at], kind.partition("-")[0])
        return parts.select("gene", "start", "end")

    return query


_GENES = catalog._DNA + catalog._PARTS + "select gene, start, \"end\" from parts"
for _fmt in sinks.PARTITION_FORMATS:
    add(f"files_partition_{_fmt.replace('-', '_')}", _partitions(_fmt), _GENES)
add("files_partition_convert", _partitions("raxml-codon", "nexus"), _GENES)


# --- reads, contigs, blocks, annotations, tables


def _fastq(packed: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        seq = F.coalesce("seq", F.lit(""))
        qual = F.when(F.length("qual") == F.length(seq), F.col("qual")).otherwise(F.repeat(F.lit("I"), F.length(seq)))
        to = _folder(spark)
        rows = table(spark, folder, "reads").select(F.concat(F.lit("@"), "path", F.lit(" "), F.col("read_idx").cast("string"), F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("value"))
        rows.write.option("compression", "gzip" if packed else "none").text(to)
        return files.scan_fastq(spark, _parts(spark, to), split_bytes=1 << 20, fmt="gzip" if packed else "fastq").select("name", "seq", "qual")

    return query


_FASTQ = "select path || ' ' || read_idx as name, coalesce(seq, '') as seq, case when length(qual) = length(coalesce(seq, '')) then qual else repeat('I', length(coalesce(seq, ''))::int) end as qual from reads where path is not null and read_idx is not null"
add("files_fastq", _fastq(False), _FASTQ)
add("files_fastq_gzip", _fastq(True), _FASTQ)


def _contigs(packed: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        to = _folder(spark)
        rows = table(spark, folder, "sequences").select(F.concat(F.lit(">r"), F.col("row_id").cast("string"), F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value"))
        rows.write.option("compression", "gzip" if packed else "none").text(to)
        return files.scan_contigs(spark, _parts(spark, to), "gzip" if packed else "auto").select("id", "seq")

    return query


for _packed in (False, True):
    add(f"files_contigs{'_gzip' * _packed}", _contigs(_packed), "select 'r' || row_id as id, coalesce(seq, '') as seq from sequences")


def _maf(spark: SparkSession, folder: str) -> DataFrame:
    to = _folder(spark)
    line = lambda x: F.concat_ws(" ", F.lit("s"), x["source"], x["start"].cast("string"), x["size"].cast("string"), x["strand"], x["src_size"].cast("string"), x["text"])
    blocks = catalog.blocks(spark, folder)
    blocks.select(F.concat(F.lit("##maf version=1\na score="), F.col("block_idx").cast("string"), F.lit("\n"), F.array_join(F.transform("sequences", line), "\n"), F.lit("\n")).alias("value")).write.text(to)
    rows = files.scan_maf(spark, _parts(spark, to)).select("score", F.posexplode("sequences").alias("seq_idx", "x"))
    return rows.select("score", "seq_idx", F.col("x.source").alias("source"), F.col("x.start").alias("start"), F.col("x.size").alias("size"), F.col("x.text").alias("seq"))


add("files_maf", _maf, catalog._BLOCK + "select block_idx::double as score, seq_idx, taxon as source, case when seq_idx = 0 then start else 1 end as start, length(seq) as size, seq from r")


def _bed(spark: SparkSession, folder: str) -> DataFrame:
    to = _folder(spark)
    plain = lambda c: F.regexp_replace(c, r"\s", "_")
    rows = table(spark, folder, "bed_records").filter("chrom is not null and chrom_start >= 0 and chrom_start < chrom_end")
    name = F.coalesce(F.when(F.col("name") != "", plain("name")), F.lit("."))
    score = F.when(F.col("score").between(0, 65535), F.col("score")).otherwise(0).cast("string")
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".")
    rows.select(F.concat_ws("\t", F.concat(F.lit("c"), plain("chrom")), F.col("chrom_start").cast("string"), F.col("chrom_end").cast("string"), name, score, strand).alias("value")).write.text(to)
    return files.scan_bed(spark, _parts(spark, to)).select("chrom", "chrom_start", "chrom_end", "name", "score", "strand")


add("files_bed", _bed, r"select 'c' || regexp_replace(chrom, '\s', '_', 'g') as chrom, chrom_start, chrom_end, coalesce(case when name <> '' then regexp_replace(name, '\s', '_', 'g') end, '.') as name, cast(case when score between 0 and 65535 then score else 0 end as int) as score, case when strand in ('+', '-') then strand else '.' end as strand from bed_records where chrom is not null and chrom_start >= 0 and chrom_start < chrom_end")


def _mapping(extension: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        path = f"{_folder(spark)}/names.{extension}"
        plain = lambda c: F.concat(F.lit("x"), F.regexp_replace(c, r"[\s,\"]", "_"))
        rows = table(spark, folder, "rename_map").filter("origin is not null and destination is not null").select(plain("origin").alias("origin"), plain("destination").alias("destination"), "row_id")
        if extension == "csv":
            sinks.write_csv(rows, path, {"origin": "origin", "destination": "destination"}, ["row_id"])
        else:
            sinks.write_ordered(rows.select(F.concat_ws("\t", "origin", "destination").alias("text"), "row_id"), ["row_id"], path, lambda b: "".join(x + "\n" for x in b.column(0).to_pylist()), head="origin\tdestination\n")
        return files.scan_mapping(spark, path).select("origin", "destination", "line_no")

    return query


for _ext in ("csv", "tsv"):
    add(f"files_mapping_{_ext}", _mapping(_ext), r"""select 'x' || regexp_replace(origin, '[\s,"]', '_', 'g') as origin, 'x' || regexp_replace(destination, '[\s,"]', '_', 'g') as destination, cast(row_number() over (order by row_id) as int) as line_no from rename_map where origin is not null and destination is not null""")


def _id_list(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{_folder(spark)}/id.txt"
    ids = stats.unique_ids(catalog.alignments(spark, folder))
    sinks.write_ordered(ids.select(F.concat("taxon", F.lit("\n")).alias("text"), "taxon"), ["taxon"], path, sinks.first_column)
    return files.scan_list(spark, path)


add("files_id_list", _id_list, catalog._ALL + "aln as (select * from al) select distinct taxon as item from aln")


# --- summary files: written as CSV, read, and cast to what they were


def _read_csv(spark: SparkSession, paths: str | list[str], columns: dict[str, str], like: DataFrame) -> DataFrame:
    back = spark.read.option("header", True).option("escape", '"').csv(paths)
    kinds = {f.name: f.dataType for f in like.schema.fields}
    return back.select(*[F.col(f"`{head}`").cast(kinds[c]).alias(c) for head, c in columns.items()])


def _csv(made: Callable[[SparkSession, str], DataFrame], columns: dict[str, str], order: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = made(spark, folder)
        path = sinks.write_csv(df, f"{_folder(spark)}/table.csv", columns, order)
        return _read_csv(spark, path, columns, df)

    return query


def _only(columns: dict[str, str], left_out: set[str]) -> dict[str, str]:
    return {k: v for k, v in columns.items() if v not in left_out}


def _selected(columns: dict[str, str], name: str) -> str:
    """The SQL of another query, with the columns that its file has."""
    return f"select {', '.join(chr(34) + c + chr(34) for c in columns.values())} from ({catalog.SQL[name]})"


_LOCUS = _only(sinks.locus_columns("dna"), {"path", "gc_content", "at_content"})
add("files_locus_csv", _csv(catalog.QUERIES["locus_summary"], _LOCUS, ["locus"]), _selected(_LOCUS, "locus_summary"))
_TAXON = sinks.taxon_columns("dna")
add("files_taxon_csv", _csv(lambda s, d: catalog.QUERIES["taxon_summary"](s, d).withColumn("taxon", F.concat(F.lit("x"), "taxon")), _TAXON, ["taxon"]), _selected(_TAXON, "taxon_summary").replace('select "taxon"', "select 'x' || taxon as taxon", 1))
_READ = _only(sinks.READ_COLUMNS, {"file_name"})
add("files_read_csv", _csv(catalog.QUERIES["read_summary_default"], _READ, ["path"]), _selected(_READ, "read_summary_default"))
_CONTIG = _only(sinks.CONTIG_COLUMNS, {"contig_name"})
add("files_contig_csv", _csv(catalog.QUERIES["contig_summary"], _CONTIG, ["path"]), _selected(_CONTIG, "contig_summary"))
add("files_trim_csv", _csv(catalog.QUERIES["trim_summary"], sinks.TRIM_COLUMNS, ["locus"]), _selected(sinks.TRIM_COLUMNS, "trim_summary"))


def _per_locus(spark: SparkSession, folder: str) -> DataFrame:
    """One file for each locus."""
    to = _folder(spark)
    df = catalog.QUERIES["per_locus_taxon"](spark, folder).withColumn("taxon", F.concat(F.lit("x"), "taxon"))
    columns = sinks.taxon_columns("dna", by_locus=True)
    paths = sinks.write_csv_each(df, "locus", lambda x: f"{to}/{x}.csv", columns, ["taxon"])
    return _read_csv(spark, paths, columns, df)


_EACH = sinks.taxon_columns("dna", by_locus=True)
add("files_per_locus_csv", _per_locus, _selected(_EACH, "per_locus_taxon").replace('select "taxon"', "select 'x' || taxon as taxon", 1))


def _zipped(spark: SparkSession, folder: str) -> DataFrame:
    """The archive with a member for each file of reads, by a stem that is the file's hash."""
    reads = catalog.reads(spark, folder).filter("path is not null").withColumn("path", F.concat(F.lit("m"), F.md5("path")))
    path = f"{_folder(spark)}/positions.zip"
    sinks.write_zip(path, sinks.position_members(genomics.read_positions(reads)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        t = pd.read_csv(z.open(name))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(t)), *(pa.array(t[c].to_numpy("int64")) for c in ("index", "G", "C", "A", "T"))], names=["member", "pos", "g_count", "c_count", "a_count", "t_count"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "member string, pos bigint, g_count bigint, c_count bigint, a_count bigint, t_count bigint")


add("files_position_zip", _zipped, f"select 'm' || md5(path) || '.csv' as member, pos, g_count, c_count, a_count, t_count from ({catalog.SQL['read_position_stats']}) where path is not null")


def _report(spark: SparkSession, folder: str) -> DataFrame:
    """The first lines of the text report of all DNA loci, by the command over files."""
    to = _folder(spark)
    aln = catalog.dna(spark, folder).withColumn("taxon", F.concat(F.lit("x"), F.hex("taxon")))
    sinks.write_alignments(aln, f"{to}/in", "fasta")
    out = cli.main(["align", "summary", "-d", f"{to}/in", "-o", f"{to}/out"], spark)
    lines = spark.read.text(out[0]).select(F.split("value", r"\s*: ").alias("f")).filter(F.size("f") == 2)
    return lines.select(F.get("f", F.lit(0)).alias("label"), F.get("f", F.lit(1)).alias("shown")).filter(F.col("label").isin("Total taxa", "Total loci", "Total sites", "Total characters", "Missing data"))


add("files_report", _report, catalog._DNA + catalog._chars_sql("dna") + catalog._sites_sql(catalog._DNA_STATE) + """, v as (select 'Total taxa' as label, (select count(distinct taxon) from aln) as n union all select 'Total loci', count(*) from ls union all select 'Total sites', cast(sum(site_count) as bigint) from ls
union all select 'Total characters', cast(sum(total_chars) as bigint) from ch union all select 'Missing data', cast(sum(missing) as bigint) from ch) select label, format('{:,}', n) as shown from v""")
