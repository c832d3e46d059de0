"""Scans of sequence files into DataFrames.

Alignments are many small files: one row a file, taken apart where it was read. FASTA is split by built-in expressions; NEXUS,
PHYLIP and MAF have lines that depend on each other and go through a Python parser, by file. Reads and contigs are large files:
`scan_fastq` reads byte ranges of plain files in parallel (see `ranges.py`), `scan_contigs` splits at record starts.
A file that breaks its format fails the query with the file's name.
"""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.functions import seqs
from phylospark.runtime import filesystem, qualified
from phylospark.sources import parsers
from phylospark.sources.ranges import open_fs

#: File name extensions by format. Discovery by these lists, not by patterns that other names fit as well.
EXTENSIONS = {
    "fasta": ["fa", "fasta", "fna", "fsa", "fas"],
    "nexus": ["nex", "nxs", "nexus"],
    "phylip": ["phy", "phylip", "ph"],
    "fastq": ["fq", "fastq"],
    "contig": ["fa", "fasta", "fna", "fsa", "fas"],
    "maf": ["maf"],
    "bed": ["bed"],
}
ALIGNMENTS = ["fasta", "nexus", "phylip"]
#: Bytes of a packed file that are unpacked at once.
PACKED_BYTES = 8 << 20


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    name = name[:-3] if name.endswith(".gz") else name
    return name.rsplit(".", 1)[-1] if "." in name else ""


def format_of(path: str, formats: list[str] = ALIGNMENTS) -> str:
    """The format by the file's extension; raises for an unknown one."""
    for f in formats:
        if extension(path) in EXTENSIONS[f]:
            return f
    raise ValueError(f"no known format by its name: {path}")


def discover(spark: SparkSession, folder: str, formats: list[str], recursive: bool = False) -> list[str]:
    """Paths of the files of these formats in a folder, sorted. Lists names only; contents are read by executors."""
    fs, root = filesystem(spark, folder)
    found = fs.listFiles(root, recursive)
    known = {e for f in formats for e in EXTENSIONS[f]}
    packed = {"fastq", "contig"} & set(formats)
    out = []
    while found.hasNext():
        path = found.next().getPath().toString()
        if extension(path) in known and (packed or not path.endswith(".gz")):
            out.append(re.sub("^file:/+", "/", path))
    if not out:
        raise FileNotFoundError(f"no files of the formats {', '.join(formats)} in {folder}")
    return sorted(out)


def input_paths(spark: SparkSession, formats: list[str], folder: str | None = None, paths: list[str] | None = None, recursive: bool = False) -> list[str]:
    """Either a folder's files or the given paths, qualified by their file system."""
    if bool(folder) == bool(paths):
        raise ValueError("give a folder or paths, not both")
    return discover(spark, folder, formats, recursive) if folder else [qualified(spark, p) for p in paths]


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, text: one row a file."""
    df = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("path", F.regexp_replace(F.try_url_decode("path"), "^file:/+", "/"))


def _locus(df: DataFrame) -> DataFrame:
    return df.withColumn("locus", seqs.file_stem(F.col("path")))


# --- alignments: locus, path, seq_idx, taxon, seq


def scan_fasta(spark: SparkSession, paths: list[str], unique: bool = True) -> DataFrame:
    """All of it built-in expressions. Text before the first '>' is dropped; a repeated id in a file raises if unique."""
    records = F.split(F.concat(F.lit("\n"), F.replace("text", F.lit("\r"), F.lit(""))), "\n>")
    rows = _locus(whole_files(spark, paths)).select("locus", "path", F.slice(records, 2, F.greatest(F.size(records) - 1, F.lit(0))).alias("r"))
    if unique:
        ids = F.transform("r", lambda x: F.trim(F.substring_index(x, "\n", 1)))
        fine = (F.size(F.array_distinct(ids)) == F.size("r")) & (F.size("r") > 0)
        rows = rows.withColumn("r", F.when(fine, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("no sequence, or an id that occurs twice: "), F.col("path")))))
    rows = rows.select("locus", "path", F.posexplode("r").alias("seq_idx", "x"))
    head = F.substring_index("x", "\n", 1)
    body = F.expr("substring(x, length(substring_index(x, '\n', 1)) + 1)")
    return rows.select("locus", "path", "seq_idx", F.trim(head).alias("taxon"), F.regexp_replace(body, r"\s", "").alias("seq"))


def _by_file(spark: SparkSession, paths: list[str], parse: Callable[[str], dict[str, str]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for locus, path, text in zip(b["locus"], b["path"], b["text"]):
                try:
                    rows = parse(text)
                except (parsers.FormatError, ValueError) as e:
                    raise parsers.FormatError(f"{path}: {e}") from None
                yield pd.DataFrame({"locus": locus, "path": path, "seq_idx": range(len(rows)), "taxon": list(rows), "seq": list(rows.values())})

    return _locus(whole_files(spark, paths)).select("locus", "path", "text").mapInPandas(run, "locus string, path string, seq_idx int, taxon string, seq string")


def scan_nexus(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _by_file(spark, paths, lambda t: parsers.nexus(t)[0])


def scan_nexus_segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, seq_idx, taxon, start, end, seq: the segments of large interleaved NEXUS files, packed if they are called .gz. Each is read as a stream by one task,
    which passes on what is not '?' alone, and each id's first piece."""
    ddl = "path string, seq_idx int, taxon string, start bigint, end bigint, seq string"
    kinds = pa.schema([("path", pa.string()), ("seq_idx", pa.int32()), ("taxon", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("seq", pa.string())])

    def read(path: str) -> Iterator[bytes]:
        fs, p = open_fs(path)
        with fs.open_input_stream(p, compression=None) as raw, gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw as f:
            while piece := f.read(PACKED_BYTES):
                yield piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                found = parsers.nexus_segments(read(path))
                try:
                    while rows := [(path, k, name, at + 1, at + len(seq), seq.decode()) for k, name, at, seq in islice(found, 10_000)]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.types)], schema=kinds)
                except (parsers.FormatError, ValueError) as e:
                    raise parsers.FormatError(f"{path}: {e}") from None

    return spark.createDataFrame([(qualified(spark, p),) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, ddl)


def scan_phylip(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _by_file(spark, paths, lambda t: parsers.phylip(t)[0])


def scan_ids(spark: SparkSession, paths: list[str], fmt: str = "auto") -> DataFrame:
    """locus, path, seq_idx, taxon: the ids alone, without a check of the sequences; a repeated one once."""
    out: DataFrame | None = None
    for f in ALIGNMENTS:
        mine = [p for p in paths if (format_of(p) if fmt == "auto" else fmt) == f]
        if not mine:
            continue
        if f == "fasta":
            part = scan_fasta(spark, mine, unique=False).groupBy("locus", "path", "taxon").agg(F.min("seq_idx").alias("seq_idx"))
        else:
            ids = parsers.nexus_ids if f == "nexus" else parsers.phylip_ids
            part = _by_file(spark, mine, lambda t, ids=ids: dict.fromkeys(ids(t), ""))
        part = part.select("locus", "path", "seq_idx", "taxon")
        out = part if out is None else out.unionByName(part)
    return out


def scan_alignments(spark: SparkSession, paths: list[str], fmt: str = "auto", datatype: str = "dna", aligned: bool = False) -> DataFrame:
    """Alignments of one or several formats. Sequences with symbols outside of their type raise; so do, if aligned, files with different lengths."""
    out: DataFrame | None = None
    for f, scan in (("fasta", scan_fasta), ("nexus", scan_nexus), ("phylip", scan_phylip)):
        mine = [p for p in paths if (format_of(p) if fmt == "auto" else fmt) == f]
        if mine:
            part = scan(spark, mine)
            out = part if out is None else out.unionByName(part)
    if datatype != "ignore":
        bad = F.raise_error(F.concat(F.lit(f"a symbol that is no {datatype}: "), F.col("path"), F.lit(", "), F.col("taxon")))
        out = out.withColumn("seq", F.when(seqs.valid(F.col("seq"), datatype), F.col("seq")).otherwise(bad))
    if aligned:
        lengths = out.groupBy("path").agg(F.min(F.length("seq")).alias("_a"), F.max(F.length("seq")).alias("_b"))
        out = out.join(lengths, "path")
        uneven = F.raise_error(F.concat(F.lit("not aligned: "), F.col("path")))
        out = out.withColumn("seq", F.when(F.col("_a") == F.col("_b"), F.col("seq")).otherwise(uneven)).select("locus", "path", "seq_idx", "taxon", "seq")
    return out


# --- large files


def scan_fastq(spark: SparkSession, paths: list[str], split_bytes: int = 128 << 20, fmt: str = "auto") -> DataFrame:
    """path, file_name, read_idx, name, seq, qual. read_idx: where the read begins in the (unpacked) file, so it follows the file's order.
    fmt: 'gzip' or 'fastq' whatever the files are called; 'auto' goes by their names."""
    from phylospark.sources.ranges import FastqSource

    spark.dataSource.register(FastqSource)
    paths = [qualified(spark, p) for p in paths]
    return spark.read.format("phylospark_fastq").option("paths", "\n".join(paths)).option("split_bytes", str(split_bytes)).option("format", fmt).load()


def _unpacked(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, x: the records of packed FASTA files, each file read as a stream by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = open_fs(path)
                with gzip.GzipFile(fileobj=fs.open_input_stream(p, compression=None)) as f:
                    left = b""
                    while piece := f.read(PACKED_BYTES):
                        *whole, left = (left + piece).split(b"\n>")
                        yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(whole)), "x": pa.array([w.decode() for w in whole], pa.string())})
                    yield pa.RecordBatch.from_pydict({"path": [path], "x": [left.decode()]})

    return spark.createDataFrame([(qualified(spark, p),) for p in paths], "path string").repartition(len(paths)).mapInArrow(run, "path string, x string")


def scan_contigs(spark: SparkSession, paths: list[str], fmt: str = "auto") -> DataFrame:
    """path, contig_name, id, seq: records are split at '>' at the beginning of a line, in parallel also within a plain file. No checks.
    fmt: 'gzip' if the files are packed but not called so; else their names tell."""
    if fmt == "gzip":
        rows = _unpacked(spark, paths)
    else:
        rows = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace(F.try_url_decode(F.col("_metadata.file_path")), "^file:/+", "/").alias("path"), F.col("value").alias("x"))
    rows = rows.withColumn("x", F.regexp_replace("x", "^>", "")).filter(F.trim("x") != "")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(\.[^.]*)?(\.gz)?$", "")
    body = F.expr("substring(x, length(substring_index(x, '\n', 1)) + 1)")
    return rows.select("path", name.alias("contig_name"), F.trim(F.replace(F.substring_index("x", "\n", 1), F.lit("\r"), F.lit(""))).alias("id"), F.regexp_replace(body, r"\s", "").alias("seq"))


# --- blocks and annotations

MAF_SCHEMA = (
    "path string, block_idx int, score double, sequences array<struct<source:string,start:bigint,size:bigint,strand:string,src_size:bigint,text:string>>, "
    "quality struct<source:string,values:array<string>>, information struct<source:string,left_status:string,left_count:bigint,right_status:string,right_count:bigint>, "
    "empty struct<source:string,start:bigint,size:bigint,strand:string,src_size:bigint>"
)


def _maf(spark: SparkSession, paths: list[str], kinds: tuple[str, ...], ddl: str) -> DataFrame:
    names = [c.split()[0] for c in re.split(r", (?=\w+ (?:string|int|double|array|struct|map))", ddl)]

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = [{**x, "path": path} for x in parsers.maf(iter(text.splitlines())) if x["kind"] in kinds]
                except (parsers.FormatError, ValueError) as e:
                    raise parsers.FormatError(f"{path}: {e}") from None
                rows = [{n: x.get(n) for n in names} for x in found]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    return whole_files(spark, paths).mapInArrow(run, ddl)


def scan_maf(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _maf(spark, paths, ("block",), MAF_SCHEMA)


def scan_maf_meta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, kind (header, track, comment), fields, text."""
    return _maf(spark, paths, ("header", "track", "comment"), "path string, kind string, fields map<string,string>, text string")


def scan_bed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """BED records with 3 to 12 fields by one blank or tab each; a start that is not before the end, or a score that is no number up to 65535, raises.
    Other optional fields that cannot be read are null, as are absent ones. For lines that may be broken use operators.rejects."""
    lines = spark.read.text(paths).select(F.rtrim(F.replace("value", F.lit("\r"), F.lit(""))).alias("x"))
    lines = lines.filter((F.trim("x") != "") & ~F.col("x").rlike("^(#|track|browser)"))
    f = lines.select("x", F.split("x", r"\s").alias("f"))
    at = lambda i: F.get(F.col("f"), F.lit(i))
    whole = lambda i: F.expr(f"try_cast(get(f, {i}) as bigint)")
    bad = lambda why: F.raise_error(F.concat(F.lit(why + ": "), F.col("x")))
    score = F.expr("try_cast(get(f, 4) as int)")
    fine = (F.size("f") >= 3) & (whole(1) >= 0) & (whole(1) < whole(2))
    out = f.select(
        F.when(fine, at(0)).otherwise(bad("no BED record")).alias("chrom"), whole(1).alias("chrom_start"), whole(2).alias("chrom_end"), at(3).alias("name"),
        F.when(at(4).isNull() | score.between(0, 65535), score).otherwise(bad("no score")).alias("score"), F.when(at(5).isin("+", "-", "."), at(5)).alias("strand"),
        whole(6).alias("thick_start"), whole(7).alias("thick_end"), at(8).alias("item_rgb"), whole(9).alias("block_count"), at(10).alias("block_sizes"), at(11).alias("block_starts"),
    )
    return out


# --- tables


def scan_partitions(spark: SparkSession, paths: list[str], fmt: str = "auto", checked: bool = True) -> DataFrame:
    """path, part_idx, gene, start, end. A table without any part raises, and one with holes or overlaps if checked. A table is read as a whole by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["text"]):
                kind = fmt if fmt != "auto" else ("raxml" if os.path.splitext(path)[1].lower() in (".txt", ".part", ".raxml") else "nexus")
                try:
                    rows = parsers.partition(text, kind)
                    if checked:
                        parsers.check_contiguous(rows)
                except parsers.FormatError as e:
                    raise parsers.FormatError(f"{path}: {e}") from None
                yield pd.DataFrame({"path": path, "part_idx": range(len(rows)), "gene": [r[0] for r in rows], "start": [r[1] for r in rows], "end": [r[2] for r in rows]})

    return whole_files(spark, paths).mapInPandas(run, "path string, part_idx int, gene string, start bigint, end bigint")


def scan_mapping(spark: SparkSession, path: str) -> DataFrame:
    """origin, destination, line_no of a .csv (commas) or .tsv (blanks) file with a header line; other than two fields raise."""
    lines = whole_files(spark, [path]).select(F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("line_no", "x"))
    lines = lines.filter((F.col("line_no") > 0) & (F.trim("x") != ""))
    f = F.split("x", ",") if extension(path) == "csv" else F.split(F.trim("x"), r"\s+")
    pair = F.when(F.size(f) == 2, f).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), F.col("x"))))
    return lines.select(F.trim(F.get(pair, F.lit(0))).alias("origin"), F.trim(F.get(pair, F.lit(1))).alias("destination"), "line_no")


def scan_list(spark: SparkSession, path: str) -> DataFrame:
    """item: one a line, as it is."""
    return spark.read.text(path).select(F.col("value").alias("item"))
