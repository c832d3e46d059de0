"""Writers of sequence files, partition tables, summary tables and the text report.

Alignments go out as one file a locus, each written by one task under a temporary name and then renamed, so that a repeated task
does no harm. What becomes one file whatever its size (a concatenated alignment, a partition or summary table) is sorted over ranges; each task
writes its range as a piece in the target's file system, and the pieces are joined by streams, so that no one holds the whole.
Existing files are not overwritten unless force is given. Paths are qualified by the driver; executors use the same file system.
"""

from __future__ import annotations

import csv
import gzip
import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from phylospark.functions import seqs
from phylospark.operators.ranges import running_sum
from phylospark.operators.stats import symbols
from phylospark.runtime import qualified, scratch_path
from phylospark.sources.ranges import open_fs

SEQUENCE_FORMATS = {"fasta": "fas", "fasta-int": "fas", "nexus": "nex", "nexus-int": "nex", "phylip": "phy", "phylip-int": "phy"}
PARTITION_FORMATS = ["charset", "nexus", "raxml", "charset-codon", "nexus-codon", "raxml-codon"]
#: Widths of interleaved blocks, and the number of characters from which the wider one is used.
NARROW, WIDE, WIDE_FROM = 80, 500, 2000
#: Bytes that are copied at once.
COPIED = 8 << 20
#: Level of packing, of which the text of an alignment needs little.
PACKED_LEVEL = 1


# --- text of one alignment


def _pieces(seq: str, nchar: int) -> list[str]:
    width = NARROW if nchar < WIDE_FROM else WIDE
    return [seq[i : i + width] for i in range(0, len(seq), width)] or [""]


class UnevenRows(ValueError):
    """Sequences of different lengths in a format that has none."""


def _frame(kind: str, ntax: int, nchar: int, inter: bool, datatype: str = "dna", missing: str = "?", gap: str = "-") -> tuple[str, str]:
    """What comes before and behind the sequences of a file."""
    if kind == "fasta":
        return "", ""
    if kind == "phylip":
        return f"{ntax} {nchar}\n", ""
    name = "protein" if datatype == "aa" else "dna"
    return f"#NEXUS\nbegin data;\ndimensions ntax={ntax} nchar={nchar};\nformat datatype={name} missing={missing} gap={gap}{' interleave' * inter};\nmatrix\n", ";\nend;\n"


def _known(fmt: str) -> tuple[str, bool]:
    """A format's kind, and whether it is interleaved."""
    if fmt not in SEQUENCE_FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(SEQUENCE_FORMATS)}")
    kind, _, inter = fmt.partition("-")
    return kind, bool(inter)


def alignment_text(rows: list[tuple[str, str]], fmt: str, datatype: str = "dna", missing: str = "?", gap: str = "-", nchar: int | None = None) -> str:
    """The file of an alignment given as (id, sequence) in order. nchar: of the header, if it is not the longest sequence's. Only FASTA takes uneven rows."""
    kind, inter = _known(fmt)
    lengths = {len(s) for _, s in rows}
    if kind != "fasta" and len(lengths) > 1:
        raise UnevenRows(f"{kind} needs sequences of one length, not of {min(lengths)} to {max(lengths)}")
    nchar = max(lengths, default=0) if nchar is None else nchar
    width = max((len(i) for i, _ in rows), default=0) + 1
    head, tail = _frame(kind, len(rows), nchar, inter, datatype, missing, gap)
    if kind == "fasta":
        return "".join(f">{i}\n" + "\n".join(_pieces(s, nchar) if inter else [s]) + "\n" for i, s in rows)
    blocks = [[(i, s) for i, s in rows]]
    if inter:
        cut = [(i, _pieces(s, nchar)) for i, s in rows]
        blocks = [[(i, p[k]) for i, p in cut] for k in range(len(cut[0][1]) if cut else 0)]
    named = lambda k: not k or kind == "nexus"
    return head + "\n".join("".join((f"{i:<{width}}" if named(k) else "") + f"{s}\n" for i, s in b) for k, b in enumerate(blocks)) + tail


def _part_frame(fmt: str) -> tuple[str, str]:
    if fmt not in PARTITION_FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(PARTITION_FORMATS)}")
    kind = fmt.partition("-")[0]
    return ("", "") if kind == "raxml" else ("#nexus\n" * (kind == "nexus") + "begin sets;\n", "end;\n")


def _part_line(gene: str, start: int, end: int, fmt: str, datatype: str) -> str:
    """A part's line, or its three in the codon forms."""
    kind, _, codon = fmt.partition("-")
    ranges = [(f"{gene}_Subset{k + 1}", f"{start + k}-{end}\\3") for k in range(3)] if codon else [(gene, f"{start}-{end}")]
    if kind == "raxml":
        return "".join(f"{'DNA, ' if datatype == 'dna' else ''}{name} = {where}\n" for name, where in ranges)
    return "".join(f"charset {name if codon or '-' not in name else repr(name)} = {where};\n" for name, where in ranges)


def partition_text(parts: list[tuple[str, int, int]], fmt: str, datatype: str = "dna") -> str:
    """A partition table given as (gene, start, end). The codon forms have three lines a gene."""
    head, tail = _part_frame(fmt)
    return head + "".join(_part_line(*p, fmt, datatype) for p in parts) + tail


# --- files


def exists(path: str) -> bool:
    fs, p = open_fs(path)
    return fs.get_file_info(p).type.name != "NotFound"


def write_stream(path: str, fill: Callable[[object], None], force: bool = False) -> None:
    """Write a file by a function that fills a stream, as a whole or not at all. Raises if it exists, unless forced."""
    fs, p = open_fs(path)
    if not force and exists(path):
        raise FileExistsError(path)
    fs.create_dir(os.path.dirname(p) or ".", recursive=True)
    part = f"{os.path.dirname(p)}/.{os.path.basename(p)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as f:
        fill(f)
    if force and exists(path):
        fs.delete_file(p)
    fs.move(part, p)


def write_file(path: str, content: bytes | str, force: bool = False) -> None:
    write_stream(path, lambda f: f.write(content.encode() if isinstance(content, str) else content), force)


def append_file(path: str, to: object) -> None:
    """Copy a file's bytes into a stream, a piece at a time."""
    fs, p = open_fs(path)
    with fs.open_input_stream(p, compression=None) as f:
        while piece := f.read(COPIED):
            to.write(piece)


def write_ordered(rows: DataFrame, order: list[str | Column], path: str, text: Callable[[pa.RecordBatch], str], head: str = "", tail: str = "", force: bool = False, before: str | None = None) -> str:
    """One file of all rows in this order, between head and tail. text: of a batch of rows, without the columns of the order. before: a file whose
    content comes first. Rows equal in the order may come in any."""
    path = qualified(rows.sparkSession, path)
    if not force and exists(path):
        raise FileExistsError(path)
    keys = [f"_order{i}" for i in range(len(order))]
    columns = rows.columns
    keyed = rows.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in zip(keys, order)])
    pieces = f"{os.path.dirname(path)}/.pieces-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        to = f"{pieces}/{task.partitionId()}-{task.taskAttemptId()}"  # a repeated task writes another piece; only one of them is told of
        fs, p = open_fs(to)
        fs.create_dir(os.path.dirname(p), recursive=True)
        with fs.open_output_stream(p) as f:
            for b in batches:
                f.write(text(b).encode())
        yield pa.RecordBatch.from_pydict({"k": pa.array([task.partitionId()], pa.int32()), "path": [to]})

    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(columns)
    fs, p = open_fs(pieces)
    try:
        made = sorted((r.k, r.path) for r in ranged.mapInArrow(run, "k int, path string").collect())  # one row a task

        def fill(f: object) -> None:
            if before:
                append_file(before, f)
            f.write(head.encode())
            for _, piece in made:
                append_file(piece, f)
            f.write(tail.encode())

        write_stream(path, fill, force)
    finally:
        if exists(pieces):
            fs.delete_dir(p)
    return path


def copy_files(paths: DataFrame, folder: str, force: bool = False) -> list[str]:
    """Copy the files of the column `path` into a folder, unchanged; returns the new paths. Each is copied by the task that has its row.
    Two files of one name raise."""
    folder = _empty(paths.sparkSession, folder, force)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    twice = paths.select("path").distinct().groupBy(name.alias("name")).count().filter("count > 1").first()
    if twice:
        raise FileExistsError(f"{twice['count']} files are called {twice.name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for path in b.column(0).to_pylist():
                made.append(f"{folder}/{os.path.basename(path)}")
                write_stream(made[-1], lambda f, path=path: append_file(path, f), force=True)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["path"])

    return sorted(r.path for r in paths.select("path").distinct().mapInArrow(run, "path string").collect())


def _empty(spark: SparkSession, folder: str, force: bool) -> str:
    """The folder's qualified path. Raises if there is anything in it, unless forced."""
    from pyarrow.fs import FileSelector

    folder = qualified(spark, folder)
    fs, p = open_fs(folder)
    if not force and fs.get_file_info(p).type.name == "Directory" and fs.get_file_info(FileSelector(p)):
        raise FileExistsError(folder)
    return folder


def partition_name(path: str, fmt: str) -> str:
    """Where the partition table of an alignment file goes: next to it, or into it for charsets."""
    if fmt.startswith("charset"):
        return path
    return f"{os.path.splitext(path)[0]}_partition.{'nex' if fmt.startswith('nexus') else 'txt'}"


def write_alignments(aln: DataFrame, folder: str, fmt: str = "nexus", datatype: str = "dna", force: bool = False, nchar: bool = False) -> list[str]:
    """One file a locus, called by the locus; returns the paths. nchar: the header's number of characters comes with the rows."""
    cols = ["locus", "seq_idx", "taxon", "seq"] + ["nchar"] * nchar
    folder = _empty(aln.sparkSession, folder, force)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq_idx", "taxon"])
        path = f"{folder}/{pdf['locus'].iloc[0]}.{SEQUENCE_FORMATS[fmt]}"
        try:
            text = alignment_text(list(zip(pdf["taxon"], pdf["seq"])), fmt, datatype, nchar=int(pdf["nchar"].iloc[0]) if nchar else None)
        except UnevenRows as e:
            raise UnevenRows(f"{path}: {e}") from None
        # a task that runs again after its file was written finds the same text
        try:
            write_file(path, text, force)
        except FileExistsError:
            fs, p = open_fs(path)
            if fs.open_input_stream(p).read() != text.encode():
                raise
        return pd.DataFrame({"path": [path]})

    return sorted(r.path for r in aln.select(cols).groupBy("locus").applyInPandas(run, "path string").collect())


def first_column(batch: pa.RecordBatch) -> str:
    return "".join(batch.column(0).to_pylist())


def write_one(rows: DataFrame, path: str, fmt: str = "fasta-int", datatype: str = "dna", force: bool = False) -> str:
    """All rows (taxon, seq, and seq_idx if there is one) as one alignment file."""
    kind, inter = _known(fmt)
    order = ["seq_idx", "taxon"] if "seq_idx" in rows.columns else ["taxon"]
    n = rows.agg(F.count("*").alias("ntax"), F.coalesce(F.min(F.length("seq")), F.lit(0)).alias("least"), F.coalesce(F.max(F.length("seq")), F.lit(0)).alias("nchar"), F.coalesce(F.max(F.length("taxon")), F.lit(0)).alias("width")).first()
    if kind != "fasta" and n.least != n.nchar:
        raise UnevenRows(f"{path}: {kind} needs sequences of one length, not of {n.least} to {n.nchar}")
    head, tail = _frame(kind, n.ntax, n.nchar, inter, datatype)
    end = F.lit("\n")
    pieces = seqs.chunks(F.col("seq"), NARROW if n.nchar < WIDE_FROM else WIDE)
    if kind == "fasta":
        body = F.array_join(pieces, "\n") if inter else F.col("seq")
        lines = rows.select(F.concat(F.lit(">"), "taxon", end, body, end).alias("text"), *order)
        return write_ordered(lines, order, path, first_column, head, tail, force)
    name = F.rpad("taxon", n.width + 1, " ")
    if not inter:
        return write_ordered(rows.select(F.concat(name, "seq", end).alias("text"), *order), order, path, first_column, head, tail, force)
    cut = rows.select("taxon", *[F.col(c).alias(f"_{c}") for c in order], F.posexplode_outer(pieces).alias("_block", "_piece"))
    first = F.coalesce(F.col("_block"), F.lit(0)) == 0
    text = F.concat(F.when(first | F.lit(kind == "nexus"), name).otherwise(""), F.coalesce("_piece", F.lit("")), end)
    lines = cut.select(text.alias("text"), F.coalesce("_block", F.lit(0)).alias("_block"), F.lit(1).alias("_line"), *[f"_{c}" for c in order])
    blank = lines.filter(F.col("_block") > 0).select("_block").distinct().select(end.alias("text"), "_block", F.lit(0).alias("_line"), *[F.lit(None).cast(lines.schema[f"_{c}"].dataType).alias(f"_{c}") for c in order])
    return write_ordered(lines.unionByName(blank), ["_block", "_line", *[f"_{c}" for c in order]], path, first_column, head, tail, force)


#: Rows of a block that are laid out at once, and characters of text for a task of `write_segments`.
LAID_ROWS, TASK_CHARS = 20_000, 1 << 28


def write_segments(segs: DataFrame, nchar: int, path: str, datatype: str = "dna", force: bool = False) -> str:
    """An interleaved NEXUS file, packed by gzip, out of the segments (taxon, start, end, seq) of a concatenated alignment of nchar sites: the text that `write_one` writes
    of the sequences. Only what is in segments is shuffled; a task lays out the lines of its blocks, '?' where a taxon has nothing, and packs them as it goes.
    Ids are ASCII without blanks."""
    spark = segs.sparkSession
    path, scratch = qualified(spark, path), qualified(spark, scratch_path(spark, "segments"))
    if not force and exists(path):
        raise FileExistsError(path)
    names = running_sum(segs.select("taxon").distinct().withColumn("_one", F.lit(1).cast("bigint")), [], ["taxon"], "_one", "_rank", cut="names")
    n = names.agg(F.count("*").alias("ntax"), F.coalesce(F.max(F.length("taxon")), F.lit(0)).alias("width"), F.coalesce(F.bool_and(F.col("taxon").rlike("^[!-~]+$")), F.lit(True)).alias("plain")).first()
    if not n.plain:
        raise ValueError("ids that are not ASCII, or have blanks")
    wide, width, ntax = NARROW if nchar < WIDE_FROM else WIDE, n.width + 1, n.ntax
    listed = write_ordered(names.select(F.rpad("taxon", width, " ").alias("text"), "taxon"), ["taxon"], f"{scratch}/names", first_column)
    at = lambda c: F.floor((F.col(c) - 1) / wide)
    cut = segs.select("taxon", "start", "end", "seq", F.explode(F.sequence(at("start"), at("end"))).alias("block"))
    lo, hi = F.greatest("start", F.col("block") * wide + 1), F.least("end", (F.col("block") + 1) * wide)
    cut = cut.select(F.col("taxon").alias("_of"), "block", (lo - F.col("block") * wide - 1).alias("at"), F.substring("seq", (lo - F.col("start") + 1).cast("int"), (hi - lo + 1).cast("int")).alias("piece"))
    rows = cut.join(names.select("taxon", "_rank"), F.col("_of") == F.col("taxon")).select("block", (F.col("_rank") - 1).alias("row"), "at", "piece")
    blocks = -(-nchar // wide)
    every = spark.range(blocks).select(F.col("id").alias("block"), F.lit(-1).cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("at"), F.lit("").alias("piece"))
    tasks = max(1, min(blocks, ntax * nchar // TASK_CHARS))

    def lines(f: object, block: int, found: list[tuple[int, int, str]]) -> None:
        here = min(wide, nchar - block * wide)
        f.write(b"\n" * (block > 0))
        fs, p = open_fs(listed)
        k = 0
        with fs.open_input_stream(p) as known:
            for first in range(0, ntax, LAID_ROWS):
                n = min(LAID_ROWS, ntax - first)
                laid = np.full((n, width + here + 1), ord("?"), dtype=np.uint8)
                laid[:, :width] = np.frombuffer(known.read(n * width), dtype=np.uint8).reshape(n, width)
                laid[:, -1] = ord("\n")
                while k < len(found) and found[k][0] < first + n:
                    row, at, piece = found[k]
                    laid[row - first, width + at : width + at + len(piece)] = np.frombuffer(piece.encode("ascii"), dtype=np.uint8)
                    k += 1
                f.write(laid.data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        to = f"{scratch}/pieces/{task.partitionId()}-{task.taskAttemptId()}"  # a repeated task writes another piece; only one of them is told of
        fs, p = open_fs(to)
        fs.create_dir(os.path.dirname(p), recursive=True)
        block, found = None, []
        with fs.open_output_stream(p, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=PACKED_LEVEL, mtime=0) as f:
            for b in batches:
                for of, *x in zip(*(c.to_pylist() for c in b.columns)):
                    if of != block:
                        if block is not None:
                            lines(f, block, found)
                        block, found = of, []
                    if x[0] >= 0:
                        found.append(tuple(x))
            if block is not None:
                lines(f, block, found)
        yield pa.RecordBatch.from_pydict({"k": pa.array([task.partitionId()], pa.int32()), "path": [to]})

    ranged = rows.unionByName(every).repartitionByRange(tasks, "block").sortWithinPartitions("block", "row", "at")
    made = sorted((r.k, r.path) for r in ranged.mapInArrow(run, "k int, path string").collect())  # one row a task
    head, tail = _frame("nexus", ntax, nchar, True, datatype)

    def fill(f: object) -> None:
        f.write(gzip.compress(head.encode(), mtime=0))
        for _, piece in made:  # packed pieces behind one another are a packed file; each goes as soon as it is copied, so that there are never two of all
            append_file(piece, f)
            fs, p = open_fs(piece)
            fs.delete_file(p)
        f.write(gzip.compress(tail.encode(), mtime=0))

    write_stream(path, fill, force)
    return path


def write_partition(parts: DataFrame, path: str, fmt: str = "nexus", datatype: str = "dna", force: bool = False) -> str:
    """The partition table of the alignment at path; for charsets it is appended to the alignment's file."""
    path = qualified(parts.sparkSession, path)
    head, tail = _part_frame(fmt)
    lines = lambda b: "".join(_part_line(*r, fmt, datatype) for r in zip(*(c.to_pylist() for c in b.columns[:3])))
    charset = fmt.startswith("charset")
    return write_ordered(parts.select("gene", "start", "end", "part_idx"), ["part_idx"], partition_name(path, fmt), lines, head, tail, force or charset, before=path if charset else None)


def _cell(v: object) -> object:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else v


def csv_text(header: list[str], rows: Iterable[Iterable]) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    for r in rows:
        w.writerow([_cell(v) for v in r])
    return out.getvalue()


def _csv_rows(batch: pa.RecordBatch) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([_cell(v) for v in r] for r in zip(*(c.to_pylist() for c in batch.columns)))
    return out.getvalue()


def write_csv(df: DataFrame, path: str, columns: dict[str, str], order: list[str], force: bool = False) -> str:
    """One CSV file. columns: the file's header by the frame's columns, in order; the same frame column may come under several headers."""
    rows = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns.values())], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    n = len(columns)
    return write_ordered(rows, [f"_o{i}" for i in range(len(order))], path, lambda b: _csv_rows(b.select(range(n))), csv_text(list(columns), []), force=force)


def write_csv_each(df: DataFrame, by: str, name: Callable[[str], str], columns: dict[str, str], order: list[str], force: bool = False) -> list[str]:
    """One CSV file for each value of a column, at the path that `name` gives it; returns the paths."""
    spark = df.sparkSession
    at = qualified(spark, name("{}"))
    rows = df.select(by, *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns.values())], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    n = len(columns)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(f"_o{i}", "ascending") for i in range(len(order))]).select([f"_c{i}" for i in range(n)])
        path = at.replace("{}", str(key[0].as_py()))
        text = csv_text(list(columns), []) + "".join(_csv_rows(b) for b in table.to_batches())
        try:
            write_file(path, text, force)
        except FileExistsError:  # a task that runs again finds the same text
            fs, p = open_fs(path)
            if fs.open_input_stream(p).read() != text.encode():
                raise
        return pa.table({"path": [path]})

    return sorted(r.path for r in rows.groupBy(by).applyInArrow(run, "path string").collect())


# --- layouts of the summary files


def symbol_columns(datatype: str) -> dict[str, str]:
    return {c: f"sym_{c}" for c in symbols(datatype)}


def locus_columns(datatype: str) -> dict[str, str]:
    cols = {
        "path": "path", "locus": "locus", "ntax": "ntax", "chars_count": "total_chars", "site_count": "site_count", "conserved_sites": "conserved", "proportion_cons_sites": "prop_cons",
        "variable_sites": "variable", "proportion_var_sites": "prop_var", "parsimony_informative_sites": "pars_inf", "proportion_pars_inf_sites": "prop_pinf", "missing_data": "missing", "proportion_missing_data": "prop_missing",
    }
    if datatype != "aa":
        cols |= {"GC_content": "gc_content", "AT_content": "at_content", "nucleotides": "nucleotides"}
    return cols | symbol_columns(datatype)


def taxon_columns(datatype: str, by_locus: bool = False) -> dict[str, str]:
    """Of the taxon summary (where nucleotides are a proportion) or, by_locus, of one locus' taxa."""
    cols = {"taxon": "taxon"} | ({} if by_locus else {"locus_counts": "locus_counts"}) | {"total_chars": "total_chars", "missing_data": "missing", "proportion_missing_data": "prop_missing"}
    if datatype != "aa":
        cols |= {"gc_content": "gc_content", "at_content": "at_content", "nucleotides": "prop_nucleotides"}
    return cols | symbol_columns(datatype)


#: Headers of the read, contig and trimming summaries.
READ_COLUMNS = {
    "file_path": "path", "file_name": "file_name", "read_count": "read_count", "base_count": "base_count", "mean_read_length": "mean_read_len", "min_read_length": "min_read_len", "max_read_length": "max_read_len",
    "GC_count": "gc_count", "GC_content": "gc_content", "AT_count": "at_count", "AT_content": "at_content", "N_content": "n_content", "G": "g_count", "C": "c_count", "A": "a_count", "T": "t_count", "N": "n_count",
    "low_QScore": "low_qscore", "mean_QScore": "mean_qscore", "min_QScore": "min_qscore", "max_QScore": "max_qscore",
}
READ_MINIMAL_COLUMNS = {"file_path": "path", "file_name": "file_name", "read_count": "read_count"}
POSITION_COLUMNS = {
    "index": "pos", "G": "g_count", "C": "c_count", "A": "a_count", "T": "t_count", "proportion_G": "g_prop", "proportion_C": "c_prop", "proportion_A": "a_prop", "proportion_T": "t_prop",
    "mean_QScore": "mean_qscore", "min_QScore": "min_qscore", "max_QScore": "max_qscore",
}
CONTIG_COLUMNS = {
    "file_path": "path", "contig_name": "contig_name", "contig_count": "contig_count", "base_count": "base_count", "nucleotide": "nucleotide", "GC_content": "gc_content", "AT_content": "at_content",
    "sum": "len_sum", "min": "len_min", "max": "len_max", "mean": "len_mean", "median": "len_median", "N50": "n50", "N75": "n75", "N90": "n90",
    "contig_750": "contig_750", "contig_1000": "contig_1000", "contig_1500": "contig_1500", "G_Count": "g_count", "C_Count": "c_count", "A_Count": "a_count", "T_Count": "t_count",
}
TRIM_COLUMNS = {"locus": "locus", "ntax": "ntax", "before": "before", "after": "after", "removed": "removed"}


def write_zip(path: str, members: Iterator[tuple[str, str]], force: bool = False) -> str:
    """A zip archive of texts by their names, packed while it is written: one member is held at a time."""

    def fill(f: object) -> None:
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in members:
                z.writestr(name, text)

    write_stream(path, fill, force)
    return path


def position_members(positions: DataFrame) -> Iterator[tuple[str, str]]:
    """For each file of `genomics.read_positions` its member of the archive, one at a time."""
    name, rows = None, []
    cols = list(POSITION_COLUMNS.values())
    for r in positions.orderBy("path", "pos").toLocalIterator():
        if r.path != name and rows:
            yield os.path.basename(name).split(".")[0] + ".csv", csv_text(list(POSITION_COLUMNS), rows)
            rows = []
        name = r.path
        rows.append([r[c] for c in cols])
    if rows:
        yield os.path.basename(name).split(".")[0] + ".csv", csv_text(list(POSITION_COLUMNS), rows)


# --- the text report


def _n(v: float | None) -> str:
    return f"{v or 0:,}"


def _line(label: str, value: str) -> str:
    return f"{label:18}: {value}\n"


def report_text(total_taxa: int, site: Row, chars: Row, complete: list[Row], datatype: str = "dna") -> str:
    """The summary of a dataset from `stats.dataset_site_summary`, `dataset_char_summary` and `matrix_completeness`."""
    p = lambda v: f"{(v or 0) * 100:.2f}%"
    f = lambda v: f"{v or 0:.2f}"
    out = "General Summary\n" + _line("Total taxa", _n(total_taxa)) + _line("Total loci", _n(site.loci)) + _line("Total sites", _n(site.total_sites)) + _line("Total characters", _n(chars.total_chars))
    out += _line("Missing data", _n(chars.missing)) + _line("%Missing data", p(chars.prop_missing))
    if datatype != "aa":
        out += _line("GC content", f(chars.gc_content)) + _line("AT content", f(chars.at_content))
    out += _line("Characters", _n(chars.total_chars))
    if datatype != "aa":
        out += _line("Nucleotides", _n(chars.nucleotides))
    out += "\nAlignment Summary\n" + _line("Min length", _n(site.min_sites) + " bp") + _line("Max length", _n(site.max_sites) + " bp") + _line("Mean length", f(site.mean_sites) + " bp")
    out += "\nTaxon Summary\n" + _line("Min taxa", _n(chars.min_tax)) + _line("Max taxa", _n(chars.max_tax)) + _line("Mean taxa", f(chars.mean_tax))
    out += "\nCharacter Count\n" + "".join(_line(c, _n(chars[f"sym_{c}"])) for c in symbols(datatype) if chars[f"sym_{c}"])
    out += "\nMatrix Completeness\n" + "".join(_line(f"{r.percent}% taxa", _n(r.n_loci)) for r in complete)
    for title, loci, short, word, key in (("Conserved Sequences", "Conserved", "Con.", "con.", "cons"), ("Variable Sequences", "Var.", "Var.", "var.", "var"), ("Parsimony Informative", "Inf.", "Inf.", "inf.", "inf")):
        out += f"\n{title}\n" + _line(f"{loci} loci", _n(site[f"{key}_loci"])) + _line(f"%{short} loci", p(site[f"prop_{key}_loci"])) + _line(f"{loci} sites", _n(site[f"total_{key}"])) + _line(f"%{short} sites", p(site[f"prop_{key}"]))
        out += _line(f"Min {word} sites", _n(site[f"min_{key}"])) + _line(f"Max {word} sites", _n(site[f"max_{key}"])) + _line(f"Mean {word} sites", f(site[f"mean_{key}"]))
    return out


def with_file_name(df: DataFrame) -> DataFrame:
    """file_name and contig_name by the path."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return df.withColumns({"file_name": name, "contig_name": F.regexp_replace(name, r"(\.[^.]*)?(\.gz)?$", "")})


def natural_order() -> list:
    return [seqs.natural_key(F.col("locus")), "locus"]
