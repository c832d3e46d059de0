"""Files of each format: what they parse to, what must fail, and round trips through the writers."""

import gzip
import io
import os

import pytest
from pyspark.sql import functions as F

from phylospark.operators import align
from phylospark.plans import roundtrips
from phylospark.sources import files, parsers, ranges, sinks

NEX = "#NEXUS\n\nBEGIN DATA;\nDIMENSIONS  NTAX={n} NCHAR={c};\nFORMAT DATATYPE=DNA GAP=- MISSING=?{i};\nMATRIX\n\n{m}\n;\nEND;"


def nex(m, n, c, i=""):
    return NEX.format(m=m, n=n, c=c, i=i)


def rows(df):
    return [(r.taxon, r.seq) for r in df.orderBy("path", "seq_idx").collect()]


def put(tmp_path, name, text):
    (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_nexus_text():
    assert parsers.nexus(nex("ABCD GATATA", 1, 6))[0] == {"ABCD": "GATATA"}
    assert parsers.nexus(nex("ABCD gatata---\nABEF gatata---", 2, 9).replace("\n;", ";"))[0]["ABEF"] == "gatata---"
    inter = "ABCD gatata\nABCE gatatg\nABCF gatatt\n\nABCD gatatt\nABCE gatatt\nABCF gatatt"
    for word in (" interleave", " interleave=yes"):
        assert parsers.nexus(nex(inter, 3, 12, word))[0]["ABCD"] == "gatatagatatt"
    for bad in (nex(inter, 3, 12), nex("ABCD GATATA\nABCD GATATA", 2, 6), nex("AB CD GATATA", 1, 6), nex("A GATATA", 10, 6), nex("A GATATA", 1, 7), ">A\nGATATA\n"):
        with pytest.raises(parsers.FormatError):
            parsers.nexus(bad)
    assert parsers.nexus_ids(nex(inter, 3, 12, " interleave")) == ["ABCD", "ABCE", "ABCF"]


def test_phylip_text():
    assert parsers.phylip("2   4\nABCD  AGTC \nEFGH  ATGC ")[0] == {"ABCD": "AGTC", "EFGH": "ATGC"}
    assert parsers.phylip("2   10\nABCD agcc\nEFGH acgg\natgg\nacct\naa\ncc")[0] == {"ABCD": "agccatggaa", "EFGH": "acggacctcc"}
    assert parsers.phylip("2   10\nABCD agcc\nEFGH acgg\n\natgg\nacct\n\ncc\ncc")[0]["ABCD"] == "agccatggcc"
    for bad in ("2   4\nAB CD AGTC\nEF GH ATGC", "2   12\nABCD agcc\nEFGH acgg\natgg\nacct\naa\ncc", "", "x y\n"):
        with pytest.raises(parsers.FormatError):
            parsers.phylip(bad)
    assert parsers.phylip_ids("2   10\nABCD agcc\nEFGH acgg\natgg\nacct") == ["ABCD", "EFGH"]


def test_partition_text():
    want = [("locus1", 1, 5), ("locus2", 6, 10), ("locus3", 11, 15)]
    rax = "DNA, locus1 = 1-5\nDNA, locus2 = 6-10\nDNA, locus3 = 11-15"
    nexus = "#nexus\nbegin sets;\n    charset locus1 = 1-5;\n    charset locus2 = 6-10;\n    charset locus3 = 11-15;\nend;"
    codon = "\n".join(f"DNA, locus{k}_Subset{j} = {s + j - 1}-{s + 4}\\3" for k, s in ((1, 1), (2, 6), (3, 11)) for j in (1, 2, 3))
    for text, fmt in ((rax, "raxml"), (rax.replace("-", " - "), "raxml"), (rax.replace("DNA, ", ""), "raxml"), (codon, "raxml"), (nexus, "nexus"), (nexus.replace("-", " - "), "nexus"), (rax + "\n\n", "raxml")):
        assert parsers.partition(text, fmt) == want
    parsers.check_contiguous(want)
    for bad in ([("a", 5, 10)], [("a", 0, 5)], [("a", 1, 5), ("b", 7, 9)]):
        with pytest.raises(parsers.FormatError):
            parsers.check_contiguous(bad)
    with pytest.raises(parsers.FormatError):
        parsers.partition("DNA, lo cus = 1-5", "raxml")
    assert parsers.partition("locus_subset1 = 1-100\nlocus_subset2 = 101-200", "raxml") == [("locus_subset1", 1, 100), ("locus_subset2", 101, 200)]
    assert parsers.partition("\n".join(f"g_codon{k} = {k}-30\\3" for k in (1, 2, 3)) + "\nh = 31-40", "raxml") == [("g_codon1", 1, 30), ("h", 31, 40)]
    assert parsers.partition("a = 1-9\na = 1-9\nb_2ndPos.x = 10-12\\3", "raxml") == [("a", 1, 9), ("a", 1, 9), ("b_x", 10, 12)]
    for empty in ("", "\n\n", "#nexus\nbegin sets;\nend;\n"):
        for fmt in ("raxml", "nexus"):
            with pytest.raises(parsers.FormatError, match="no part"):
                parsers.partition(empty, fmt)
    for fmt in sinks.PARTITION_FORMATS:
        assert parsers.partition(sinks.partition_text(want, fmt), "raxml" if fmt.startswith("raxml") else "nexus") == want
    assert sinks.partition_text(want, "raxml-codon").count("\n") == 9 and sinks.partition_text([("a-b", 1, 2)], "nexus") == "#nexus\nbegin sets;\ncharset 'a-b' = 1-2;\nend;\n"


MAF = """track name=own description="Three beetles" visibility=pack
##maf version=1 scoring=none
# (ref (near far))
a score=77.5
s ref.two   100 9 + 5000 ACG-TTGAAC
s near.nine 220 9 + 4100 ACG-TTGAAC
q near.nine 8876
i near.nine N 0 C 3

a score=12.0
s ref.two   400 5 + 5000 GGTCA
e far.one   31 13 + 900 I
a
s ref.two   700 4 + 5000 ttag"""


def test_maf_text():
    found = list(parsers.maf(iter(MAF.splitlines())))
    assert [x["kind"] for x in found] == ["track", "header", "comment", "block", "block", "block"]
    assert found[0]["fields"]["description"] == "Three beetles" and found[1]["fields"] == {"version": "1", "scoring": "none"}
    assert [x["score"] for x in found[3:]] == [77.5, 12.0, None] and [len(x["sequences"]) for x in found[3:]] == [2, 1, 1]
    assert found[3]["quality"]["values"] == list("8876") and found[3]["information"]["right_count"] == 3 and found[4]["empty"]["start"] == 31


def test_maf_frame(spark, tmp_path):
    path = put(tmp_path, "x.maf", MAF)
    got = files.scan_maf(spark, [path]).orderBy("block_idx").collect()
    assert [r.score for r in got] == [77.5, 12.0, None] and got[0].sequences[1].source == "near.nine" and got[0].path == path
    assert {r.kind for r in files.scan_maf_meta(spark, [path]).collect()} == {"track", "header", "comment"}


def test_fasta(spark, tmp_path):
    a = put(tmp_path, "a b.fas", "junk\n>ABCD\nAGTATG\nATGTAT\n\n>CDEF    \r\nATG TAT\r\n>empty\n")
    assert rows(files.scan_fasta(spark, [a])) == [("ABCD", "AGTATGATGTAT"), ("CDEF", "ATGTAT"), ("empty", "")]
    assert files.scan_fasta(spark, [a]).first().path == a and files.scan_fasta(spark, [a]).first().locus == "a b"
    twice = put(tmp_path, "d.fas", ">A\nAC\n>A\nAC\n")
    with pytest.raises(Exception, match="twice"):
        files.scan_fasta(spark, [twice]).collect()
    assert {(r.locus, r.taxon) for r in files.scan_ids(spark, [a, twice]).collect()} == {("a b", "ABCD"), ("a b", "CDEF"), ("a b", "empty"), ("d", "A")}


def test_auto_and_checks(spark, tmp_path):
    put(tmp_path, "g1.nex", nex("ABCD gatata", 1, 6))
    put(tmp_path, "g2.phy", "2 4\nA ACGT\nB AC-?\n")
    put(tmp_path, "sub/g3.fa", ">A\nAC\n>B\nACG\n")
    put(tmp_path, "notes-gene.txt", "x")
    flat = files.input_paths(spark, files.ALIGNMENTS, str(tmp_path))
    assert [p.rsplit("/", 1)[-1] for p in flat] == ["g1.nex", "g2.phy"]
    every = files.input_paths(spark, files.ALIGNMENTS, str(tmp_path), recursive=True)
    assert files.scan_alignments(spark, every).count() == 5
    with pytest.raises(Exception, match="not aligned"):
        files.scan_alignments(spark, every, aligned=True).collect()
    with pytest.raises(Exception, match="no aa"):
        files.scan_alignments(spark, flat, datatype="aa").collect()
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(tmp_path), ["maf"])
    with pytest.raises(ValueError):
        files.input_paths(spark, ["maf"])
    bad = put(tmp_path, "bad.nex", nex("A AC", 2, 2))
    with pytest.raises(Exception, match="bad.nex"):
        files.scan_nexus(spark, [bad]).collect()


@pytest.mark.parametrize("fmt", sinks.SEQUENCE_FORMATS)
def test_round_trip(spark, tmp_path, fmt):
    long = "ACGT-?" * 41
    data = [("L1", 0, "ABCD", long), ("L1", 1, "E", long[::-1]), ("L2", 0, "X", "ACG"), ("L3", 0, "P", "AC" * 1200)]
    df = spark.createDataFrame(data, "locus string, seq_idx int, taxon string, seq string")
    out = str(tmp_path / "out")
    paths = sinks.write_alignments(df, out, fmt)
    assert [p.rsplit("/", 1)[-1].split(".")[0] for p in paths] == ["L1", "L2", "L3"]
    got = files.scan_alignments(spark, paths).select("locus", "seq_idx", "taxon", "seq").collect()
    assert sorted(tuple(r) for r in got) == data
    with pytest.raises(FileExistsError):
        sinks.write_alignments(df, out, fmt)
    sinks.write_alignments(df, out, fmt, force=True)
    one = sinks.write_one(df.filter("locus = 'L1'"), str(tmp_path / ("one." + sinks.SEQUENCE_FORMATS[fmt])), fmt)
    assert rows(files.scan_alignments(spark, [one])) == [(t, s) for _, _, t, s in data[:2]]


FASTQ = [("@r1", "GGGTGATGG", "IIIIIIII9"), ("@r2 x", "GTTCAG", "@IIIII"), ("@r3", "ACGT", "@+I@"), ("@", "A", "I"), ("@r5", "", "")]


def fastq_text(n):
    return "".join(f"{h}{i}\n{s}\n+\n{q}\n" for i in range(n) for h, s, q in FASTQ)


def test_fastq(spark, tmp_path):
    """Ranges of every size give each read once; quality lines that look like headers do not mislead; packed files of several members."""
    text = fastq_text(6)
    plain = put(tmp_path, "r.fastq", text)
    want = [(f"{h[1:]}{i}", s, q) for i in range(6) for h, s, q in FASTQ]
    for size in (1, 7, 50, 64, 1 << 20):
        reader = ranges.FastqReader({"paths": plain, "split_bytes": str(size)})
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["name"], r["seq"], r["qual"]) for r in got] == want
        assert [r["read_idx"] for r in got] == sorted({r["read_idx"] for r in got})
    for block in (1, 3, 16, 1000):
        found = [(h, s, q) for _, *cols in ranges.records(io.BytesIO(text.encode()), 0, ranges.ENDLESS, True, block) for h, s, q in zip(*(c.to_pylist() for c in cols))]
        assert found == want
    packed = tmp_path / "r2.fq.gz"
    packed.write_bytes(gzip.compress(fastq_text(1).encode()) + gzip.compress(fastq_text(2).replace("\n", "\r\n").encode()))
    df = files.scan_fastq(spark, files.input_paths(spark, ["fastq"], str(tmp_path)), split_bytes=64)
    assert {r.file_name: r["count"] for r in df.groupBy("file_name").count().collect()} == {"r.fastq": 30, "r2.fq.gz": 15}
    assert df.filter("file_name = 'r2.fq.gz'").agg(F.max(F.length("qual"))).first()[0] == 9
    with pytest.raises(ValueError, match="FASTQ|incomplete"):
        bad = put(tmp_path, "bad.fastq", "@a\nAC\n+\nI\n@b\nAC\n+\nII\n")
        reader = ranges.FastqReader({"paths": bad})
        [list(reader.read(p)) for p in reader.partitions()]


def test_contigs(spark, tmp_path):
    a = put(tmp_path, "c1.fa", ">x one\nACGT\nAC\n\n>y\nGG>T\n")
    (tmp_path / "c2.fa.gz").write_bytes(gzip.compress(b">z\r\nAC\r\nNN\r\n"))
    got = {(r.contig_name, r.id, r.seq) for r in files.scan_contigs(spark, [a, str(tmp_path / "c2.fa.gz")]).collect()}
    assert got == {("c1", "x one", "ACGTAC"), ("c1", "y", "GG>T"), ("c2", "z", "ACNN")}


def test_bed(spark, tmp_path):
    body = "chr1\t1000\t5000\tgene1\t0\t+\nchr1\t2000\t6000\tgene2\t0\t-\nchr1\t3000\t7000\n"
    head = "# comment\nbrowser position chr1:1000-11000\ntrack name=\"x\"\n\n"
    for text in (body, head + body):
        got = files.scan_bed(spark, [put(tmp_path, "a.bed", text)]).orderBy("chrom_start").collect()
        assert [(r.chrom_start, r.chrom_end, r.name, r.score, r.strand) for r in got] == [(1000, 5000, "gene1", 0, "+"), (2000, 6000, "gene2", 0, "-"), (3000, 7000, None, None, None)]
    for bad in ("chr1\t5\t5\n", "chr1\t1\n", "chr1\t1\t2\tn\tx\n"):
        with pytest.raises(Exception, match="BED|score"):
            files.scan_bed(spark, [put(tmp_path, "bad.bed", bad)]).collect()


def test_tables(spark, tmp_path):
    for name, text in (("m.csv", "origin,destination\nold,new\n"), ("m.tsv", "origin  destination\nold    new")):
        assert [(r.origin, r.destination) for r in files.scan_mapping(spark, put(tmp_path, name, text)).collect()] == [("old", "new")]
    with pytest.raises(Exception, match="two fields"):
        files.scan_mapping(spark, put(tmp_path, "b.csv", "a,b\nx\n")).collect()
    assert [r.item for r in files.scan_list(spark, put(tmp_path, "l.txt", "a \nb\n")).collect()] == ["a ", "b"]
    p = put(tmp_path, "p.txt", "DNA, a = 1-5\nDNA, b = 6-10\n")
    assert [(r.gene, r.start, r.end) for r in files.scan_partitions(spark, [p]).collect()] == [("a", 1, 5), ("b", 6, 10)]
    with pytest.raises(Exception, match="begins at"):
        files.scan_partitions(spark, [put(tmp_path, "q.txt", "a = 5-10")]).collect()
    assert files.scan_partitions(spark, [str(tmp_path / "q.txt")], checked=False).count() == 1


def test_segments_as_a_packed_file(spark, tmp_path, monkeypatch):
    """The text that is written of the sequences themselves, packed, without a shuffle of it; read back as segments, and as the same sequences. Both widths of blocks, several tasks and rows laid out in turns."""
    monkeypatch.setattr(sinks, "LAID_ROWS", 2)
    monkeypatch.setattr(sinks, "TASK_CHARS", 200)
    for k, (long, short) in enumerate(((130, 30), (1200, 900))):
        rows = [("L1", "b", "ACGT?" * (long // 5)), ("L1", "a_1", "-" * long), ("L2", "longer", "G" + "?" * (short - 1)), ("L2", "b", "TTN" * (short // 3)), ("L3", "c", "?" * 7), ("L10", "a_1", "acg")]
        aln = spark.createDataFrame(rows, "locus string, taxon string, seq string")
        whole = {r.taxon: r.seq for r in align.concat(aln).collect()}
        total = len(whole["b"])
        path = sinks.write_segments(align.segments(aln), total, f"{tmp_path}/all{k}.nex.gz")
        plain = sinks.write_one(align.concat(aln), f"{tmp_path}/all{k}.nex", "nexus-int")
        assert gzip.open(path).read() == open(plain, "rb").read()
        for p in (path, plain):
            back = files.scan_nexus_segments(spark, [p])
            assert {r.taxon: r.seq for r in align.joined(back, back.agg(F.max("end").alias("_total"))).collect()} == whole
    with pytest.raises(FileExistsError):
        sinks.write_segments(align.segments(aln), total, path)
    for text in ("#NEXUS\nbegin data;\ndimensions ntax=2 nchar=3;\nmatrix\na ACG\n;\nend;\n", "#NEXUS\nmatrix\na ACG\n", "#NEXUS\nmatrix\na ACG\nb A\n;\n", "matrix\na ACG\n;\n"):
        with pytest.raises(parsers.FormatError):
            list(parsers.nexus_segments(iter([text[:20].encode(), text[20:].encode()])))


def test_files_concat_keeps_no_plain_text(spark, tmp_path, monkeypatch):
    """The query's file is a small part of its text, and no one-file writer of whole sequences is used."""
    n = 4_000
    rows = [(i * 40 + j, f"L{i}", f"t{i * 40 + j}", j, "p", "ACGT" * 100) for i in range(n // 400) for j in range(40)]
    spark.createDataFrame(rows, "row_id long, locus string, taxon string, seq_idx int, path string, seq string").write.parquet(f"{tmp_path}/sequences.parquet")
    monkeypatch.setattr(sinks, "write_one", None)
    sizes, write = [], sinks.write_segments
    monkeypatch.setattr(sinks, "write_segments", lambda *a: sizes.append(os.path.getsize(p := write(*a))) or p)
    got = {r.taxon: r.seq for r in roundtrips.QUERIES["files_concat"](spark, str(tmp_path)).collect()}
    assert len(got) == 400 and {len(s) for s in got.values()} == {n} and sizes[0] * 10 < 400 * n
