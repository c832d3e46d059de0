"""Commands over files: numbers of files, rows and columns that they write."""

import csv
import gzip
import os
import zipfile

import pytest

from phylospark.cli import main
from tests.test_fixtures import AA, ALN, GAPPY, LONG


def nexus(folder, loci, datatype="dna"):
    folder.mkdir(parents=True)
    for name, rows in loci.items():
        text = "".join(f"{t} {s}\n" for t, s in rows)
        (folder / f"{name}.nex").write_text(f"#NEXUS\nbegin data;\ndimensions ntax={len(rows)} nchar={len(rows[0][1])};\nformat datatype={datatype} missing=? gap=-;\nmatrix\n{text};\nend;\n")
    return str(folder)


@pytest.fixture
def at(tmp_path, spark):
    def run(group, command, folder, out, *more):
        return main([group, command, "-d", folder, "-o", str(tmp_path / out), *more], spark)

    return run


def table(path):
    return list(csv.reader(open(path)))


def test_align(at, tmp_path):
    aln, gappy, long = nexus(tmp_path / "aln", ALN), nexus(tmp_path / "gappy", GAPPY), nexus(tmp_path / "long", LONG)
    for fmt in ("nexus", "raxml"):
        paths = at("align", "concat", aln, f"concat-{fmt}", "-p", fmt, "-F", "phylip")
        assert open(paths[0]).readline() == "3 26\n" and len(paths) == 2
    one = at("align", "concat", aln, "charset", "-p", "charset", "--codon", "--prefix", "all")
    assert open(one[0]).read().count("charset") == 12
    whole = at("align", "concat", aln, "again", "--prefix", "all")
    back = at_split(at, tmp_path, whole)
    assert len(back) == 4 and open(back[0]).read() == ">ABCD\ngatata\n"
    assert len(at("align", "filter", long, "f1", "--min-pinf", "3")) == 1 and len(at("align", "filter", long, "f2", "--npercent", "0.5", "0.9")) == 8
    assert len(at("align", "filter", long, "f3", "--percent", "0.5", "--concat")) == 2
    for option, value, name in (("--min-len", "25", "n_25bp"), ("--max-pinf", "3", "n_3pinf"), ("--percent-inf", ".5", "n_50percent_pinf"), ("--missing-data", "0.255", "n_25.5percent_missing")):
        kept = at("align", "filter", long, "n", option, value)
        assert {os.path.basename(os.path.dirname(p)) for p in kept} == {name}
        assert all(open(p).read() == open(f"{long}/{os.path.basename(p)}").read() for p in kept)  # copied as they are
    with pytest.raises(ValueError, match="no alignments"):
        at("align", "filter", long, "f4", "--min-len", "27")
    assert len(at("align", "trim", gappy, "t", "--missing-data", "0.5")) == 5
    assert open(at("align", "unalign", gappy, "u")[0]).read() == ">ABCD\ngatat\n>ABCE\nagagtagagtt\n"
    assert len(at("align", "convert", aln, "c", "--sort", "-F", "fasta-int")) == 4


def at_split(at, tmp_path, whole):
    folder = tmp_path / "whole"
    folder.mkdir()
    (folder / "all.nex").write_text(open(whole[0]).read())
    return at("align", "split", str(folder), "split", "-I", whole[1], "-F", "fasta")


@pytest.mark.parametrize("datatype, loci, columns, taxa", [("dna", ALN, (34, 26, 25), 3), ("aa", AA, (43, 35, 34), 3)])
def test_summary(at, tmp_path, datatype, loci, columns, taxa):
    folder = nexus(tmp_path / "in", loci, "protein" if datatype == "aa" else "dna")
    report, taxon, locus = at("align", "summary", folder, "s", "--datatype", datatype)
    assert "Total loci        : 4\n" in open(report).read() and "100% taxa         : 0\n" in open(report).read()
    t, x = table(locus), table(taxon)
    assert len(t) == 5 and len(x) == taxa + 1 and {len(r) for r in t} == {columns[0]} and {len(r) for r in x} == {columns[1]}
    per = at("align", "summary", folder, "p", "--datatype", datatype, "--per-locus")
    assert len(per) == 4 and {len(r) for r in table(per[0])} == {columns[2]}


def test_sequence(at, tmp_path):
    aln, gappy = nexus(tmp_path / "aln", ALN), nexus(tmp_path / "gappy", GAPPY)
    assert len(at("sequence", "extract", aln, "e1", "--id=ABCD")) == 4 and len(at("sequence", "extract", aln, "e2", "--re=^AB")) == 4
    assert len(at("sequence", "remove", aln, "r1", "--id=ABCD")) == 3 and len(at("sequence", "remove", aln, "r2", "--re=E$")) == 4
    (tmp_path / "ids.txt").write_text("ABCF\n")
    assert len(at("sequence", "extract", aln, "e3", "--file", str(tmp_path / "ids.txt"))) == 1
    with pytest.raises(ValueError):
        at("sequence", "extract", aln, "e4", "--id=none")
    assert len(at("sequence", "filter", gappy, "f1", "--max-gap", "0.5")) == 4 and len(at("sequence", "filter", gappy, "f2", "--min-length", "10")) == 1
    ids, wide = at("sequence", "id", aln, "i", "--map")
    assert open(ids).read() == "ABCD\nABCE\nABCF\n" and table(wide)[1] == ["gene_1", "true", "false", "false"]
    (tmp_path / "n.csv").write_text("old,new\nABCD,WXYZ\n")
    assert "WXYZ" in open(at("sequence", "rename", aln, "n1", "--replace-id", str(tmp_path / "n.csv"))[0]).read()
    assert "xBCD" in open(at("sequence", "rename", aln, "n2", "--replace-from-re=^A", "--replace-to=x")[0]).read()
    assert at("sequence", "rename", aln, "n3", "--remove=BC", "--dry-run") == []
    assert len(at("sequence", "translate", aln, "t1", "--table", "2")) == 4 and all("RF-1" in p for p in at("sequence", "translate", aln, "t2", "--auto-read"))
    added = at("sequence", "add", gappy, "a1", "--to-dir", aln, "--added-only")
    assert len(added) == 2 and all(p.endswith(".fas") and open(p).read()[0] == ">" for p in added)
    with pytest.raises(Exception, match="one length"):
        at("align", "convert", at_raw(tmp_path), "uneven", "-F", "phylip")
    single = at("sequence", "add", gappy, "a2", "--to-file", str(tmp_path / "one.fas"))
    assert open(single[0]).read().count(">") == 3
    with pytest.raises(FileExistsError):
        at("sequence", "add", gappy, "a3", "--to-file", str(tmp_path / "one.fas"))


def at_raw(tmp_path):
    (tmp_path / "raw_fasta").mkdir()
    (tmp_path / "raw_fasta" / "u.fas").write_text(">A\nACGT\n>B\nAC\n")
    return str(tmp_path / "raw_fasta")


def test_genomics(at, tmp_path, spark):
    folder = tmp_path / "raw"
    folder.mkdir()
    for k in (1, 2):
        (folder / f"read_{k}.fastq").write_text("@a\nACGN\n+\nII!I\n@b\nGG\n+\nII\n")
    assert [r[2] for r in table(at("read", "summary", str(folder), "m", "--mode", "minimal")[0])] == ["read_count", "2", "2"]
    found = at("read", "summary", str(folder), "c", "--mode", "complete")
    assert {len(r) for r in table(found[0])} == {21} and sorted(zipfile.ZipFile(found[1]).namelist()) == ["read_1.csv", "read_2.csv"]
    (tmp_path / "asm").mkdir()
    (tmp_path / "asm" / "c1.fa").write_text(">x\nACGT\n>y\nGG\n")
    rows = table(at("contig", "summary", str(tmp_path / "asm"), "k")[0])
    assert len(rows[1]) == 22 and rows[1][1:4] == ["c1", "2", "6"]
    (tmp_path / "maf").mkdir()
    (tmp_path / "maf" / "m.maf").write_text("a score=1\ns hg.chr1 10 2 + 99 AC\ns mm.chr1 1 2 + 99 AG\n\na score=2\ns hg.chr1 50 2 + 99 GG\n")
    (tmp_path / "b.bed").write_text("chr1\t10\t20\tgene\n")
    assert len(at("maf", "convert", str(tmp_path / "maf"), "x1")) == 2
    named = at("maf", "convert", str(tmp_path / "maf"), "x2", "--reference", str(tmp_path / "b.bed"), "--from-bed")
    assert [p.rsplit("/", 2)[-2:] for p in named] == [["x2", "gene-chr1-10-20.fas"], ["missing-refs", "hg_chr1.fas"]]
    (tmp_path / "p.txt").write_text("DNA, a = 1-5\nDNA, b = 6-10\nDNA, c = 11-15\n")
    conv = lambda out, *more: open(main(["partition", "convert", "-i", str(tmp_path / "p.txt"), "-o", str(tmp_path / out), "-P", "raxml", *more], spark)[0]).read().count("\n")
    assert conv("q1") == 3 and conv("q2", "--codon") == 9
    (tmp_path / "my_p.txt").write_text("DNA, z = 1-7\n")  # a name that ends like the other's
    both = main(["partition", "convert", "-i", str(tmp_path / "p.txt"), str(tmp_path / "my_p.txt"), "-o", str(tmp_path / "q3"), "-P", "raxml"], spark)
    assert {os.path.basename(p): open(p).read().count("\n") for p in both} == {"my_p_partition.txt": 1, "p_partition.txt": 3}
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "r.bin").write_bytes(gzip.compress(b"@a\nAC\n+\nII\n"))
    (tmp_path / "packed" / "c.bin").write_bytes(gzip.compress(b">x\nACGT\n>y\nGG\n"))
    one = main(["read", "summary", "-i", str(tmp_path / "packed" / "r.bin"), "-f", "gzip", "-o", str(tmp_path / "g1"), "--mode", "minimal"], spark)
    assert table(one[0])[1][1:] == ["r.bin", "1"]
    two = main(["contig", "summary", "-i", str(tmp_path / "packed" / "c.bin"), "-f", "gzip", "-o", str(tmp_path / "g2")], spark)
    assert table(two[0])[1][2:4] == ["2", "6"]
