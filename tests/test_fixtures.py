"""Small alignments with known results."""

import math

import pytest
from pyspark.sql import functions as F

from phylospark.functions import codes, seqs
from phylospark.operators import align, genomics, sequence, sites, stats

DDL = "locus string, path string, seq_idx int, taxon string, seq string"


def frame(spark, **loci):
    return spark.createDataFrame([(k, f"{k}.nex", i, t, s) for k, rows in loci.items() for i, (t, s) in enumerate(rows)], DDL)


ALN = {
    "gene_1": [("ABCD", "gatata")],
    "gene_2": [("ABCD", "gatataaa"), ("ABCF", "gatataat")],
    "gene_3": [("ABCD", "gatata"), ("ABCE", "gatatt")],
    "gene_4": [("ABCD", "gatata"), ("ABCE", "agtata")],
}
GAPPY = {
    "gene_1": [("ABCD", "gatat------"), ("ABCE", "agagtagagtt")],
    "gene_2": [("ABCD", "gatataaa"), ("ABCF", "gatataat"), ("ABCE", "gat-----")],
    "gene_3": [("ABCD", "gatata--"), ("ABCE", "gatattgg")],
    "gene_4": [("ABCD", "gatata--"), ("ABCE", "agtatatt")],
}
_A, _E, _F = "gatatagatataaagatatagatata", "gaaaaa????????gatattagtata", "aataaagatataat????????????"
LONG = {
    "aln_1": [("ABCD", _A), ("ABCE", _E), ("ABCF", _F), ("ABCG", "aaaaaa????aaaagatattagtata")],
    "aln_2": [("ABCD", _A), ("ABCE", _E), ("ABCF", _F), ("ABCG", "aaaaaa????aaaagatattagtata")],
    "aln_3": [("ABCD", _A), ("ABCE", _E), ("ABCF", _F), ("ABCG", "aaaaaa????aaaagatattagtaat")],
    "aln_4": [("ABCD", _A), ("ABCE", _E), ("ABCF", "attaaagatataatgaaattagtata"), ("ABCG", "ataaaaaaaaaaaagaaattagtata")],
}
AA = {
    "gene_1": [("ABCD", "?-ARNDC")],
    "gene_2": [("ABCD", "?-ARNDCQQ"), ("ABCF", "?-ARNDCHH")],
    "gene_3": [("ABCD", "?-ARNDCHH"), ("ABCE", "?-ARNDCHH")],
    "gene_4": [("ABCD", "?-ARNDC"), ("ABCE", "?-ARNDC")],
}
TRIM = {"trimming": [("seq1", "ATGCTGCA"), ("seq2", "AGCTGCA-"), ("seq3", "ATGCTGA-"), ("seq4", "ATGCTGA-")]}

#: ntax, nchar, chars, sites, cons, var, pinf, missing, GC, AT
EXPECTED = [
    (ALN, "dna", {"gene_1": (1, 6, 6, 6, 6, 0, 0, 0, 1, 5), "gene_2": (2, 8, 16, 8, 7, 1, 0, 0, 2, 14), "gene_3": (2, 6, 12, 6, 5, 1, 0, 0, 2, 10), "gene_4": (2, 6, 12, 6, 4, 2, 0, 0, 2, 10)}),
    (GAPPY, "dna", {"gene_1": (2, 11, 22, 11, 7, 4, 0, 6, 5, 11), "gene_2": (3, 8, 24, 8, 7, 1, 0, 5, 3, 16), "gene_3": (2, 8, 16, 8, 7, 1, 0, 2, 4, 10), "gene_4": (2, 8, 16, 8, 6, 2, 0, 2, 2, 12)}),
    (LONG, "dna", {"aln_1": (4, 26, 104, 26, 18, 8, 2, 24, 10, 70), "aln_2": (4, 26, 104, 26, 18, 8, 2, 24, 10, 70), "aln_3": (4, 26, 104, 26, 16, 10, 2, 24, 10, 70), "aln_4": (4, 26, 104, 26, 14, 12, 4, 8, 12, 84)}),
    (TRIM, "dna", {"trimming": (4, 8, 32, 8, 2, 6, 0, 3, 14, 15)}),
    (AA, "aa", {"gene_1": (1, 7, 7, 5, 5, 0, 0, 2), "gene_2": (2, 9, 18, 7, 5, 2, 0, 4), "gene_3": (2, 9, 18, 7, 7, 0, 0, 4), "gene_4": (2, 7, 14, 5, 5, 0, 0, 4)}),
]


@pytest.mark.parametrize("loci, datatype, want", EXPECTED)
def test_locus_summary(spark, loci, datatype, want):
    got = {r.locus: (r.ntax, r.nchar, r.total_chars, r.site_count, r.conserved, r.variable, r.pars_inf, r.missing, r.gc, r["at"]) for r in stats.locus_summary(frame(spark, **loci), datatype).collect()}
    assert {k: v[: len(want[k])] for k, v in got.items()} == want


def test_histogram_and_sites(spark):
    df = frame(spark, concat=LONG["aln_1"])
    assert {r.symbol: r.n for r in stats.char_histogram(df).collect()} == {"A": 48, "T": 22, "G": 10, "?": 24}
    inline = frame(spark, x=[("a", "AATT---"), ("b", "ATTA---"), ("c", "ATGC---"), ("d", "ATGA---")])
    r = sites.locus_sites(inline).first()
    assert (r.pars_inf, r.variable, r.site_count) == (1, 3, 4)
    assert sites.locus_sites(inline, fold_case=True).first().variable == 3
    cased = frame(spark, x=[("a", "Aa"), ("b", "aA")])
    assert sites.locus_sites(cased).first().variable == 2 and sites.locus_sites(cased, fold_case=True).first().variable == 0
    assert align.trim_missing(frame(spark, x=[("a", "AA--"), ("b", "AT--"), ("c", "ATGC"), ("d", "ATGA")]), 0.4).filter("length(seq) = 2").count() == 4


def loci(df):
    return sorted({r.locus for r in df.select("locus").distinct().collect()})


def test_locus_filters(spark):
    df = frame(spark, **LONG)
    n = lambda **o: len(loci(align.filter_loci(df, **o)))
    assert (n(percent=0.5), n(min_pinf=3), n(max_pinf=3), n(percent_inf=0.5), n(percent_inf=0.9), n(min_len=25), n(max_len=30), n(min_len=27)) == (4, 1, 3, 4, 1, 4, 4, 0)
    with pytest.raises(align.NothingLeft):
        align.not_empty(align.filter_loci(df, min_len=27))
    gappy = frame(spark, **GAPPY)
    assert loci(align.filter_loci(gappy, missing_data=0.25)) == ["gene_2", "gene_3", "gene_4"]
    assert len(loci(align.filter_loci(gappy, missing_data=0.125))) == 2  # inclusive
    assert loci(align.filter_loci(gappy, taxon_all=["ABCE", "ABCF"])) == ["gene_2"] and len(loci(align.filter_loci(gappy, min_ntax=3))) == 1
    assert loci(align.filter_loci(gappy, min_ntax=3, percent=0.5)) == loci(gappy)  # the percent wins
    ten = frame(spark, x=[(f"t{i}", "A") for i in range(10)], y=[(f"t{i}", "A") for i in range(6)], z=[(f"t{i}", "A") for i in range(5)])
    assert loci(align.filter_loci(ten, percent=0.65)) == ["x", "y"]
    with pytest.raises(ValueError):
        align.filter_loci(ten)


def test_completeness(spark):
    head = spark.createDataFrame([(f"l{n}", n) for n in (10, 8, 20, 30, 60)], "locus string, ntax long")
    total = spark.createDataFrame([(60,)], "total_taxa long")
    got = {r.percent: r.n_loci for r in stats.matrix_completeness(head, total, 10).collect()}
    assert got[100] == 1 and got[50] == 2 and got[10] == 5 and min(got) == 10


def test_concat_and_split(spark):
    df = frame(spark, **ALN)
    parts = [(r.gene, r.start, r.end) for r in align.partitions(df).orderBy("part_idx").collect()]
    assert parts == [("gene_1", 1, 6), ("gene_2", 7, 14), ("gene_3", 15, 20), ("gene_4", 21, 26)]
    whole = align.concat(df)
    assert {r.taxon: r.seq for r in whole.collect()} == {"ABCD": _A, "ABCE": "??????????????gatattagtata", "ABCF": "??????gatataat????????????"}
    back = align.split(whole.withColumn("seq_idx", F.lit(0)), align.partitions(df))
    assert sorted((r.locus, r.taxon, r.seq) for r in back.collect()) == sorted((k, t, s) for k, rows in ALN.items() for t, s in rows)
    with pytest.raises(Exception, match="beyond"):
        align.split(df, align.partitions(df)).collect()
    assert align.partitions(df, codon=True).count() == 12
    order = [r.gene for r in align.partitions(frame(spark, L10=[("a", "A")], L2=[("a", "A")], L1=[("a", "A")])).orderBy("part_idx").collect()]
    assert order == ["L1", "L2", "L10"]
    p = spark.createDataFrame([(0, "a", 1, 5), (1, "b", 7, 9), (2, "c", 9, 12)], "part_idx int, gene string, start long, end long")
    assert [(r.gene, r.expected) for r in align.contiguity(p).orderBy("start").collect()] == [("b", 6), ("c", 10)]


def test_split_by_blocks(spark, monkeypatch):
    """More parts than are sent to all executors, also overlapping ones: the same pieces."""
    n = 200_001
    seq = "".join("ACGT-?"[i % 6] for i in range(n))
    df = frame(spark, whole=[("a", seq), ("b", "?" * (n - 1) + "G")])
    parts = spark.range(n).select(F.col("id").alias("part_idx"), F.concat(F.lit("p"), "id").alias("gene"), (F.col("id") + 1).alias("start"), (F.col("id") + 1).alias("end"))
    got = {(r.locus, r.seq_idx, r.taxon, r.seq) for r in align.split(df, parts).collect()}
    assert got == {(f"p{i}", 0, "a", c) for i, c in enumerate(seq) if c not in "-?"} | {(f"p{n - 1}", 1, "b", "G")}
    monkeypatch.setattr(align, "BLOCK_PARTS", 3)
    df = frame(spark, whole=[("a", "ACG--TTGA?"), ("b", "????GATT??"), ("c", "----------")])
    p = spark.createDataFrame([(i, f"g{i}", s, e) for i, (s, e) in enumerate([(1, 3), (4, 5), (2, 9), (6, 10), (1, 10), (10, 10), (5, 4), (3, 10), (8, 2)])], "part_idx int, gene string, start long, end long")
    one, many = ([tuple(r) for r in align.split(df, p, "x", k).collect()] for k in (100, 2))
    assert sorted(one) == sorted(many) and len(one) == 10
    with pytest.raises(Exception, match="beyond"):
        align.split(df, p.union(spark.createDataFrame([(9, "far", 2, 11)], p.schema)), broadcast_rows=2).collect()


def test_trim(spark):
    df = frame(spark, **TRIM)
    for percent, n in ((0.4, 7), (0.6, 7), (0.75, 7), (0.8, 8), (1.0, 8)):
        assert {len(r.seq) for r in align.trim_missing(df, percent).collect()} == {n}
    assert {len(r.seq) for r in align.trim_missing(df, 0.0).collect()} == {8}  # no site is left: unchanged
    assert align.trim_pinf(df, 2).count() == 0
    s = align.trim_summary(df, align.trim_pinf(df, 2)).first()
    assert (s.before, s.after, s.removed) == (8, 0, 8)
    long = frame(spark, **LONG)
    assert {r.locus: r.after for r in align.trim_summary(long, align.trim_pinf(long, 2)).collect()} == {"aln_1": 2, "aln_2": 2, "aln_3": 2, "aln_4": 4}
    assert align.unalign(frame(spark, x=[("a", "ATG-?C")])).first().seq == "ATGC"


def test_sequence_filters(spark):
    gappy, df = frame(spark, **GAPPY), frame(spark, **ALN)
    kept = sequence.filter_max_gap(gappy, 0.5)
    assert len(loci(kept)) == 4 and kept.filter("locus = 'gene_1'").count() == 1
    assert loci(sequence.filter_min_length(gappy, 10)) == ["gene_1"] and loci(sequence.filter_min_length(df, 7)) == ["gene_2"]
    assert sequence.filter_max_length(gappy, 5).count() == 2
    assert sorted(r.taxon for r in stats.unique_ids(df).collect()) == ["ABCD", "ABCE", "ABCF"]
    assert len(loci(sequence.extract_ids(df, sequence.parse_ids("ABCD")))) == 4 and len(loci(sequence.extract_regex(df, "^AB"))) == 4
    assert len(loci(sequence.remove_ids(df, ["ABCD"]))) == 3 and len(loci(sequence.remove_regex(df, "E$"))) == 4
    table = spark.createDataFrame([("ABCF",), (None,)], "id string")
    assert sequence.extract_ids(df, table).count() == 1 and sequence.remove_ids(df, table).count() == 6


def ids(df):
    return {r.taxon for r in df.collect()}


def test_rename(spark):
    df = frame(spark, simple=[("ABCD", "AGTATG")])
    names = spark.createDataFrame([("ABCD", "WXYZ", 0), ("ABCD", "other", 1), (None, "x", 2)], "origin string, destination string, line_no int")
    assert ids(sequence.rename_table(df, names)) == {"WXYZ"}
    assert ids(sequence.rename_by(df, remove="BC")) == {"AD"} and ids(sequence.rename_by(df, remove_re="^A")) == {"BCD"} and ids(sequence.rename_by(df, remove_re_all="[^ABC]")) == {"ABC"}
    assert ids(sequence.rename_by(df, replace_re=("(B)(C)", "${2}-$1"))) == {"AC-BD"} and ids(sequence.rename_by(df, replace_re=("D$", "$$1"))) == {"ABC$1"}
    assert ids(sequence.rename_by(df, replace_re=("(?i)^abc", "x"))) == {"xD"} and ids(sequence.rename_by(df, replace=("B.", "x"))) == {"ABCD"}
    two = frame(spark, x=[("old1", "AC"), ("new", "ACGT"), ("old2", "ACGTACGT")])
    to = spark.createDataFrame([("old1", "new"), ("old2", "new")], "origin string, destination string")
    assert {(r.taxon, r.seq) for r in sequence.rename_table(two, to).collect()} == {("new", "ACGT"), ("old1", "AC")}
    assert [(r.taxon, r.seq, r.seq_idx) for r in sequence.rename_by(two, replace_re_all=(r"\d|new", "")).orderBy("seq_idx").collect()] == [("old", "ACGTACGT", 0), ("", "ACGT", 1)]
    dry = {(r.old, r.new, r.changed) for r in sequence.dry_run(two, remove="old").collect()}
    assert dry == {("old1", "1", True), ("old2", "2", True), ("new", "new", False)}


def test_add(spark):
    dest = frame(spark, **{k: v for k, v in ALN.items() if k in ("gene_1", "gene_2", "gene_9")})
    source = frame(spark, **GAPPY)
    c = sequence.add_counters(dest, source).first()
    assert (c.added_count, c.skipped_count, c.added_loci, c.skipped_loci) == (2, 3, 2, 0)
    got = {(r.locus, r.taxon, r.seq, r.is_added) for r in sequence.add(dest, source).collect()}
    assert got == {("gene_1", "ABCD", "gatata", False), ("gene_1", "ABCE", "agagtagagtt", True), ("gene_2", "ABCD", "gatataaa", False), ("gene_2", "ABCF", "gatataat", False), ("gene_2", "ABCE", "gat", True)}
    assert {(r.taxon, r.seq) for r in sequence.add_single(source).collect()} == {("ABCD", "gatat"), ("ABCE", "agagtagagtt"), ("ABCF", "gatataat")}
    assert sequence.add_single(source, id_by_locus=True).count() == 9


#: By table: a codon that tells it from the others nearby, and its amino acid.
CODONS = {1: ("AGA", "R"), 2: ("AGA", "*"), 3: ("CTA", "T"), 4: ("TGA", "W"), 5: ("AGG", "S"), 6: ("TAA", "Q"), 9: ("AAA", "N"), 10: ("TGA", "C"), 11: ("TGA", "*"), 12: ("CTG", "S"), 13: ("AGA", "G"), 14: ("TAA", "Y"), 16: ("TAG", "L"), 21: ("ATA", "M"), 22: ("TCA", "*"), 23: ("TTA", "*"), 24: ("AGG", "K"), 25: ("TGA", "G"), 26: ("CTG", "A"), 29: ("TAG", "Y"), 30: ("TAA", "E"), 33: ("TAA", "Y")}


def test_translate(spark):
    assert set(CODONS) == set(codes.DELTAS)
    for table, (codon, amino) in CODONS.items():
        assert codes.code(table)[codon] == amino
    one = lambda s, f=1: spark.createDataFrame([(s,)], "s string").select(seqs.translated(F.col("s"), 1, f)).first()[0]
    text = "AAAGGGGATTTAGTTAGAA"
    assert (one(text), one("T" + text, 2), one(text.lower() + "-----"), one("NNN" + text + "?????")) == ("KGDLVRX", "KGDLVRX", "KGDLVRX-", "XKGDLVRX?")
    assert (one(""), one("AA", 3), one(None)) == ("", "", None)
    with pytest.raises(ValueError):
        codes.code(7)
    auto = frame(spark, ok=[("a", "TTAGCC"), ("b", "TAATAA")], shift=[("a", "TAAGCC")], none=[("a", "TAATAATAATTAATTAA")])
    assert {r.locus: r.frame for r in sequence.auto_frames(auto).collect()} == {"ok": 1, "shift": 2, "none": None}
    with pytest.raises(Exception, match="no reading frame"):
        sequence.translate_auto(auto).collect()
    assert {(r.taxon, r.seq) for r in sequence.translate_auto(auto, strict=False).filter("locus = 'ok'").collect()} == {("a", "LA"), ("b", "**")}


READS = [("@1", "GGGTGATGGCCGCTGCCGATGGCGTCAAATCCCACC", "IIIIIIIIIIIIIIIIIIIIIIIIIIIIII9IG9IC"), ("@2", "GTTCAGGGATACGACGTTTGTATTTTAAGAATCTGA", "IIIIIIIIIIIIIIIIIIIIIIIIIIIIIIII6IBI")]


def test_reads(spark):
    df = spark.createDataFrame([("r1", s, q) for _, s, q in READS], "path string, seq string, qual string")
    r = genomics.read_summary(df).first()
    assert (r.read_count, r.base_count, r.g_count, r.c_count, r.a_count, r.t_count, r.low_qscore, r.min_qscore, r.max_qscore) == (2, 72, 21, 16, 16, 19, 0, 21, 40)
    assert math.isclose(r.mean_qscore * 72, 2814) and r.mean_read_len == 36
    p = {r.pos: r for r in genomics.read_positions(df).collect()}
    assert len(p) == 36 and (p[1].g_count, p[1].mean_qscore) == (2, 40.0) and (p[36].c_count, p[36].a_count, p[36].min_qscore, p[36].max_qscore, p[36].c_prop) == (1, 1, 34, 40, 0.5)
    bad = spark.createDataFrame([("r", "A", "K")], df.schema)
    with pytest.raises(Exception, match="above J"):
        genomics.read_summary(bad).collect()
    odd = spark.createDataFrame([("r", None, None), ("r", "", ""), ("r", "NN", "I"), (None, "A", "I")], df.schema)
    got = {r.path: r for r in genomics.read_summary(odd).collect()}
    assert (got["r"].read_count, got["r"].base_count, got["r"].gc_content, got[None].a_count) == (3, 2, 0.0, 1)
    pos = {(r.path, r.pos): r for r in genomics.read_positions(odd).collect()}
    assert pos["r", 1].g_prop is None and pos["r", 2].mean_qscore is None


def test_contigs(spark):
    lengths = lambda *n: spark.createDataFrame([("c", x) for x in n], "path string, len long").groupBy("path", "len").agg(F.count("*").alias("_n"))
    n = genomics.n_stats(lengths(*range(2, 11))).first()
    assert (n.n50, n.n75, n.n90) == (8, 6, 4)
    assert genomics.medians(lengths(1, 4, 3, 5, 6)).first().len_median == 4 and genomics.medians(lengths(1, 4, 3, 5, 6, 6, 8, 10)).first().len_median == 5.5
    df = spark.createDataFrame([("c1", "A" * 258 + "x"), ("c1", "GC" * 400), ("c1", "N" * 1001), ("c2", "")], "path string, seq string")
    got = {r.path: r for r in genomics.contig_summary(df).collect()}
    c = got["c1"]
    assert (c.contig_count, c.base_count, c.nucleotide, c.len_sum, c.len_median, c.contig_750, c.contig_1000, c.n50, c.n90) == (3, 2059, 1058, 2060, 800.0, 2, 1, 800, 259)
    assert got["c2"].gc_content is None and got["c2"].n50 == 0 and got["c2"].len_stdev is None
    v = spark.createDataFrame([("c", "A" * x) for x in (1, 4, 3, 5, 6, 6, 8, 10)], "path string, seq string")
    assert math.isclose(genomics.contig_summary(v).first().len_stdev, 2.825269, abs_tol=1e-6)


def test_blocks(spark):
    row = lambda src, start, text: (src, start, len(text), "+", 100, text)
    ddl = "path string, block_idx int, score double, sequences array<struct<source:string,start:bigint,size:bigint,strand:string,src_size:bigint,text:string>>"
    blocks = spark.createDataFrame([("m", 0, 1.0, [row("hg.chr1", 10, "AC"), row("mm.chr2", 5, "AG")]), ("m", 1, 1.0, [row("hg.chr1", 10, "TT")]), ("m", 2, 1.0, [row("hg.chr1", 99, "GG")])], ddl)
    bed = spark.createDataFrame([("chr1", 10, 20, "g.1"), ("chr9", 10, 30, "g9"), ("chr1", 50, 60, None)], "chrom string, chrom_start long, chrom_end long, name string")
    assert [(r.name, r.taxon, r.seq) for r in genomics.maf_rows(blocks).orderBy("block_idx", "seq_idx").collect()] == [("hg.chr1", "hg.chr1", "AC"), ("hg.chr1", "mm.chr2", "AG"), ("hg.chr1", "hg.chr1", "TT"), ("hg.chr1", "hg.chr1", "GG")]
    got = {(r.locus, r.taxon, r.seq, r.is_missing) for r in genomics.maf_named(blocks, bed).collect()}
    assert got == {("g_1-chr1-10-20", "hg.chr1", "TT", False), ("g_1-chr1-10-20", "mm.chr2", "AG", False), ("hg_chr1", "hg.chr1", "GG", True)}
    assert {(r.locus, r.seq) for r in genomics.maf_named(blocks, bed, append=True).filter("taxon = 'hg.chr1'").collect()} == {("g_1-chr1-10-20", "ACTT"), ("hg_chr1", "GG")}


def test_empty_and_null(spark):
    """Empty tables, empty texts and clashing extra columns."""
    none = frame(spark, x=[("a", "A")]).limit(0)
    for f in (stats.headers, stats.locus_summary, stats.taxon_summary, sites.site_missing, align.concat, align.partitions, align.unalign, sequence.auto_frames, stats.char_histogram):
        assert f(none).count() == 0
    assert align.trim_missing(none, 0.5).count() == 0 and sequence.add(none, none).count() == 0 and align.trim_pinf(none, 1).count() == 0
    assert stats.dataset_site_summary(sites.locus_sites(none)).first().loci == 0
    blank = frame(spark, x=[("a", ""), ("b", "")])
    r = stats.locus_summary(blank).first()
    assert (r.ntax, r.nchar, r.site_count, r.prop_missing) == (2, 0, None, None)
    assert align.violations(frame(spark, x=[("a", "AC!"), ("b", "acN-")]), "dna").first().taxon == "a"
