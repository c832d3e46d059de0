"""Whole Arrow batches in NumPy against plain Python."""

import random

import numpy as np
import pyarrow as pa

from phylospark.functions import codes, seqs
from phylospark.operators import stats


def test_translation():
    rng = random.Random(2)
    texts = ["", "A", "AC", None, "nnn---???"] + ["".join(rng.choices("ACGTacgtNn-?RYé", k=rng.randint(0, 40))) for _ in range(300)]
    for table in (1, 2, 33):
        code = codes.code(table)
        for frame in (1, 2, 3):
            def plain(s, frame=frame, code=code):
                s = s.upper()[frame - 1 :]
                return "".join(code.get(s[i : i + 3], "X") for i in range(0, len(s), 3))

            got = seqs.translate_batch(pa.array(texts).slice(1), np.full(len(texts) - 1, frame), seqs.codon_table(table)).to_pylist()
            assert got == [None if t is None else plain(t) for t in texts[1:]]
    assert seqs.translate_batch(pa.array([], pa.string()), np.zeros(0, dtype=np.int64), seqs.codon_table(1)).to_pylist() == []


def test_char_counts(spark, monkeypatch):
    """Counts by key and by row; null keys and sequences, symbols outside of ASCII, batches counted in several pieces."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice(["x", "y"]), rng.choice([None, "", "".join(rng.choices("ACGTacgtN-?.ſé汉", k=rng.randint(1, 30)))])) for _ in range(200)]
    df = spark.createDataFrame(rows, "locus string, taxon string, seq string").repartition(3)
    count = lambda texts, symbols: sum(t.upper().count(c) for t in texts for c in symbols)
    for cells in (4_000_000, 60):
        monkeypatch.setattr(stats, "MOST_CELLS", cells)
        got = {r.locus: r for r in stats.locus_chars(df).collect()}
        for key in ("a", "b", None):
            texts = [s or "" for k, _, s in rows if k == key]
            r = got[key]
            assert (r.ntax, r.nchar, r.total_chars) == (len(texts), max(map(len, texts)), len(texts) * max(map(len, texts)))
            assert (r.missing, r.gc, r["at"], r.nucleotides) == tuple(count(texts, x) for x in ("-?", "GC", "AT", "GCAT"))
            assert all(r[f"sym_{c}"] == count(texts, c) for c in stats.symbols("dna"))
    each = sorted((str(r.locus), r.taxon, r.total_chars, r.sym_S) for r in stats.per_locus_taxon(df).collect())
    assert each == sorted((str(k), t, len(s or ""), (s or "").upper().count("S")) for k, t, s in rows)
    by = {r.taxon: (r.locus_counts, r.total_chars) for r in stats.taxon_summary(df.filter("locus is not null")).collect()}
    assert by == {t: (len({k for k, u, _ in rows if u == t and k}), sum(len(s or "") for k, u, s in rows if u == t and k)) for t in ("x", "y")}
