import random

import numpy as np
import pytest

from phylospark.operators import sites


@pytest.mark.parametrize("datatype", ["dna", "aa"])
def test_matrices_against_rows(spark, datatype):
    """Small blocks and few held characters, so that loci are cut and passed on in parts; a hot locus, uneven lengths, symbols outside of ASCII."""
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), "".join(rng.choices("ACGTacgt-?NXé汉", k=rng.choice([0, 20, 25, 25, 25])))) for _ in range(300)] + [("n", None)]
    df = spark.createDataFrame(rows, "locus string, seq string").repartition(3)
    key = lambda d: {(r.locus, r.pos): (r.n_states, r.n_twice, r.n_missing, r.n_rows) for r in d.collect()}
    assert key(sites.site_states(df, datatype, block=10, few=3, held=500)) == key(sites.site_states_sql(df.filter("seq is not null"), datatype))
    assert sites.site_states(df.limit(0), datatype).count() == 0


def test_packed_counts():
    a, b, whole = sites.Counts(), sites.Counts(), sites.Counts()
    for k, piece in enumerate(["ACé", "A", "-CGTT", "", "汉汉"]):
        (a if k % 2 else b).add(piece)
        whole.add(piece)
    a.add_packed(*b.packed())
    assert all((x == y).all() for x, y in zip(a.sites("aa"), whole.sites("aa")))


def test_sums_and_masks(spark):
    """Sums by locus and masks of sites over several blocks, against plain counting; null and empty sequences count as rows."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 4 + ["a", None]), "".join(rng.choices("ACGTacgt-?Nſ", k=37))) for _ in range(120)] + [("a", ""), ("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "locus string, seq string").repartition(3)
    by = {}
    for locus, seq in rows:
        by.setdefault(locus, []).append(seq or "")
    got = {r.locus: r for r in sites.locus_sums(df, symbols="ACS-", block=10).collect()}
    assert set(got) == set(by)
    for locus, seqs in by.items():
        r = got[locus]
        columns = [[s[i] for s in seqs if i < len(s)] for i in range(max(map(len, seqs)))]
        states = [[c for c in set(col) if c in "ACGTacgt"] for col in columns]
        twice = [[c for c in st if col.count(c) > 1] for st, col in zip(states, columns)]
        assert (r.ntax, r.nchar) == (len(seqs), len(columns))
        assert (r.site_count, r.conserved, r.variable) == tuple(sum(f(len(s)) for s in states) for f in (lambda n: n >= 1, lambda n: n == 1, lambda n: n > 1))
        assert r.pars_inf == sum(len(t) >= 2 for t in twice)
        up = "".join(seqs).upper()
        assert [r[f"n_{ord(c)}"] for c in "ACS-"] == [up.count(c) for c in "ACS-"]
    masks = {r.locus: r for r in sites.site_masks(df, lambda states, twice, missing, rows: missing * 5 < rows, block=10).collect()}
    for locus, seqs in by.items():
        bits = [b for m in masks[locus].masks for b in np.unpackbits(np.frombuffer(m, dtype=np.uint8))[:10]][: max(map(len, seqs))]
        columns = [[s[i] for s in seqs if i < len(s)] for i in range(max(map(len, seqs)))]
        assert bits == [sum(c in "-?" for c in col) * 5 < len(col) for col in columns] and masks[locus].n_kept == sum(bits)
