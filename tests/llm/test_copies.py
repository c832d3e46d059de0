import random
import re

from pyspark.sql import functions as F

from phylospark.llm import copies as C

FIELDS = {"locus": "exact", "taxon": "words", "seq": "fold"}


def key(r):
    return r[1], tuple(sorted(x.lower() for x in re.findall("[A-Za-z0-9]+", r[2]))), r[3].lower()


def expected(rows):
    first, out = {}, set()
    for r in sorted(rows):
        if None not in r[1:4]:
            k = key(r)
            if k in first:
                out.add((first[k], r[0]))
            else:
                first[k] = r[0]
    return out, set(first.values())


def rows():
    rng = random.Random(4)
    taxa = ["Aus bus", "bus_AUS", "aus aus bus", "Aus-Bus-aus", "", "--", None, "Kaus", "Kaus", "x" * 50_000]
    out = [(i, rng.choice(["L1", "L2", None]), rng.choice(taxa), rng.choice(["ACGT", "acgt", "", None, "AC GT"]), "h1 clash") for i in range(300)]
    return out + [(1000 + i, "L1", "Aus bus", "ACGT", "x") for i in range(200)]


def test_copies(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, "row_id long, locus string, taxon string, seq string, h1 string").repartition(4)
    want, firsts = expected(data)
    for hot in (100_000, 20):
        got = [tuple(r) for r in C.copies(df, "row_id", FIELDS, hot_rows=hot).select("first_id", "copy_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(C, "is_small", lambda df: False)  # the way for more groups than are sent to all
    assert {tuple(r) for r in C.copies(df, "row_id", FIELDS, hot_rows=20).select("first_id", "copy_id").collect()} == want
    n = {r.first_id: r.n_copies for r in C.groups(df, "row_id", FIELDS).collect()}
    assert set(n) == firsts and sum(n.values()) == len(firsts) + len(want)
    assert C.copies(df.limit(0), "row_id", FIELDS).count() == 0


def test_equal_fingerprints_of_different_records(spark, monkeypatch):
    """A hash that cannot tell records apart: the comparison of the fields does."""
    monkeypatch.setattr(C, "fingerprint", lambda fields, seed: F.pmod(F.length("f_seq"), F.lit(2)).cast("bigint"))
    data = rows()
    df = spark.createDataFrame(data, "row_id long, locus string, taxon string, seq string, h1 string")
    want, firsts = expected(data)
    assert {tuple(r) for r in C.copies(df, "row_id", FIELDS).select("first_id", "copy_id").collect()} == want
    n = {r.first_id: r.n_copies for r in C.groups(df, "row_id", FIELDS).collect()}
    assert set(n) == firsts and sum(n.values()) == len(firsts) + len(want)


def test_field_order_does_not_matter(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (2, "B a", "c")], "row_id long, x string, y string")
    for fields in ({"x": "words", "y": "exact"}, {"y": "exact", "x": "words"}):
        hashes = {(r.h1, r.h2) for r in C.normalized(df, "row_id", fields).collect()}
        assert len(hashes) == 1
