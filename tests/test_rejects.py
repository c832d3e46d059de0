"""Raw lines against a plain reading of the rules, one line at a time."""

import random
import re

import pyarrow as pa
import pytest

from phylospark.operators import rejects as R


def plain_id(x):
    x = x.strip(" ")
    return 1 <= len(x) <= 120 and all(" " <= c <= "~" for c in x) and bool(re.search("[A-Za-z0-9]", x)) and x.lower() not in ("na", "n/a", "null", "none")


def plain_csv(line):
    fields, rest = [], line
    while True:
        rest = rest.lstrip(" \t")
        if rest.startswith('"'):
            m = re.match(r'"((?:[^"]|"")*)"[ \t]*(?=,|\Z)', rest)
            if not m:
                return False
            fields.append(m[1].replace('""', '"'))
            rest = rest[m.end() :]
        else:
            m = re.match(r'[^,"]*(?=,|\Z)', rest)
            if not m:
                return False
            fields.append(m[0].strip(" \t"))
            rest = rest[m.end() :]
        if not rest:
            break
        rest = rest[1:]
    return len(fields) == 2 and all(map(plain_id, fields))


def plain(kind, no, line):
    """True: row, False: reject, None: no record."""
    if kind not in ("csv", "tsv", "bed") or line is None:
        return False
    if line.endswith("\r"):
        line = line[:-1]
    if kind != "bed" and no == 1:
        return None
    if kind == "bed" and line.startswith(("#", "track", "browser")):
        return None
    if kind == "csv":
        return plain_csv(line)
    if '"' in line:
        return False
    if kind == "tsv":
        f = re.split(r"[ \t]+", line.strip(" \t"))
        return len(f) == 2 and all(map(plain_id, f))
    f = line.split("\t")
    digits = lambda x: bool(re.fullmatch("[0-9]+", x))
    if not 3 <= len(f) <= 12 or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.\-]*", f[0]) or f[0].lower() in ("na", "n/a", "null", "none"):
        return False
    if not digits(f[1]) or not digits(f[2]) or int(f[1]) >= int(f[2]):
        return False
    if len(f) >= 5 and (not digits(f[4]) or int(f[4]) > 65535):
        return False
    return len(f) < 6 or f[5] in ("+", "-", ".")


CASES = ['a,b', '"a,b",c', ' "a" , "b" \r', '"a""b",c', '"a"b,c', 'a"b,c', '"a,b', '"a, "b"', 'a,b,c', 'a', '', ',', 'NA,b', '"\ta",b', '\ta\t,\tb\t', 'a\nb,c', '\x1bn,c', "a,b\r\r", 'a,"b\nc"', 'a b\tc', 'a  b', '"a" "b",c', '"",a', 'é,b', 'x' * 121 + ',b', 'x' * 120 + ',b', '--,b', 'a,\x00', "chr1\t1\t2", "chr1\t2\t2", "chr1\t1\t2\t\t", "chr1\t1\t2\tn\x1b\r\t5\t+", "chr1\t1\t2\tn\t65536", "chr1\t1\t2\tn\t00065535\t.", "chr1\t1\t2\tn\t0\tx", "chr1\t09\t10", "chr1\t99999999999999999999\t100000000000000000000", "none\t1\t2", "chr1\t1", "#c", "track x", "chr1\t1\t2" + "\t0" * 2 + "\t+" + "\tq" * 6, "chr1\t1\t2" + "\t0" * 2 + "\t+" + "\tq" * 7, "chr1 1 2", 'chr1\t1\t2\t"q"', None]


def run(rows):
    kinds, nos, lines = map(list, zip(*rows))
    out = R.check_batch(pa.array(lines, pa.string()), pa.array(kinds, pa.string()), pa.array(nos, pa.int64()))
    return dict(zip(R._OUT.names, [c.to_pylist() for c in out]))


def expect(rows):
    return [{True: "row", False: "reject", None: "skip"}[plain(*r)] for r in rows]


def test_cases_of_each_kind():
    rows = [(k, n, line) for line in CASES for k in ("csv", "tsv", "bed", "xml", None) for n in (1, 2, None)]
    got = run(rows)
    assert got["status"] == expect(rows)
    assert all((r is not None) == (s == "reject") for r, s in zip(got["reason"], got["status"]))


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(seed):
    rng = random.Random(seed)
    parts = ['"', '""', ",", " ", "\t", "a", "B1", "NA", "\r", "\n", "\x1b", "é", "5", "12", "+", "chr1", "chr1\t", "3\t", "9\t"]
    rows = [(rng.choice(["csv", "tsv", "bed"]), rng.randint(1, 9), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(4000)]
    assert run(rows)["status"] == expect(rows)


def test_typed_values():
    got = run([("csv", 2, ' "a, ""x""" , b '), ("bed", 1, "chr1\t007\t9\tn\rm\t3\t-\t1\tq")])
    assert got["origin"] == ['a, "x"', None] and got["destination"] == ["b", None]
    assert got["chrom_start"] == [None, 7] and got["name"] == [None, "n\rm"] and got["thick_start"] == [None, 1] and got["thick_end"] == [None, None] and got["item_rgb"] == [None, None]


def test_frame(spark):
    df = spark.createDataFrame([(1, "f", "csv", 2, "a,b", "x"), (2, "f", "csv", 3, "a", "x"), (3, "f", "bed", 1, "chr1\t1\t2", "x")], "line_id long, file_path string, kind string, line_no int, line string, origin string")
    parsed = R.parse_lines(df, keep=["line_id", "file_path"])
    assert [r.line_id for r in R.rejects(parsed).collect()] == [2]
    assert R.rename_rows(parsed).collect()[0].asDict() == {"line_id": 1, "file_path": "f", "origin": "a", "destination": "b"}
    assert R.bed_rows(parsed).collect()[0].chrom_end == 2
    assert R.parse_lines(df.limit(0), keep=["line_id"]).count() == 0
    with pytest.raises(ValueError):
        R.parse_lines(df, keep=["origin"])
