import datetime as dt
import random

from phylospark.functions.ids import id_key
from phylospark.operators.orphans import Reference, orphans, per_period, without_parent
from phylospark.plans import problems
from pyspark.sql import functions as F


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_valid_periods(spark):
    """Against all pairs, with the parent sent to all and with the salted shuffle."""
    rng = random.Random(1)
    parents = [(rng.choice("abcdef"), day(a := rng.choice([None, *range(40)])), day(rng.choice([None, (a or 0) + rng.randint(-2, 12)]))) for _ in range(40)] + [(None, day(1), None)]
    children = [(i, rng.choice(["a"] * 5 + [*"bcdefgh", None]), day(rng.choice([None, *range(60)])), "x") for i in range(400)]
    p = spark.createDataFrame(parents, "k string, f timestamp, t timestamp")
    c = spark.createDataFrame(children, "row_id long, ref string, at timestamp, k string").drop("k")
    want = {i for i, ref, at, _ in children if ref is not None and not any(k == ref and f is not None and at is not None and f <= at and (t is None or at < t) for k, f, t in parents)}
    for limit, hot in ((1000, 1000), (1, 1000), (1, 30)):  # sent to all; shuffled; shuffled with the hot key spread
        got = [r.row_id for r in without_parent(c, "ref", p, "k", "at", "f", "t", broadcast_rows=limit, hot_rows=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert without_parent(c, "ref", p.limit(0), "k", "at", "f", "t").count() == sum(r[1] is not None for r in children)
    assert without_parent(c.limit(0), "ref", p, "k", "at", "f", "t").count() == 0


def test_cascade(spark):
    """A tree in one table, below another: depth by depth, and a key that a sound row still holds."""
    top = spark.createDataFrame([("A",), ("B",)], "name string")
    node = [(1, "n1", None, "A"), (2, "n2", "n1", "gone"), (3, "n3", "n2", "A"), (4, "n4", "n3", "A"), (5, "n2", None, "B"), (6, "n6", None, "gone"), (7, "n7", "n6", None), (8, "n8", "n7", "A"), (9, "n9", "nowhere", "A"), (10, "n10", "n9", "A"), (11, None, "n9", "B")]
    t = {"top": top, "node": spark.createDataFrame(node, "id long, name string, up string, top string")}
    refs = [Reference("node", "top", "top", "name"), Reference("node", "up", "node", "name")]
    want = {(2, "direct", 0), (6, "direct", 0), (9, "direct", 0), (7, "inherited", 1), (8, "inherited", 2), (10, "inherited", 1), (11, "inherited", 1)}
    for limit, hot in ((1000, 1000), (0, 1)):
        got = {(r.row_id, r.kind, r.depth) for r in orphans(t, {"node": "id", "top": "id"}, refs, broadcast_rows=limit, hot_rows=hot).collect()}
        assert got == want
    assert {r.row_id for r in orphans(t, {"node": "id", "top": "id"}, refs, inherited=False).collect()} == {2, 6, 9}



def test_deep_chain(spark):
    """A table that refers to itself, deeper than any fixed number of rounds; a ring of rows that refer to each other is sound."""
    n = 103
    rows = [(i, f"n{i}", f"n{i - 1}") for i in range(n)] + [(1000, "r0", "r1"), (1001, "r1", "r0")]
    t = {"node": spark.createDataFrame(rows, "id long, name string, up string").coalesce(1)}
    got = {(r.row_id, r.kind, r.depth) for r in orphans(t, {"node": "id"}, [Reference("node", "up", "node", "name")]).collect()}
    assert got == {(0, "direct", 0)} | {(i, "inherited", i) for i in range(1, n)}


def test_report(spark):
    child = spark.createDataFrame([(1, "x", day(0)), (2, "x", day(40)), (3, "y", None)], "row_id long, ref string, at timestamp")
    parent = spark.createDataFrame([("z",)], "k string")
    found = orphans({"c": child, "p": parent}, {"c": "row_id"}, [Reference("c", "ref", "p", "k")], carry={"c": ["at"]})
    assert {(r.table_name, r.month, r.direct, r.inherited) for r in per_period(found, "at").collect()} == {("c", day(0), 1, 0), ("c", day(31), 1, 0), ("c", None, 1, 0)}


def test_id_key(spark):
    rows = [("Aus bus", "BUS_aus"), ("a a b", "a b"), ("", "--"), ("Ka", "a"), ("É1", "1"), ("a1", "a 1"), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.same for r in df.select((id_key(F.col("a")) == id_key(F.col("b"))).alias("same")).collect()]
    assert got == [True, False, True, True, True, False, None]


def test_query_runs_the_whole_fixpoint(spark, tmp_path, monkeypatch):
    """p4_found's rows come out of the fixpoint over the whole graph; rows that are repeated in the tables stay, as in SQL."""
    tables = {
        "taxa": ([("Aus bus", day(0), day(10)), ("Cus", day(0), None)], "taxon string, registered_at timestamp, deleted_at timestamp"),
        "sequences": ([(1, "bus_aus", day(5)), (2, "Aus bus", day(20)), (3, "Dus", day(1)), (3, "Dus", day(1)), (4, None, day(1)), (5, "Cus", None)], "row_id long, taxon string, loaded_at timestamp"),
        "rename_map": ([(1, "cus", day(3)), (2, "Eus", day(3)), (2, "Eus", day(3))], "row_id long, origin string, loaded_at timestamp"),
        "taxon_records": ([(1, "Dus", day(2)), (1, "Dus", day(2)), (2, "Aus bus", day(2)), (3, "Fus", day(2)), (4, "Cus", day(2))], "record_id long, taxon string, loaded_at timestamp"),
    }
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    whole = []

    def spy(*args, **kwargs):
        whole.append(orphans(*args, **kwargs))
        return whole[-1]

    monkeypatch.setattr(problems.orphans, "orphans", spy)
    got = sorted(map(tuple, problems.p4_found(spark, str(tmp_path)).collect()))
    assert got == [("rename_map", 2), ("rename_map", 2), ("sequences", 2), ("sequences", 3), ("sequences", 3), ("sequences", 5)]
    (found,) = whole
    records = [("taxon_records", 1, "inherited", 1)] * 2 + [("taxon_records", 3, "direct", 0), ("taxon_records", 4, "inherited", 1)]
    assert sorted((r.table_name, r.row_id, r.kind, r.depth) for r in found.collect()) == [(*x, "direct", 0) for x in got] + records
