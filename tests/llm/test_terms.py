import random

import pytest
from pyspark.sql import functions as F

from phylospark.llm.terms import TermCounts, changes, totals


def state(store):
    return {(r.field, r.term): (r.occurrences, r.records) for r in store.counts().collect()}


def plain(rows):
    out = {}
    for rec, term, n in rows:
        if term is not None:
            out.setdefault(("f", term), []).append((rec, n))
    return {k: (sum(n for _, n in v), len({r for r, _ in v if r is not None})) for k, v in out.items()}


def test_batches_against_recount(spark, tmp_path):
    """Added, changed and deleted rows, batch by batch; null and empty terms; a term of a third of all rows."""
    rng = random.Random(5)
    store = TermCounts(spark, str(tmp_path / "s"))
    live = []
    for batch in range(4):
        gone = rng.sample(live, len(live) // 3)
        for r in gone:
            live.remove(r)
        new = [(f"r{rng.randint(0, 12)}", rng.choice(["hot", "hot", "a", "b", "", None, f"t{rng.randint(0, 30)}"]), rng.randint(1, 3)) for _ in range(60)]
        live += new
        ddl = "rec string, term string, n long"
        old_df, new_df = spark.createDataFrame(gone, ddl), spark.createDataFrame(new, ddl)
        part = lambda d, s: changes(d, "f", F.col("term"), F.col("rec"), F.col("n"), s).unionByName(totals(d, "f", F.col("rec"), s))
        store.apply(part(new_df, 1).unionByName(part(old_df, -1)))
        store = TermCounts(spark, str(tmp_path / "s"))  # from the folder
        assert state(store) == plain(live)
    marks = {r.term: (r.mark, r.total_records) for r in store.marked({"f": 1}, {"f": (1, 2)}).collect()}
    n = len({r for r, _, _ in live})
    assert all(t == n for _, t in marks.values())
    assert {k: m for k, (m, _) in marks.items()} == {t: "rare" if c == 1 else "common" if 2 * c > n else None for (_, t), (_, c) in plain(live).items()}


def test_rows_as_records_and_empty(spark, tmp_path):
    store = TermCounts(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("a", 5), ("a", 1), ("b", 2), (None, 3)], "term string, n long")
    store.apply(changes(df.limit(0), "f", F.col("term")))
    assert state(store) == {}
    store.apply(changes(df, "f", F.col("term"), occurrences=F.col("n")).unionByName(totals(df, "f")))
    assert state(store) == {("f", "a"): (6, 2), ("f", "b"): (2, 1)}
    store.apply(changes(df.filter("term = 'b'"), "f", F.col("term"), occurrences=F.col("n"), sign=-1))
    assert state(store) == {("f", "a"): (6, 2)}


def runs(path):
    return {k: sorted(p.name for p in (path / k).iterdir()) for k in ("pairs", "terms")}


def test_failed_batch_is_applied_again(spark, tmp_path):
    """A batch that fails between its pairs and its terms changes nothing, and is applied later, by the same store and by a new one."""
    df = spark.createDataFrame([(f"r{i % 7}", f"t{i % 5}") for i in range(60)], "rec string, term string")
    batch = changes(df, "f", F.col("term"), F.col("rec"))
    for name, again in (("same", lambda s: s), ("new", lambda s: TermCounts(spark, s.path))):
        store = TermCounts(spark, str(tmp_path / name))
        store.apply(batch, 0)
        before = state(store)
        write = store._write

        def failing(kind, frame, write=write):
            if kind == "terms":
                raise OSError("lost")
            return write(kind, frame)

        store._write = failing
        with pytest.raises(OSError):
            store.apply(batch, 1)
        store._write = write
        assert state(store) == before
        store = again(store)
        assert store.apply(batch, 1) and not store.apply(batch, 1)  # sent again: left out
        assert state(store) == {k: (2 * n, r) for k, (n, r) in before.items()} == state(TermCounts(spark, str(tmp_path / name)))


def test_small_batch_leaves_the_state(spark, tmp_path):
    """A small batch writes small runs; the large ones stay the same files. What no manifest names is deleted."""
    df = spark.range(5000).select((F.col("id") % 900).cast("string").alias("rec"), (F.col("id") % 1300).cast("string").alias("term"))
    store = TermCounts(spark, str(tmp_path / "s"))
    store.apply(changes(df, "f", F.col("term"), F.col("rec")))
    large = store.state["pairs"][0]
    few = spark.createDataFrame([("r1", "new"), ("0", "0"), ("r2", "0")], "rec string, term string")
    for k in range(4):
        store.apply(changes(few, "f", F.col("term"), F.col("rec"), sign=1 if k % 2 == 0 else -1))
        assert store.state["pairs"][0] == large and sum(r["rows"] for r in store.state["pairs"][1:]) <= 6
    assert ("f", "new") not in state(store) and len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("manifest")]) == 2
    assert all(len(v) <= 6 for v in runs(tmp_path / "s").values())
    assert state(store)["f", "0"] == state(TermCounts(spark, store.path))["f", "0"]
