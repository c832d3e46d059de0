"""Occurrences and record counts of every term, kept up to date by signed deltas.

The state is a folder with two kinds of runs, tables of signed counts that add up to the state:
  pairs: field, term, record, n_rows, occurrences - only for terms counted by distinct records
  terms: field, term, occurrences, records
A batch of changes is summed up by (field, term, record), which is a new run of pairs. The pairs of the older runs that it touches tell
which pairs appear or vanish, hence the change of each term's number of records: a new run of terms. The older runs are read, but neither shuffled
nor written again: a filter of fixed size holds back what the batch does not touch. Each run is partitioned by the hash of all of its keys, so that a
term with any share of the records is spread. When a run has at least half as many rows as the one before, the two become one; so there are few runs
(the logarithm of the number of rows) and a row is written again as often at most.

A manifest names the runs. A new one is written under a new number, by renaming, after all runs are there: a batch is applied as a whole or not
at all, and one that failed is applied again. What the last two manifests do not name is deleted.

A change is a row: field, term, record, occurrences, sign (+1 added, -1 deleted; a changed record is both). A null record means
that each row is a record of its own. The empty term '' with a field of TOTAL + name counts the records of a field as a whole.

Defined results: null terms are left out (but count in the field's total); '' is a term like others; terms compare byte for
byte; repeated rows count each; a term whose rows are all deleted is gone; empty batches change nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.operators.bitmaps import may_hold
from phylospark.runtime import BROADCAST_ROWS, delete, names_in, read_text, write_new

TOTAL = "\u0000total:"
KEYS = ["field", "term", "record"]
PAIRS = "field string, term string, record string, n_rows bigint, occurrences bigint"
TERMS = "field string, term string, occurrences bigint, records bigint"
#: A run is merged with the one before that has less than so many times its rows.
GROWTH = 2


def changes(df: DataFrame, field: str, term: Column, record: Column | None = None, occurrences: Column | None = None, sign: int = 1) -> DataFrame:
    """The changes of a field by the rows of df, each with one term. record None: each row is a record."""
    one = F.lit(1).cast("bigint")
    base = df.select(term.cast("string").alias("term"), (F.lit(None) if record is None else record).cast("string").alias("record"), (one if occurrences is None else occurrences.cast("bigint")).alias("occurrences"))
    return base.filter("term is not null").select(F.lit(field).alias("field"), "term", "record", "occurrences", F.lit(sign).alias("sign"))


def totals(df: DataFrame, field: str, record: Column | None = None, sign: int = 1) -> DataFrame:
    """The changes of the number of all records of a field. Null records are none, if records are named."""
    rows = df.select((F.lit(None) if record is None else record).cast("string").alias("record"))
    if record is not None:
        rows = rows.filter("record is not null")
    return rows.select(F.lit(TOTAL + field).alias("field"), F.lit("").alias("term"), "record", F.lit(1).cast("bigint").alias("occurrences"), F.lit(sign).alias("sign"))


class TermCounts:
    """The persistent counts in a folder; see the module's docstring. One writer at a time: a second one fails when it writes its manifest."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        known = [n for n in names_in(spark, path) if re.fullmatch(r"manifest-\d{12}\.json", n)]
        self.state = json.loads(read_text(spark, f"{path}/{known[-1]}")) if known else {"version": 0, "batch": None, "pairs": [], "terms": []}

    def _run(self, kind: str, run: dict) -> DataFrame:
        return self.spark.read.schema(PAIRS if kind == "pairs" else TERMS).parquet(f"{self.path}/{kind}/{run['run']}")

    def _runs(self, kind: str, runs: list[dict]) -> DataFrame | None:
        return reduce(DataFrame.unionByName, [self._run(kind, r) for r in runs]) if runs else None

    def _write(self, kind: str, df: DataFrame) -> dict:
        """A new run. Its files are the partitions of the aggregation by its keys."""
        run = {"run": uuid.uuid4().hex}
        df.write.parquet(f"{self.path}/{kind}/{run['run']}")
        return run | {"rows": self._run(kind, run).count()}

    def _compacted(self, kind: str, runs: list[dict]) -> list[dict]:
        """The runs, after merging as many of the last ones as the sizes ask for."""
        n, rows = 1, runs[-1]["rows"]
        while n < len(runs) and runs[-n - 1]["rows"] < GROWTH * rows:
            n += 1
            rows += runs[-n]["rows"]
        if n == 1:
            return runs
        keys, counts = (KEYS, ["n_rows", "occurrences"]) if kind == "pairs" else (KEYS[:2], ["occurrences", "records"])
        summed = self._runs(kind, runs[-n:]).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
        return [*runs[:-n], self._write(kind, summed.filter(" or ".join(f"{c} <> 0" for c in counts)))]

    def _touched(self, older: list[dict], delta: DataFrame, rows: int) -> DataFrame:
        """The pairs of older runs that the batch may touch: a filter of fixed size keeps the others out of the shuffle, if there are many."""
        old = self._runs("pairs", older)
        if rows > sum(r["rows"] for r in older):
            return old
        if rows <= BROADCAST_ROWS:
            return old.join(F.broadcast(delta.select(*KEYS)), KEYS, "left_semi")
        return old.filter(may_hold(delta.select(F.xxhash64(*KEYS).alias("h")), "h")(F.xxhash64(*KEYS)))

    def apply(self, batch: DataFrame, number: int | None = None) -> bool:
        """Merge a batch of changes into the counts. number: of the batch, rising; one that was applied before is left out, so that a batch may be
        sent again when it is not known whether it got through. Returns whether it was applied now."""
        state = self.state
        if number is not None and state["batch"] is not None and number <= state["batch"]:
            return False
        summed = batch.groupBy(*KEYS).agg(F.sum("sign").alias("n_rows"), F.sum(F.col("sign") * F.col("occurrences")).alias("occurrences"))
        run = self._write("pairs", summed.filter("n_rows <> 0 or occurrences <> 0"))
        if not run["rows"]:
            delete(self.spark, f"{self.path}/pairs/{run['run']}")
            return False
        every = self._run("pairs", run)
        named = every.filter("record is not null")
        zero = F.lit(0).cast("bigint")
        both = named.select(*KEYS, zero.alias("o_rows"), F.col("n_rows").alias("d_rows"), F.col("occurrences").alias("d_occ"))
        if state["pairs"]:
            old = self._touched(state["pairs"], named, run["rows"]).select(*KEYS, F.col("n_rows").alias("o_rows"), zero.alias("d_rows"), zero.alias("d_occ"))
            both = both.unionByName(old).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("o_rows", "d_rows", "d_occ")]).filter("d_rows <> 0 or d_occ <> 0")
        # Signed counts: a pair is there while rows hold it. 'step' is the change of its term's number of records.
        step = F.when(F.col("o_rows") + F.col("d_rows") > 0, 1).otherwise(0) - F.when(F.col("o_rows") > 0, 1).otherwise(0)
        moved = both.select("field", "term", F.col("d_occ").alias("occurrences"), step.cast("bigint").alias("records"))
        moved = moved.unionByName(every.filter("record is null").select("field", "term", "occurrences", F.col("n_rows").alias("records")))
        moved = moved.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        terms = self._write("terms", moved.filter("occurrences <> 0 or records <> 0"))
        new = {"version": state["version"] + 1, "batch": state["batch"] if number is None else number}
        new |= {kind: self._compacted(kind, [*state[kind], one]) for kind, one in (("pairs", run), ("terms", terms))}
        write_new(self.spark, f"{self.path}/manifest-{new['version']:012d}.json", json.dumps(new))
        self.state = new
        self._sweep(state)
        return True

    def _sweep(self, before: dict) -> None:
        """Delete the manifests before the last two, and the runs that these two do not name; frames of the last version but one can still be read."""
        for name in names_in(self.spark, self.path):
            m = re.fullmatch(r"manifest-(\d{12})\.json", name)
            if m and int(m[1]) < before["version"] or name.endswith(".part"):
                delete(self.spark, f"{self.path}/{name}")
        for kind in ("pairs", "terms"):
            named = {r["run"] for s in (before, self.state) for r in s[kind]}
            for run in names_in(self.spark, f"{self.path}/{kind}"):
                if run not in named:
                    delete(self.spark, f"{self.path}/{kind}/{run}")

    def _terms(self) -> DataFrame:
        runs = self._runs("terms", self.state["terms"])
        if runs is None:
            return self.spark.createDataFrame([], TERMS)
        if len(self.state["terms"]) > 1:
            runs = runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return runs.filter("records > 0")

    def counts(self) -> DataFrame:
        """field, term, occurrences, records."""
        return self._terms().filter(~F.startswith("field", F.lit(TOTAL)))

    def marked(self, rare: dict[str, int], common: dict[str, tuple[int, int]]) -> DataFrame:
        """The counts with total_records of the field and mark: 'rare' with at most rare[field] records, else 'common' when
        records / total_records > a / b for common[field] = (a, b), else null."""
        total = self._terms().filter(F.startswith("field", F.lit(TOTAL))).select(F.expr(f"substring(field, {len(TOTAL) + 1})").alias("_field"), F.col("records").alias("total_records"))
        total = F.broadcast(total)  # one row for each field
        df = self.counts().join(total, F.col("field") == F.col("_field"), "left").drop("_field")
        mark = F.lit(None).cast("string")
        for field in sorted({*rare, *common}):
            here = F.col("field") == field
            if field in common:
                a, b = common[field]
                mark = F.when(here & (F.col("records") * b > F.col("total_records") * a), "common").otherwise(mark)
            if field in rare:
                mark = F.when(here & (F.col("records") <= rare[field]), "rare").otherwise(mark)
        return df.withColumn("mark", mark)
