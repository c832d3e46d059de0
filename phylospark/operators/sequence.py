"""Operators on the rows of alignments: filters, extraction and removal by id, renaming, translation, addition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phylospark.functions import seqs
from phylospark.runtime import is_small

# --- filters of sequences


def filter_max_gap(aln: DataFrame, percent: float) -> DataFrame:
    """Drop sequences with more gaps than floor(the locus' longest sequence * percent). The lengths are a small table next to the loci."""
    nchar = aln.groupBy("locus").agg(F.max(F.length("seq")).alias("_nchar"))
    return aln.join(nchar, "locus").filter(seqs.missing(F.col("seq")) <= F.floor(F.col("_nchar") * F.lit(float(percent)))).drop("_nchar")


def filter_min_length(aln: DataFrame, n: int) -> DataFrame:
    return aln.filter(F.length(seqs.ungapped(F.col("seq"))) >= n)


def filter_max_length(aln: DataFrame, n: int) -> DataFrame:
    return aln.filter(F.length(seqs.ungapped(F.col("seq"))) <= n)


# --- by id


def parse_ids(text: str) -> list[str]:
    """Ids separated by semicolons, trimmed."""
    return [x.strip() for x in text.split(";") if x.strip()]


def _by_list(aln: DataFrame, ids: list[str] | DataFrame, how: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        ids = ids.select(F.col(ids.columns[0]).alias("taxon")).filter("taxon is not null").distinct()
        return aln.join(F.broadcast(ids) if is_small(ids) else ids, "taxon", how)
    inside = F.col("taxon").isin(sorted(set(ids)))
    return aln.filter(inside if how == "left_semi" else ~inside)


def extract_ids(aln: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """The sequences of these ids, a list or a table's first column."""
    return _by_list(aln, ids, "left_semi")


def extract_regex(aln: DataFrame, pattern: str) -> DataFrame:
    """The sequences whose id has a match anywhere."""
    return aln.filter(F.col("taxon").rlike(pattern))


def remove_ids(aln: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    return _by_list(aln, ids, "left_anti")


def remove_regex(aln: DataFrame, pattern: str) -> DataFrame:
    return aln.filter(~F.col("taxon").rlike(pattern))


# --- renaming

#: In the order in which one wins over the next if several are given.
RENAMES = ["table", "remove", "remove_re", "remove_re_all", "replace", "replace_re", "replace_re_all"]


def new_id(**option) -> Column:
    """The new id by one of: remove=text, remove_re=pattern, remove_re_all=pattern, replace=(text, new), replace_re=(pattern, new), replace_re_all=(pattern, new)."""
    (name, v), = option.items()
    col = F.col("taxon")
    if name == "remove":
        return F.replace(col, F.lit(v), F.lit(""))
    if name == "replace":
        return F.replace(col, F.lit(v[0]), F.lit(v[1]))
    if name.startswith("remove_re"):
        v = (v, "")
    return seqs.replace_regex(col, v[0], v[1], every=name.endswith("_all"))


def rename_by(aln: DataFrame, **option) -> DataFrame:
    """Rename ids by an expression. If two ids of a locus become one, the last sequence wins, in the place of the first."""
    out = aln.withColumn("_old", F.col("taxon")).withColumn("taxon", new_id(**option))
    w = Window.partitionBy("locus", "taxon").orderBy("seq_idx", "_old")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("_n", F.row_number().over(w)).withColumn("seq", F.last("seq").over(whole))
    return out.filter("_n = 1").drop("_n", "_old")


def rename_table(aln: DataFrame, names: DataFrame) -> DataFrame:
    """Rename by a table (origin, destination; of several rows with an origin the first counts, by line_no if there is one, else by destination).

    All names change at once: a new id is not looked up again. If the new id exists in the locus already, that sequence stays. The renamed one is dropped, but keeps its old id if the existing
    sequence is longer. Several ids of a locus with the same new id: the one first in the file takes it, for the others it exists already.
    """
    order = "line_no" if "line_no" in names.columns else "destination"
    first = names.filter("origin is not null and destination is not null").groupBy("origin").agg(F.min_by("destination", order).alias("_new"))
    first = first.filter("origin <> _new")
    first = F.broadcast(first) if is_small(first) else first
    rows = aln.join(first, F.col("taxon") == F.col("origin"), "left").withColumn("_want", F.coalesce("_new", "taxon"))
    # Who holds the wanted id: the row that has it from the start, else the first that gets it.
    w = Window.partitionBy("locus", "_want").orderBy(F.col("_new").isNotNull(), "seq_idx", "taxon").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_holder", F.first(F.struct("seq_idx", F.length("seq").alias("n"), "taxon")).over(w))
    mine = (F.col("_holder.seq_idx") == F.col("seq_idx")) & (F.col("_holder.taxon") == F.col("taxon"))
    keeps_old = ~mine & (F.col("_holder.n") > F.length("seq"))
    return rows.filter(mine | keeps_old).withColumn("taxon", F.when(mine, F.col("_want")).otherwise(F.col("taxon"))).select(*aln.columns)


def dry_run(aln: DataFrame, **option) -> DataFrame:
    """old, new, changed for every id of the alignments."""
    ids = aln.select("taxon").distinct()
    out = ids.select(F.col("taxon").alias("old"), new_id(**option).alias("new"))
    return out.withColumn("changed", F.col("old") != F.col("new"))


def dry_run_table(aln: DataFrame, names: DataFrame) -> DataFrame:
    ids = aln.select(F.col("taxon").alias("old")).distinct()
    order = "line_no" if "line_no" in names.columns else "destination"
    first = names.filter("origin is not null and destination is not null").groupBy("origin").agg(F.min_by("destination", order).alias("_new"))
    out = ids.join(first, F.col("old") == F.col("origin"), "left").select("old", F.coalesce("_new", "old").alias("new"))
    return out.withColumn("changed", F.col("old") != F.col("new"))


# --- translation


def translate(aln: DataFrame, table: int = 1, frame: int = 1) -> DataFrame:
    return aln.withColumn("seq", seqs.translated(F.col("seq"), table, frame))


def auto_frames(aln: DataFrame, table: int = 1) -> DataFrame:
    """locus, frame: the first frame in which the locus' first sequence has no stop codon, null if there is none."""
    first = aln.groupBy("locus").agg(F.min_by("seq", F.struct("seq_idx", "taxon")).alias("seq"))
    frame = F.coalesce(*[F.when(~F.contains(seqs.translated(F.col("seq"), table, f), F.lit("*")), f) for f in (1, 2, 3)])
    return first.select("locus", frame.alias("frame"))


def translate_auto(aln: DataFrame, table: int = 1, strict: bool = True) -> DataFrame:
    """Translate each locus in its frame, with `frame`. A locus without one raises, or is left out if not strict."""
    rows = aln.join(auto_frames(aln, table), "locus")
    if strict:
        rows = rows.withColumn("frame", F.when(F.col("frame").isNull(), F.raise_error(F.concat(F.lit("no reading frame without stop codons: "), F.col("locus")))).otherwise(F.col("frame")))
    return rows.filter("frame is not null").withColumn("seq", seqs.translated(F.col("seq"), table, F.col("frame")))


# --- addition


def add(dest: DataFrame, source: DataFrame, added_only: bool = False) -> DataFrame:
    """The destination's loci with the sequences of the source's locus of the same name whose ids they lack, `is_added`.

    Loci that get any are un-gapped as a whole, the others stay as they are, or are left out if added_only.
    """
    new = source.join(dest.select("locus").distinct(), "locus", "left_semi").join(dest.select("locus", "taxon"), ["locus", "taxon"], "left_anti")
    grown = new.select("locus").distinct()
    last = dest.groupBy("locus").agg((F.max("seq_idx") + 1).alias("_from"))
    cols = ["locus", "seq_idx", "taxon", "seq"]
    new = new.join(last, "locus").withColumn("seq_idx", F.col("seq_idx") + F.col("_from")).select(*cols, F.lit(True).alias("is_added"))
    old = dest.select(*cols, F.lit(False).alias("is_added"))
    changed = old.join(grown, "locus", "left_semi").unionByName(new).withColumn("seq", seqs.ungapped(F.col("seq")))
    return changed if added_only else changed.unionByName(old.join(grown, "locus", "left_anti"))


def add_single(source: DataFrame, id_by_locus: bool = False) -> DataFrame:
    """All sequences in one file, the first of each id by locus (natural order) and position; un-gapped. id_by_locus: ids get the locus' name as a prefix."""
    rows = source.withColumn("taxon", F.concat("locus", F.lit("_"), "taxon")) if id_by_locus else source
    first = rows.groupBy("taxon").agg(F.min_by("seq", F.struct(seqs.natural_key(F.col("locus")), "locus", "seq_idx")).alias("seq"))
    return first.withColumn("seq", seqs.ungapped(F.col("seq")))


def add_counters(dest: DataFrame, source: DataFrame) -> DataFrame:
    """One row: the source's sequences in loci that the destination has, how many were added and skipped, their lengths and means; loci
    with additions, and the destination's loci that the source lacks."""
    loci = dest.select("locus").distinct()
    matched = source.join(loci, "locus", "left_semi").select("locus", "taxon", F.length("seq").cast("bigint").alias("n"))
    known = dest.select("locus", "taxon", F.lit(True).alias("_known"))
    rows = matched.join(known, ["locus", "taxon"], "left").withColumn("added", F.col("_known").isNull())
    sums = rows.agg(
        F.count("*").alias("total_count"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_length"),
        F.count_if("added").alias("added_count"), F.count_if(~F.col("added")).alias("skipped_count"), F.coalesce(F.sum(F.when(F.col("added"), F.col("n"))), F.lit(0).cast("bigint")).alias("added_length"),
        F.countDistinct(F.when(F.col("added"), F.col("locus"))).alias("added_loci"),
    )
    skipped = loci.join(source.select("locus").distinct(), "locus", "left_anti").agg(F.count("*").alias("skipped_loci"))
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    both = sums.crossJoin(F.broadcast(skipped))  # one row and one row
    return both.withColumns({"mean_length": d("total_length", "total_count"), "mean_added": d("added_count", "total_count"), "mean_added_length": d("added_length", "added_count")})
