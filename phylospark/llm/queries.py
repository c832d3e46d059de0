"""Queries of the problems 2, 3, 6, 7, 8 and 9 on the tables of a data folder, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.llm import copies, mixing, packing, quantiles, terms, truncation
from phylospark.llm.tokens import token_count
from phylospark.runtime import materialize, scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 2: frequency of every distinct term

RARE = {"taxon": 1, "symbol": 3}
COMMON = {"taxon": (1, 10), "symbol": (9, 10)}


def _term_changes(sequences: DataFrame, records: DataFrame, sign: int = 1) -> DataFrame:
    """The changes by rows of both tables that are added (or, with sign -1, deleted)."""
    symbols = records.select(F.explode("char_counts").alias("symbol", "n")).filter("n > 0")
    return reduce(
        DataFrame.unionByName,
        [
            terms.changes(sequences, "taxon", F.col("taxon"), record=F.col("locus"), sign=sign),
            terms.totals(sequences, "taxon", record=F.col("locus"), sign=sign),
            terms.changes(symbols, "symbol", F.col("symbol"), occurrences=F.col("n"), sign=sign),
            terms.totals(records.filter("char_counts is not null"), "symbol", sign=sign),
        ],
    )


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    """The counts after two batches: all rows but those loaded in the last month, then these."""
    sequences = table(spark, folder, "sequences").select("taxon", "locus", "loaded_at")
    records = table(spark, folder, "taxon_records").select("char_counts", "loaded_at")
    last = sequences.agg(F.max("loaded_at").alias("t")).unionByName(records.agg(F.max("loaded_at").alias("t"))).agg(F.date_trunc("month", F.max("t"))).first()[0]
    late = F.coalesce(F.col("loaded_at") >= F.lit(last), F.lit(True))
    store = terms.TermCounts(spark, scratch_path(spark, "terms"))
    store.apply(_term_changes(sequences.filter(~late), records.filter(~late)), 0)
    store.apply(_term_changes(sequences.filter(late), records.filter(late)), 1)
    return store.marked(RARE, COMMON)


def _corrected(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of all rows, then with two corrections as signed deltas: the rows loaded in the last month are deleted, and of the other
    sequences those whose id rename_map has as an origin change it to the destination (the first by row_id)."""
    sequences = table(spark, folder, "sequences").select("taxon", "locus", "loaded_at")
    records = table(spark, folder, "taxon_records").select("char_counts", "loaded_at")
    store = terms.TermCounts(spark, scratch_path(spark, "terms"))
    store.apply(_term_changes(sequences, records), 0)
    last = sequences.agg(F.date_trunc("month", F.max("loaded_at"))).first()[0]
    late = F.coalesce(F.col("loaded_at") >= F.lit(last), F.lit(False))
    store.apply(_term_changes(sequences.filter(late), records.filter(late), sign=-1), 1)
    names = table(spark, folder, "rename_map").filter("origin is not null and destination is not null").groupBy(F.col("origin").alias("taxon")).agg(F.min_by("destination", "row_id").alias("new"))
    moved = sequences.filter(~late).join(names, "taxon")
    changed = [terms.changes(moved, "taxon", F.col(c), record=F.col("locus"), sign=n) for c, n in (("taxon", -1), ("new", 1))]
    store.apply(changed[0].unionByName(changed[1]), 2)
    return store.marked(RARE, COMMON)


def p2_corrected(spark: SparkSession, folder: str) -> DataFrame:
    return _corrected(spark, folder).select("field", "term", "occurrences", "records", "mark")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).filter("mark is not null").select("field", "term", "mark")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).select("field", "term", "occurrences", "records", "mark")


_P2 = """
with t as (select 'taxon' as field, taxon as term, count(*) as occurrences, count(distinct locus) as records, (select count(distinct locus) from sequences) as total from sequences where taxon is not null group by taxon),
e as (select record_id, unnest(map_entries(char_counts)) as kv from taxon_records where char_counts is not null),
s as (select 'symbol' as field, kv.key as term, cast(sum(kv.value) as bigint) as occurrences, count(*) as records, (select count(*) from taxon_records where char_counts is not null) as total from e where kv.value > 0 group by kv.key),
c as (select field, term, occurrences, records, case when records = 1 then 'rare' when 10 * records > total then 'common' end as mark from t where records > 0
  union all select field, term, occurrences, records, case when records <= 3 then 'rare' when 10 * records > 9 * total then 'common' end from s)
"""


_P2C = """
with m as (select date_trunc('month', max(loaded_at)) as last from sequences),
nm as (select origin, arg_min(destination, row_id) as new from rename_map where origin is not null and destination is not null group by origin),
q as (select locus, coalesce(nm.new, taxon) as taxon from sequences left join nm on taxon = origin where loaded_at is null or loaded_at < (select last from m)),
r as (select record_id, char_counts from taxon_records where char_counts is not null and (loaded_at is null or loaded_at < (select last from m))),
t as (select 'taxon' as field, taxon as term, count(*) as occurrences, count(distinct locus) as records, (select count(distinct locus) from q) as total from q where taxon is not null group by taxon),
e as (select record_id, unnest(map_entries(char_counts)) as kv from r),
s as (select 'symbol' as field, kv.key as term, cast(sum(kv.value) as bigint) as occurrences, count(*) as records, (select count(*) from r) as total from e where kv.value > 0 group by kv.key)
select field, term, occurrences, records, case when records = 1 then 'rare' when 10 * records > total then 'common' end as mark from t where records > 0
union all select field, term, occurrences, records, case when records <= 3 then 'rare' when 10 * records > 9 * total then 'common' end from s
"""


# --- 3: percentiles of large numeric columns

PER_MILLE = [50, 250, 500, 750, 900, 950, 990]
#: Bins of mean read lengths: an error of at most 0.005 bases. The other two columns are whole numbers and stay exact.
MEAN_LENGTH_WIDTH = 0.01


def _day_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Value counts of the three columns by group and day; these are what is kept and combined."""
    def counts(name: str, group: str, at: str, value: str, width: float | None) -> DataFrame:
        rows = table(spark, folder, name).select(F.lit(name).alias("table_name"), F.col(group).alias("group_key"), F.to_date(at).alias("day"), F.col(value).alias("v"))
        return quantiles.value_counts(rows, ["table_name", "group_key", "day"], "v", width)

    return reduce(
        DataFrame.unionByName,
        [
            counts("reads", "platform", "sequenced_at", "len", None),
            counts("read_summary", "platform", "submitted_at", "mean_read_len", MEAN_LENGTH_WIDTH),
            counts("contig_summary", "assembler", "submitted_at", "contig_count", None),
        ],
    )


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Per day, and per month and over all days from the same daily counts."""
    days = materialize(_day_counts(spark, folder), "days")
    keys = ["table_name", "group_key", "value"]
    months = days.groupBy(*keys, F.trunc("day", "month").alias("day")).agg(F.sum("n").alias("n"))
    every = days.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("day", F.lit(None).cast("date"))
    spans = [(days, "day"), (months, "month"), (every, "all")]
    counts = reduce(DataFrame.unionByName, [d.select("table_name", "group_key", F.lit(s).alias("span"), F.col("day").alias("span_start"), "value", "n") for d, s in spans])
    found = quantiles.percentiles(counts, PER_MILLE)
    return found.select("table_name", "group_key", "span", F.date_format("span_start", "yyyy-MM-dd").alias("span_start"), "n_values", "per_mille", "value")


_P3 = f"""
with v as (
  select 'reads' as table_name, platform as group_key, cast(sequenced_at as date) as day, cast(len as double) as value from reads where len is not null
  union all select 'read_summary', platform, cast(submitted_at as date), (floor(mean_read_len * 100.0::double) + 0.5::double) / 100.0::double from read_summary where mean_read_len is not null and not isnan(mean_read_len)
  union all select 'contig_summary', assembler, cast(submitted_at as date), cast(contig_count as double) from contig_summary where contig_count is not null),
s as (select table_name, group_key, 'day' as span, day as span_start, value from v
  union all select table_name, group_key, 'month', cast(date_trunc('month', day) as date), value from v
  union all select table_name, group_key, 'all', null, value from v),
r as (select *, row_number() over (partition by table_name, group_key, span, span_start order by value) as k, count(*) over (partition by table_name, group_key, span, span_start) as n_values from s)
select table_name, group_key, span, strftime(span_start, '%Y-%m-%d') as span_start, n_values, cast(p as bigint) as per_mille, value
from r, unnest([{", ".join(map(str, PER_MILLE))}]) as u(p) where k = greatest(1, (n_values * p + 999) // 1000)
"""


# --- 6: duplicates hidden by formatting

RECORDS = {"sequences": {"locus": "exact", "taxon": "words", "seq": "fold"}, "rename_map": {"origin": "words", "destination": "words"}}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [copies.copies(table(spark, folder, name), "row_id", fields).select(F.lit(name).alias("table_name"), "first_id", "copy_id") for name, fields in RECORDS.items()]
    return reduce(DataFrame.unionByName, found)


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = [copies.groups(table(spark, folder, name), "row_id", fields).select(F.lit(name).alias("table_name"), "first_id", "n_copies") for name, fields in RECORDS.items()]
    return reduce(DataFrame.unionByName, found)


_KEY = "array_to_string(list_sort(regexp_extract_all(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+')), ' ')"
_P6 = f"""
with k as (
  select 'sequences' as table_name, row_id, locus as a, {_KEY.format("taxon")} as b, lower(seq) as c from sequences where locus is not null and taxon is not null and seq is not null
  union all select 'rename_map', row_id, {_KEY.format("origin")}, {_KEY.format("destination")}, '' from rename_map where origin is not null and destination is not null),
g as (select *, min(row_id) over (partition by table_name, a, b, c) as first_id, count(*) over (partition by table_name, a, b, c) as n from k)
"""


# --- 7: filling containers


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their size in tokens, written once; null texts are none."""
    docs = table(spark, folder, "documents").filter("text is not null").select("doc_id", "source", "text")
    return materialize(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")), "tokens")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    """A packing for each row of pack_sizes, a table of settings, each over all documents."""
    sizes = table(spark, folder, "pack_sizes").filter("pack_name is not null and capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().orderBy("pack_name", "capacity_tokens")
    packed = packing.pack_all(_sized(spark, folder), "doc_id", "tokens", ((r.pack_name, r.capacity_tokens) for r in sizes.toLocalIterator()))
    return packed.select("pack_name", "capacity", "container_id", F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    by = _packed(spark, folder).groupBy("pack_name", "capacity", "container_id").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("used"))
    return by.withColumn("fill", F.col("used") / F.col("capacity"))


def p7_summary(spark: SparkSession, folder: str) -> DataFrame:
    by = p7_fill(spark, folder).groupBy("pack_name", "capacity").agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used").alias("used"), F.min("fill").alias("min_fill"))
    return by.withColumn("fill", F.col("used") / (F.col("capacity") * F.col("n_containers")))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold, by pack: all documents with a text are placed, no token is lost, no container has more than its capacity, no document that fits is split."""
    sized = _sized(spark, folder)
    sizes = table(spark, folder, "pack_sizes").select("pack_name", "capacity_tokens").distinct()
    packed = packing.pack_all(sized, "doc_id", "tokens", ((r.pack_name, r.capacity_tokens) for r in sizes.toLocalIterator()))
    packed = materialize(packed, "packed")
    keys = ["pack_name", "capacity"]
    over = packed.groupBy(*keys, "container_id").agg(F.sum("size").alias("used")).groupBy(*keys).agg(F.count_if(F.col("used") > F.col("capacity")).alias("over_capacity"))
    docs = packed.groupBy(*keys, "item").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens")).groupBy(*keys).agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("split_though_fit"), F.sum("tokens").alias("_placed"))
    total = sized.agg(F.sum("tokens").alias("_all"))  # one row
    return docs.join(over, keys).crossJoin(F.broadcast(total)).select(*keys, "n_docs", "over_capacity", "split_though_fit", (F.col("_all") - F.col("_placed")).alias("tokens_lost"))


# --- 8: mixing sources


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sized(spark, folder), "doc_id", "source", "tokens", table(spark, folder, "mix_targets"))


def p8_draws(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0].withColumnRenamed("record", "doc_id").withColumnRenamed("size", "tokens")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold, by target: no record is used more often than allowed, and the source misses its budget by half of its longest record at most."""
    sized = _sized(spark, folder)
    draws, report = mixing.mix(sized, "doc_id", "source", "tokens", table(spark, folder, "mix_targets"))
    longest = sized.groupBy(F.col("source").alias("_source")).agg(F.max("tokens").alias("_longest"))
    missed = F.abs(F.col("drawn") - F.col("budget")) > F.coalesce("_longest", F.lit(0)) / 2.0 + 1e-6
    found = report.join(longest, F.col("source") == F.col("_source"), "left")
    return found.select("mix_name", "source", "target_share", (F.col("max_uses") > F.col("max_repeats")).alias("overused"), missed.alias("missed"))


# --- 9: texts that were cut off


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.scores(table(spark, folder, "documents"), "doc_id", "text", "lang", "source")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).filter("cut").select(F.col("key").alias("doc_id"))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).withColumnRenamed("key", "doc_id")


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut values per source. Null and blank texts count as values that are not cut."""
    every = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n_values"))
    cut = _cut(spark, folder).filter("cut").groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n_cut"))
    joined = every.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "n_values", F.coalesce("n_cut", F.lit(0).cast("bigint")).alias("n_cut"))
    return joined.withColumn("cut_share", F.col("n_cut") / F.col("n_values"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_counts, p2_corrected, p3_percentiles, p6_found, p6_groups, p7_containers, p7_fill, p7_summary, p7_check, p8_draws, p8_shares, p8_check, p9_found, p9_scores, p9_sources)}

SQL: dict[str, str] = {
    "p2_found": _P2 + "select field, term, mark from c where mark is not null",
    "p2_counts": _P2 + "select field, term, occurrences, records, mark from c",
    "p2_corrected": _P2C,
    "p3_percentiles": _P3,
    "p7_check": "select pack_name, capacity_tokens as capacity, (select count(*) from documents where text is not null) as n_docs, 0 as over_capacity, 0 as split_though_fit, 0 as tokens_lost from pack_sizes group by all",
    "p8_check": "select mix_name, source, target_share, false as overused, false as missed from mix_targets where mix_name is not null and source is not null",
    "p6_found": _P6 + "select table_name, first_id, row_id as copy_id from g where row_id <> first_id",
    "p6_groups": _P6 + "select table_name, first_id, n as n_copies from g where row_id = first_id",
}
