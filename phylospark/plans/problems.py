"""Queries of the general data problems 1, 4 and 5 on the tables of a data folder, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospark.functions.ids import id_key
from phylospark.operators import orphans, rejects
from phylospark.runtime import filesystem
from phylospark.streaming import intervals as interval_stream


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files; it is a folder with files, or one file, which then is picked out of its folder."""
    path = f"{folder}/{name}.parquet"
    fs, p = filesystem(spark, path)
    source = spark.readStream.schema(table(spark, folder, name).schema)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if fs.getFileStatus(p).isFile() else source.parquet(path)


# --- 1: rows that fail to parse


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.parse_lines(table(spark, folder, "raw_lines").withColumnRenamed("kind", "line_kind"), kind="line_kind", keep=["line_id", "file_path", "line_kind", "line_no"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejects(_parsed(spark, folder)).select("line_id")


def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejects(_parsed(spark, folder)).select("line_id", "file_path", "line_kind", "line_no", "reason")


def p1_reject_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).filter("status <> 'skip'").groupBy("line_kind", "reason").agg(F.count("*").alias("n_lines"), F.countDistinct("file_path").alias("n_files"))


def p1_rename_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rename_rows(_parsed(spark, folder)).select("line_id", "file_path", "origin", "destination")


def p1_bed_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.bed_rows(_parsed(spark, folder)).select("line_id", "chrom", "chrom_start", "chrom_end", "name", "score", "strand")


_P1 = r"""
with l as (select line_id, file_path, kind, line_no, regexp_replace(line, '\r$', '') as x from raw_lines),
recs as (select * from l where not coalesce(kind in ('csv', 'tsv') and line_no = 1 and x is not null, false)
  and not coalesce(kind = 'bed' and (starts_with(x, '#') or starts_with(x, 'track') or starts_with(x, 'browser')), false)),
csv0 as (select *, regexp_extract(x, '^[ \t]*("(?:[^"]|"")*"|[^",]*)[ \t]*,[ \t]*("(?:[^"]|"")*"|[^",]*)[ \t]*$', ['a', 'b']) as f,
  regexp_matches(x, '^[ \t]*("(?:[^"]|"")*"|[^",]*)[ \t]*,[ \t]*("(?:[^"]|"")*"|[^",]*)[ \t]*$') as ok from recs where kind = 'csv'),
tsv0 as (select *, regexp_split_to_array(trim(x, E' \t'), '[ \t]+') as f from recs where kind = 'tsv'),
pairs as (
  select line_id, file_path, ok,
    case when starts_with(f.a, '"') then trim(replace(substr(f.a, 2, length(f.a) - 2), '""', '"'), ' ') else trim(f.a, E' \t') end as origin,
    case when starts_with(f.b, '"') then trim(replace(substr(f.b, 2, length(f.b) - 2), '""', '"'), ' ') else trim(f.b, E' \t') end as destination from csv0
  union all
  select line_id, file_path, len(f) = 2 and not contains(x, '"'), f[1], f[2] from tsv0),
pairs_ok as (select *, ok and regexp_matches(origin, '^[\x20-\x7e]{1,120}$') and regexp_matches(origin, '[A-Za-z0-9]') and lower(origin) not in ('na', 'n/a', 'null', 'none')
  and regexp_matches(destination, '^[\x20-\x7e]{1,120}$') and regexp_matches(destination, '[A-Za-z0-9]') and lower(destination) not in ('na', 'n/a', 'null', 'none') as good from pairs),
bed0 as (select *, string_split(x, E'\t') as f from recs where kind = 'bed'),
bed_ok as (select *, len(f) between 3 and 12 and not contains(x, '"') and regexp_matches(f[1], '^[A-Za-z0-9][A-Za-z0-9_.\-]*$') and lower(f[1]) not in ('na', 'n/a', 'null', 'none')
  and regexp_matches(f[2], '^[0-9]+$') and regexp_matches(f[3], '^[0-9]+$') and coalesce(try_cast(f[2] as hugeint) < try_cast(f[3] as hugeint), false)
  and (len(f) < 5 or (regexp_matches(f[5], '^[0-9]+$') and coalesce(try_cast(f[5] as hugeint) <= 65535, false))) and (len(f) < 6 or f[6] in ('+', '-', '.')) as good from bed0)
"""


def _id_reason(name: str) -> str:
    return f"""case when {name} = '' then '{name}: empty' when lower({name}) in ('na', 'n/a', 'null', 'none') then '{name}: word for a missing value'
  when not regexp_matches({name}, '^[\\x20-\\x7e]*$') then '{name}: character outside printable ASCII' when length({name}) > 120 then '{name}: longer than 120 characters'
  when not regexp_matches({name}, '[A-Za-z0-9]') then '{name}: no letter or digit' end"""


_P1R = _P1 + rf""", fields as (select *, case when kind = 'csv' then length(regexp_replace(regexp_replace(x, '"([^"]|"")*"', 'q', 'g'), '[^,]', '', 'g')) + 1
    when kind = 'tsv' then len(regexp_split_to_array(trim(x, E' 	'), '[ 	]+')) else length(regexp_replace(x, '[^	]', '', 'g')) + 1 end as n from recs),
rs as (
  select r.line_id, r.file_path, r.kind as line_kind, r.line_no, case when x is null then 'missing line'
    when kind = 'csv' and not regexp_matches(x, '^[ 	]*("([^"]|"")*"|[^",]*)[ 	]*(,[ 	]*("([^"]|"")*"|[^",]*)[ 	]*)*$') then 'broken quoting'
    when kind = 'tsv' and contains(x, '"') then 'quote in tsv' when n <> 2 then n || ' fields instead of 2' else coalesce({_id_reason("origin")}, {_id_reason("destination")}) end as reason
  from fields r left join pairs p on p.line_id = r.line_id where kind in ('csv', 'tsv')
  union all
  select r.line_id, r.file_path, r.kind, r.line_no, case when r.x is null then 'missing line' when contains(r.x, '"') then 'quote in bed' when n not between 3 and 12 then n || ' fields instead of 3 to 12'
    when not regexp_matches(f[1], '^[A-Za-z0-9][A-Za-z0-9_.\-]*$') then 'chrom: no sequence name' when lower(f[1]) in ('na', 'n/a', 'null', 'none') then 'chrom: word for a missing value'
    when not regexp_matches(f[2], '^[0-9]+$') then 'chrom_start: no number' when not regexp_matches(f[3], '^[0-9]+$') then 'chrom_end: no number'
    when not coalesce(try_cast(f[2] as hugeint) < try_cast(f[3] as hugeint), false) then 'chrom_end: not beyond chrom_start'
    when n >= 5 and not regexp_matches(f[5], '^[0-9]+$') then 'score: no number' when n >= 5 and not coalesce(try_cast(f[5] as hugeint) <= 65535, false) then 'score: above 65535'
    when n >= 6 and f[6] not in ('+', '-', '.') then 'strand: none of + - .' end from fields r join bed0 b on b.line_id = r.line_id where r.kind = 'bed'
  union all select line_id, file_path, kind, line_no, 'unknown kind' from l where kind is null or kind not in ('csv', 'tsv', 'bed'))
"""


# --- 4: references to records that do not exist


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    keyed = lambda name, col, *more: table(spark, folder, name).select(id_key(F.col(col)).alias("id"), *more)
    tables = {
        "taxa": keyed("taxa", "taxon", "registered_at", "deleted_at"),
        "sequences": keyed("sequences", "taxon", "row_id", "loaded_at"),
        "rename_map": keyed("rename_map", "origin", "row_id", "loaded_at"),
        "taxon_records": keyed("taxon_records", "taxon", F.col("record_id").alias("row_id"), "loaded_at"),
    }
    timed = {"at": "loaded_at", "valid_from": "registered_at", "valid_to": "deleted_at"}
    references = [
        orphans.Reference("sequences", "id", "taxa", "id", **timed),
        orphans.Reference("rename_map", "id", "taxa", "id", **timed),
        orphans.Reference("taxon_records", "id", "sequences", "id"),  # a dataset's record of a taxon stands on that taxon's sequences
    ]
    children = ["sequences", "rename_map", "taxon_records"]
    return orphans.orphans(tables, dict.fromkeys(children, "row_id"), references, carry=dict.fromkeys(children, ["loaded_at"]))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cases are what the whole fixpoint finds in the two tables; the records that inherit from them are in p4_orphans."""
    return _orphans(spark, folder).filter(F.col("table_name").isin("sequences", "rename_map")).select("table_name", "row_id")


def p4_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("table_name", "row_id", "kind", "depth")


def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.per_period(_orphans(spark, folder), "loaded_at").withColumn("month", F.date_format("month", "yyyy-MM"))


_KEY = "array_to_string(list_sort(regexp_extract_all(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+')), ' ')"
_P4 = f"""
with reg as (select {_KEY.format("taxon")} as id, registered_at, deleted_at from taxa where taxon is not null),
seqs as (select 'sequences' as table_name, row_id, loaded_at, {_KEY.format("taxon")} as id from sequences where taxon is not null),
maps as (select 'rename_map' as table_name, row_id, loaded_at, {_KEY.format("origin")} as id from rename_map where origin is not null),
direct as (select * from (select * from seqs union all select * from maps) c where not exists (
  select 1 from reg r where r.id = c.id and r.registered_at <= c.loaded_at and (r.deleted_at is null or c.loaded_at < r.deleted_at))),
sound as (select distinct s.id from seqs s where s.row_id not in (select row_id from direct where table_name = 'sequences')),
recs as (select 'taxon_records' as table_name, record_id as row_id, loaded_at, {_KEY.format("taxon")} as id from taxon_records where taxon is not null),
found as (
  select table_name, row_id, loaded_at, 'direct' as kind, 0 as depth from direct union all
  select table_name, row_id, loaded_at, 'direct', 0 from recs where id not in (select id from seqs) union all
  select table_name, row_id, loaded_at, 'inherited', 1 from recs where id in (select id from seqs) and id not in (select id from sound))
"""


# --- 5: overlapping and gapped intervals


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables run as a stream through the interval maps in keyed state."""
    def rows(read: Callable[[str], DataFrame]) -> DataFrame:
        parts = read("partitions").filter("part_start >= 1").select(F.lit("partitions").alias("table_name"), F.col("aln_path").alias("path"), F.lit("").alias("chrom"), F.col("part_start").alias("first"), F.col("part_end").alias("last"))
        beds = read("bed_records").filter("chrom is not null").select(F.lit("bed_records").alias("table_name"), "path", "chrom", F.col("chrom_start").alias("first"), (F.col("chrom_end") - 1).alias("last"))
        return parts.unionByName(beds)

    static = rows(lambda name: table(spark, folder, name))
    found = interval_stream.merged(rows(lambda name: stream(spark, folder, name)), static, ["table_name", "path", "chrom"], "first", "last")
    return found.withColumn("to_pos", F.col("to_pos") + F.when(F.col("table_name") == "bed_records", 1).otherwise(0)).select("table_name", "path", "chrom", "kind", "from_pos", "to_pos")


_P5 = """
with x as (
  select 'partitions' as t, aln_path as path, '' as chrom, part_start as s, part_end + 1 as e from partitions where part_start >= 1 and part_start <= part_end
  union all select 'bed_records', path, chrom, chrom_start, chrom_end from bed_records where chrom is not null and chrom_start < chrom_end),
a as (select *, max(e) over (partition by t, path, chrom order by s, e rows between unbounded preceding and 1 preceding) as reach from x),
b as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by t, path, chrom order by s, e rows unbounded preceding) as n from a),
p as (select t, path, chrom, n, min(s) as s, max(e) as e from b group by all),
g as (select t, path, chrom, e as s, lead(s) over (partition by t, path, chrom order by s) as e from p),
u as (select t, path, chrom, 'period' as kind, s, e from p union all select t, path, chrom, 'gap', s, e from g where e is not null)
select t as table_name, path, chrom, kind, s as from_pos, case when t = 'partitions' then e - 1 else e end as to_pos from u
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_rejects, p1_reject_counts, p1_rename_rows, p1_bed_rows, p4_found, p4_orphans, p4_periods, p5_found)}

SQL: dict[str, str] = {
    "p1_found": _P1 + "select line_id from pairs_ok where not coalesce(good, false) union all select line_id from bed_ok where not coalesce(good, false) union all select line_id from l where kind is null or kind not in ('csv', 'tsv', 'bed')",
    "p1_rejects": _P1R + "select line_id, file_path, line_kind, line_no, reason from rs where reason is not null",
    "p1_reject_counts": _P1R + "select line_kind, reason, count(*) as n_lines, count(distinct file_path) as n_files from rs group by all",
    "p1_rename_rows": _P1 + "select line_id, file_path, origin, destination from pairs_ok where good",
    "p1_bed_rows": _P1 + "select line_id, f[1] as chrom, try_cast(f[2] as bigint) as chrom_start, try_cast(f[3] as bigint) as chrom_end, f[4] as name, try_cast(f[5] as bigint) as score, f[6] as strand from bed_ok where good",
    "p4_found": _P4 + "select table_name, row_id from found where kind = 'direct' and table_name <> 'taxon_records'",
    "p4_orphans": _P4 + "select table_name, row_id, kind, depth from found",
    "p4_periods": _P4 + "select table_name, strftime(loaded_at, '%Y-%m') as month, count(*) filter (kind = 'direct') as direct, count(*) filter (kind = 'inherited') as inherited from found group by all",
    "p5_found": _P5,
}
