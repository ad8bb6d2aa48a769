"""Queries and SQL of the general operators: incremental runs and broken references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import incremental, references
from shelfspark.util import fresh_dir, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.replay_runs(table(spark, sf, "files"), table(spark, sf, "sync_runs"), table(spark, sf, "scan_entries"), fresh_dir(spark, "p1"))


def p1_changes_per_run(spark: SparkSession, sf: str) -> DataFrame:
    return p1_found(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_changed"))


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    refs = references.library_references(t("chunks"), t("messages"))
    return references.broken_references(refs, references.library_intervals(t("files"), t("sessions"), t("deletions")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _broken(spark, sf).select("table_name", "row_id", "kind").distinct()


def p2_orphans_per_month(spark: SparkSession, sf: str) -> DataFrame:
    return references.per_month(_broken(spark, sf))


QUERIES = {"p1_found": p1_found, "p1_changes_per_run": p1_changes_per_run, "p2_found": p2_found, "p2_orphans_per_month": p2_orphans_per_month}

_BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{200B}\x{FEFF}]"

_P1 = """
with last_entry as (
  select run_id, path_key, size, mtime from scan_entries where path_key is not null
  qualify row_number() over (partition by run_id, path_key order by seen_at desc nulls last, entry_id desc nulls last, size desc nulls last, mtime desc nulls last) = 1),
done as (select run_id, row_number() over (order by run_id) as k from (select distinct run_id from sync_runs where state = 'done' and run_id is not null)),
seen as (
  select d.k, d.run_id, e.path_key, e.size, e.mtime from last_entry e join done d using (run_id) where e.size is not null and e.mtime is not null
  union all
  select 0, null, path_key, size, mtime from (select path_key, size, mtime from files where path_key is not null
  qualify row_number() over (partition by path_key order by indexed_at desc nulls last, size desc nulls last, mtime desc nulls last) = 1)),
found as (
  select s.run_id, s.path_key from seen s left join seen o on o.k = s.k - 1 and o.path_key = s.path_key
  where s.k > 0 and not coalesce(o.size = s.size and abs(o.mtime - s.mtime) <= 0.001, false))
"""

_P2 = f"""
with b as (select 'chunks' as table_name, chunk_id as row_id, cast(file_id as varchar) as ref_key, written_at as at from chunks
  union all select 'messages', id, lower(regexp_replace(session_id, '^{_BLANK}+|{_BLANK}+$', '', 'g')), created_at from messages),
p as (select 'chunks' as table_name, cast(file_id as varchar) as ref_key, min(indexed_at) as since from files where file_id is not null group by all
  union all select 'messages', lower(regexp_replace(session_id, '^{_BLANK}+|{_BLANK}+$', '', 'g')) as k, min(created_at) from sessions where session_id is not null group by k),
d as (select distinct case lower(table_name) when 'files' then 'chunks' when 'sessions' then 'messages' end as table_name,
  case lower(table_name) when 'files' then cast(try_cast(regexp_replace(row_key, '^{_BLANK}+|{_BLANK}+$', '', 'g') as bigint) as varchar) else lower(regexp_replace(row_key, '^{_BLANK}+|{_BLANK}+$', '', 'g')) end as ref_key from deletions),
found as (
  select distinct b.table_name, b.row_id, b.at, case when p.ref_key is null and d.ref_key is not null then 'deleted' when p.ref_key is null then 'missing' when p.since > b.at then 'late' end as kind
  from b left join p on p.table_name = b.table_name and p.ref_key = b.ref_key left join d on d.table_name = b.table_name and d.ref_key = b.ref_key where b.ref_key is not null)
"""

ORACLE = {
    "p1_found": _P1 + "select run_id, path_key from found",
    "p1_changes_per_run": _P1 + "select run_id, count(*) as n_changed from found group by run_id",
    "p2_found": _P2 + "select distinct table_name, row_id, kind from found where kind is not null",
    "p2_orphans_per_month": _P2 + "select table_name, strftime(\"at\", '%Y-%m') as month, kind, count(*) as n from found where kind is not null group by all",
}
