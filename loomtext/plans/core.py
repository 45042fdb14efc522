"""Core queries for data-quality problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.intervals import merge_intervals
from loomtext.operators.references import apply_changes, current_orphans, orphan_references, orphan_report
from loomtext.operators.windows import latest
from loomtext.session import table
from loomtext.sources.tables import read


def _targets(spark: SparkSession, d: str) -> dict:
    return {
        "passages": ("passage_id", read(spark, d, "passages", "passage_id", "created_at", "deleted_at"), "passage_id"),
        "library_components": (
            "component_id", read(spark, d, "library_components", "component_id", "created_at", "deleted_at"), "component_id"),
        "library_blocks": ("block_id", read(spark, d, "library_blocks", "block_id", "created_at", "deleted_at"), "block_id"),
    }


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "passage_mappings", "fragment_id", "passage_id", "component_id", "block_id", "selected_at")
    return orphan_references(refs, "fragment_id", "selected_at", _targets(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p4_found(spark, d))


def p4_current(spark: SparkSession, d: str) -> DataFrame:
    """Orphans now: a state of signed counts maintained over two batches of change deltas.

    The batches are cut at the middle of the selection times.  The second one holds the deletions since
    then, and takes back the references of fragments that were delivered again.
    """
    refs = latest(read(spark, d, "passage_mappings", "fragment_id", "passage_id", "component_id", "block_id", "selected_at", "received_at"),
                  "fragment_id", "received_at", ["passage_id", "component_id", "block_id", "selected_at"])
    lo, hi = refs.agg(F.min("selected_at"), F.max("selected_at")).first()
    cut = F.lit(lo + (hi - lo) / 2 if lo else None).cast("timestamp")
    targets = _targets(spark, d)
    name = F.inline(F.array(*[F.struct(F.lit(t).alias("ref_table"), F.col(c).alias("ref_key")) for t, (c, _, _) in targets.items()]))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    cols = ["ref_table", "ref_key", "n_refs", "n_rows"]
    empty = spark.createDataFrame([], "ref_table string, ref_key string, n_refs bigint, n_rows bigint")

    def batch(late: bool) -> DataFrame:
        new = F.coalesce(F.col("selected_at") >= cut, F.lit(False))
        out = refs.where(new if late else ~new).select(name).select("ref_table", "ref_key", one.alias("n_refs"), zero.alias("n_rows"))
        for t, (_, f, k) in targets.items():
            f = f.distinct().where("created_at is not null").select(F.lit(t).alias("ref_table"), F.col(k).alias("ref_key"), "created_at", "deleted_at")
            made, gone = F.coalesce(F.col("created_at") >= cut, F.lit(False)), F.coalesce(F.col("deleted_at") >= cut, F.lit(False))
            ended = F.col("deleted_at").isNotNull()
            n = F.when(made if late else ~made, 1).otherwise(0) - F.when(ended & (gone if late else ~gone), 1).otherwise(0)
            out = out.unionByName(f.select("ref_table", "ref_key", zero.alias("n_refs"), n.cast("bigint").alias("n_rows")))
        return out.select(*cols)

    state = table(apply_changes(empty, batch(False)), "orphan-state")
    return current_orphans(apply_changes(state, batch(True)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(read(spark, d, "text_selections", "block_id", "start_pos", "end_pos"), "block_id", "start_pos", "end_pos")


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_current": p4_current, "p6_found": p6_found}

_ORPHANS = """
with refs as (
  select distinct fragment_id, selected_at, 'passages' as ref_table, passage_id as ref_key from passage_mappings where passage_id is not null
  union all select distinct fragment_id, selected_at, 'library_components', component_id from passage_mappings where component_id is not null
  union all select distinct fragment_id, selected_at, 'library_blocks', block_id from passage_mappings where block_id is not null),
targets as (
  select 'passages' as ref_table, passage_id as ref_key, created_at, deleted_at from passages
  union all select 'library_components', component_id, created_at, deleted_at from library_components
  union all select 'library_blocks', block_id, created_at, deleted_at from library_blocks),
found as (
  select fragment_id, ref_table, strftime(selected_at, '%Y-%m') as period,
    case when not exists (select 1 from targets t where t.ref_table = r.ref_table and t.ref_key = r.ref_key) then 'missing'
         when exists (select 1 from targets t where t.ref_table = r.ref_table and t.ref_key = r.ref_key and t.created_at <= r.selected_at) then 'deleted'
         else 'late' end as reason
  from refs r
  where not exists (select 1 from targets t where t.ref_table = r.ref_table and t.ref_key = r.ref_key
                    and t.created_at <= r.selected_at and (t.deleted_at is null or t.deleted_at > r.selected_at)))
"""

SQL = {
    "p4_found": _ORPHANS + "select distinct fragment_id, ref_table, period, reason from found",
    "p4_report": _ORPHANS + "select ref_table, period, reason, count(*) as n_refs from (select distinct * from found) group by all",
    "p4_current": """
with refs as (select distinct fragment_id, passage_id, component_id, block_id from passage_mappings),
r as (select 'passages' as ref_table, passage_id as ref_key from refs union all select 'library_components', component_id from refs
      union all select 'library_blocks', block_id from refs),
t as (select 'passages' as ref_table, passage_id as ref_key from passages where created_at is not null and deleted_at is null
      union all select 'library_components', component_id from library_components where created_at is not null and deleted_at is null
      union all select 'library_blocks', block_id from library_blocks where created_at is not null and deleted_at is null)
select ref_table, ref_key, count(*) as n_refs from r where ref_key is not null
  and not exists (select 1 from t where t.ref_table = r.ref_table and t.ref_key = r.ref_key) group by all""",
    "p6_found": """
with s as (select block_id, start_pos, max(end_pos) as end_pos from text_selections
           where block_id is not null and start_pos < end_pos group by all),
p as (select *, max(end_pos) over (partition by block_id order by start_pos rows between unbounded preceding and 1 preceding) as prev from s),
i as (select *, sum(case when prev is null or start_pos > prev then 1 else 0 end) over (partition by block_id order by start_pos) as island from p),
c as (select block_id, island, min(start_pos) as a, max(end_pos) as b from i group by all)
select block_id, 'covered' as span_kind, cast(a as bigint) as start_pos, cast(b as bigint) as end_pos from c
union all
select block_id, 'gap', cast(b as bigint), cast(n as bigint) from (select block_id, b, lead(a) over (partition by block_id order by a) as n from c) where n is not null""",
}
