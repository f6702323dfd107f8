"""Queries for R1 to R12. Thresholds are days where production has seconds, as the log is sparse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as ops
from ..sources.fixtures import frame, oracle, with_ms
from .registry import Query

LONG = 5 * 24 * 3600_000
_RECENT = "x as (select max(ms) as a from fx_recent), rec as (select vault_id, replica, op, path, max(ms) as ms from fx_recent group by all)"
_TIMES = _RECENT + """, tm as (select vault_id, path, max(ms) filter (op = 'create') as create_ms, max(ms) filter (op = 'delete') as delete_ms, max(ms) filter (op = 'rename') as rename_ms from rec where replica = 'local' group by all)"""
_DIFF = "df as (select vault_id, path, case when bool_or(replica = 'local') and bool_or(replica = 'remote') then 'common' when bool_or(replica = 'local') then 'local_only' else 'remote_only' end as side from fx_inventory group by all)"
_FOLD = "fo as (select vault_id, replica, array_to_string(p[1:n], '/') as folder, count(*) as files from (select vault_id, replica, string_split(path, '/') as p, unnest(range(1, len(string_split(path, '/')))) as n from fx_inventory) q group by all)"


def inventory(spark, d):
    return frame(spark, d, "fx_inventory")


def recent(spark, d):
    log = with_ms(frame(spark, d, "fx_recent"))
    return ops.recent_ops(log, log.agg(F.max("ms")).scalar())


def as_of(spark, d):
    return with_ms(frame(spark, d, "fx_recent")).agg(F.max("ms")).scalar()


def moves(spark, d):
    """Every third source joins the next one; each ninth asks to join itself."""
    n = F.regexp_extract("vault_id", "[0-9]+", 0).cast("int")
    vaults = inventory(spark, d).select("vault_id").distinct().filter(n % 3 == 0)
    return vaults.select("vault_id", F.when(n % 9 == 0, F.col("vault_id")).otherwise(F.concat(F.lit("src"), n + 1)).alias("into"))


def structural(spark, d):
    return ops.structural_conflicts(inventory(spark, d), recent(spark, d), as_of(spark, d), LONG)


def renamed(spark, d):
    """Recent operations whose renames name a new path: that of the file seven numbers on."""
    n = (F.regexp_extract("path", "/([0-9]+)[.]md$", 1).cast("long") + 7) % 1000
    log = with_ms(frame(spark, d, "fx_recent")).withColumn("new_path", F.concat(F.regexp_extract("path", "^(.*/)", 1), n.cast("string"), F.lit(".md")))
    return ops.recent_ops(log, log.agg(F.max("ms")).scalar(), "new")


STRUCTURAL = f"""with {_DIFF}, {_TIMES}, j as (select df.*, coalesce(a - delete_ms < {LONG}, false) as deleted, coalesce(a - create_ms < {LONG}, false) as created from df left join tm using (vault_id, path), x where side <> 'common')
      select vault_id, path, side, case when side = 'remote_only' then case when deleted then 'conflict' else 'create' end when created then 'push' else 'conflict' end as outcome,
      case when side = 'remote_only' and deleted then 'keepRemote' when side = 'local_only' and not created then 'keepLocal' end as suggested from j"""
_MOVED = "case when op = 'rename' then regexp_extract(path, '^(.*/)', 1) || ((cast(regexp_extract(path, '/([0-9]+)[.]md$', 1) as bigint) + 7) % 1000) || '.md' else path end"

QUERIES = {
    "periodic_reconcile_renamed": Query(lambda spark, d: ops.periodic_reconcile(inventory(spark, d), renamed(spark, d), as_of(spark, d), LONG), oracle(f"""with {_DIFF}, {_TIMES.replace("select vault_id, replica, op, path, max(ms)", f"select vault_id, replica, op, {_MOVED} as path, max(ms)")}
      select vault_id, path, case when a - (case when side = 'local_only' then coalesce(create_ms, rename_ms, 0) else coalesce(delete_ms, 0) end) > {LONG} then case side when 'local_only' then 'push' else 'pull' end else 'suppressed' end as action
      from df left join tm using (vault_id, path), x where side <> 'common'""", "fx_inventory", "fx_recent")),
    "inventory_diff": Query(lambda spark, d: ops.inventory_diff(inventory(spark, d)), oracle(f"with {_DIFF} select * from df", "fx_inventory")),
    "sync_plan": Query(lambda spark, d: ops.sync_plan(inventory(spark, d)), oracle(f"with {_DIFF} select vault_id, path, case side when 'local_only' then 'push' else 'pull' end as action, case when side = 'remote_only' then '' end as text from df where side <> 'common'", "fx_inventory")),
    "sync_summary": Query(lambda spark, d: ops.sync_summary(inventory(spark, d)), oracle(f"with {_DIFF} select vault_id, count(*) filter (side = 'local_only') as pushed, count(*) filter (side = 'remote_only') as pulled, greatest(count(*) filter (side <> 'remote_only'), count(*) filter (side <> 'local_only')) as notice from df group by 1", "fx_inventory")),
    "structural_conflicts": Query(structural, oracle(STRUCTURAL, "fx_inventory", "fx_recent")),
    "periodic_reconcile": Query(lambda spark, d: ops.periodic_reconcile(inventory(spark, d), recent(spark, d), as_of(spark, d), LONG), oracle(f"""with {_DIFF}, {_TIMES}
      select vault_id, path, case when a - (case when side = 'local_only' then coalesce(create_ms, rename_ms, 0) else coalesce(delete_ms, 0) end) > {LONG} then case side when 'local_only' then 'push' else 'pull' end else 'suppressed' end as action
      from df left join tm using (vault_id, path), x where side <> 'common'""", "fx_inventory", "fx_recent")),
    "apply_remote_inserts": Query(lambda spark, d: ops.apply_remote_inserts(inventory(spark, d), recent(spark, d), as_of(spark, d), LONG), oracle(f"""with {_FOLD}, {_TIMES}, b as (select vault_id, replica, path, false as is_folder from fx_inventory union all select vault_id, replica, folder, true from fo),
      s as (select distinct vault_id, path, is_folder from b r where replica = 'remote' and not exists (select 1 from b l where l.replica = 'local' and l.vault_id = r.vault_id and l.path = r.path))
      select vault_id, path, is_folder from s left join tm using (vault_id, path), x where create_ms is null or a - create_ms > {LONG}""", "fx_inventory", "fx_recent")),
    "reconcile_deletes": Query(lambda spark, d: ops.reconcile_deletes(inventory(spark, d), recent(spark, d), as_of(spark, d), LONG), oracle(f"""with {_FOLD}, {_TIMES}, b as (select vault_id, replica, path, false as is_folder from fx_inventory union all select vault_id, replica, folder, true from fo),
      g as (select * from b where replica = 'local' and not exists (select 1 from fx_inventory r where r.replica = 'remote' and r.vault_id = b.vault_id and r.path = b.path))
      select g.vault_id, g.path, is_folder, is_folder and exists (select 1 from fo where replica = 'remote' and fo.vault_id = g.vault_id and fo.folder = g.path) as has_live_children
      from g left join tm on g.vault_id = tm.vault_id and g.path = tm.path, x where delete_ms is null or a - delete_ms > {LONG}""", "fx_inventory", "fx_recent")),
    "inventory_from_events": Query(lambda spark, d: ops.inventory_from_events(with_ms(frame(spark, d, "fx_ops"))), oracle("""with c as (select vault_id, path, 0 as add, ms, seq, 0 as nth from fx_ops where type = 'rename' and new_path is not null union all select vault_id, new_path, 1, ms, seq, 1 from fx_ops where type = 'rename' and new_path is not null
      union all select vault_id, path, case when type in ('create', 'createFolder') then 1 else 0 end, ms, seq, 0 from fx_ops where type in ('create', 'createFolder', 'delete', 'deleteFolder'))
      select vault_id, path from (select *, row_number() over (partition by vault_id, path order by ms desc, seq desc, nth desc) as k from c) q where k = 1 and add = 1""", "fx_ops")),
    "join_vault": Query(lambda spark, d: ops.join_vault(inventory(spark, d), moves(spark, d)), oracle("""with n as (select distinct vault_id, cast(regexp_extract(vault_id, '[0-9]+') as integer) as k from fx_inventory), mv as (select vault_id, 'src' || (k + 1) as target from n where k % 3 = 0 and k % 9 <> 0),
      p as (select distinct coalesce(target, i.vault_id) as vault_id, path from fx_inventory i left join mv on i.vault_id = mv.vault_id), h as (select target as vault_id, list(vault_id order by vault_id) as history from mv group by 1)
      select vault_id, count(*) as files, any_value(history) as history from p left join h using (vault_id) group by 1""", "fx_inventory")),
    "joined_inventory": Query(lambda spark, d: ops.joined_inventory(inventory(spark, d), moves(spark, d)), oracle("""with n as (select distinct vault_id, cast(regexp_extract(vault_id, '[0-9]+') as integer) as k from fx_inventory), mv as (select vault_id, 'src' || (k + 1) as target from n where k % 3 = 0 and k % 9 <> 0)
      select distinct coalesce(target, i.vault_id) as vault_id, replica, path from fx_inventory i left join mv on i.vault_id = mv.vault_id""", "fx_inventory")),
    "folder_rollup": Query(lambda spark, d: ops.folder_rollup(inventory(spark, d)), oracle(f"with {_FOLD} select * from fo", "fx_inventory")),
    "replica_convergence": Query(lambda spark, d: ops.replica_convergence(inventory(spark, d)), oracle("""with r as (select distinct vault_id, replica from fx_inventory), p as (select distinct vault_id, path from fx_inventory)
      select vault_id, path, list(replica order by replica) as missing from p join r using (vault_id) where not exists (select 1 from fx_inventory i where i.vault_id = p.vault_id and i.path = p.path and i.replica = r.replica) group by all""", "fx_inventory")),
    "recent_ops": Query(recent, oracle(f"with {_RECENT} select * from rec", "fx_recent")),
}
