"""Queries for O1 to O10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import oplog as ops
from ..operators import sessions
from ..sources.fixtures import frame, oracle, with_ms
from .registry import Query
from .sessions import _TRANS

_Q = "partition by vault_id, user_id order by ms, seq"
_DRAIN = f"""fl as (select *, type in ('rename', 'move') and coalesce(new_path, '') = '' as fails from fx_ops),
  dq as (select *, case when f = 0 then 'applied' when fails and f = 1 then 'failed' else 'left' end as outcome from (select *, sum(cast(fails as integer)) over ({_Q} rows unbounded preceding) as f from fl) q)"""
_ROUTE = f"""{_TRANS}, ro as (select o.vault_id, o.user_id, o.ms, o.seq, case when t.status = 'connected' then 'direct' else 'queued' end as route, 1 as n
  from fx_ops o asof left join (select client_id, ms, arg_max(status, event_id) as status from tr group by all) t on o.user_id = t.client_id and o.ms >= t.ms)"""


def log(spark, d):
    return with_ms(frame(spark, d, "fx_ops"))


def changes(spark, d):
    return sessions.status_transitions(with_ms(frame(spark, d, "fx_status")))


def routed(spark, d):
    return ops.route_ops(log(spark, d), changes(spark, d)).select("vault_id", "user_id", "ms", "seq", "route", "n")


def depth(spark, d, split=False):
    r = routed(spark, d)
    return ops.queue_depth(r.unionByName(ops.drains(r, changes(spark, d))), split)


def twice(spark, d):
    """Operations of which some arrive again later."""
    return again(log(spark, d))


def again(rows):
    return rows.unionByName(rows.filter("id % 7 = 0").withColumns({"ms": F.col("ms") + 1000, "seq": F.col("seq") + 1}))


#: Each operation with its route, the next return of a queued one's client, and its outcome in the queue of the drained ones.
OFFLINE = f"""{_ROUTE}, ri as (select ro.*, o.id, o.type, o.new_path from ro join fx_ops o using (vault_id, user_id, seq)),
  qu as (select q.*, t.ms as at_ms, q.type in ('rename', 'move') and coalesce(q.new_path, '') = '' as fails from (select * from ri where route = 'queued') q
    asof join (select client_id, ms from tr where status = 'connected' group by all) t on q.user_id = t.client_id and q.ms < t.ms),
  dq as (select *, sum(cast(fails as integer)) over ({_Q} rows unbounded preceding) as f from qu)
  select vault_id, user_id, id, ms, route, case when f = 0 then 'applied' when fails and f = 1 then 'failed' else 'left' end as outcome, at_ms from dq
  union all select vault_id, user_id, id, ms, route, 'applied', ms from ri where route = 'direct'"""

#: The whole of O3 as one recursion by queue over its files and folders. Defines ``rp``.
REPLAY = f"""nu as (select *, row_number() over ({_Q}) as rn from fx_ops),
  rep as (
    select vault_id, user_id, cast(0 as bigint) as rn, cast([] as struct(p varchar, t varchar, o varchar, h bigint)[]) as files, cast([] as varchar[]) as folders, false as blocked from nu group by all
    union all
    select vault_id, user_id, rn,
      case when blocked or fails then files
        when type in ('rename', 'move') and f is not null then list_append(list_filter(files, lambda x: x.p <> path), struct_pack(p := new_path, t := f.t, o := f.o, h := f.h + 1))
        when type = 'create' and f is null and not is_folder then list_append(files, struct_pack(p := path, t := coalesce(content, ''), o := path, h := cast(0 as bigint)))
        when type in ('delete', 'deleteFolder') and f is not null then list_filter(files, lambda x: x.p <> path)
        when type = 'deleteFolder' and is_folder then list_filter(files, lambda x: not starts_with(x.p, path || '/')) else files end,
      case when blocked or fails then folders when type = 'createFolder' and f is null and not is_folder then list_append(folders, path)
        when type = 'deleteFolder' and f is null and is_folder then list_filter(folders, lambda x: x <> path and not starts_with(x, path || '/')) else folders end,
      blocked or fails
    from (select *, type in ('rename', 'move') and (coalesce(new_path, '') = '' or f is not null and new_path <> path and (list_contains(folders, new_path) or len(list_filter(files, lambda x: x.p = new_path)) > 0)) as fails
      from (select r.vault_id, r.user_id, r.files, r.folders, r.blocked, n.rn, n.type, n.path, n.new_path, n.content, list_filter(r.files, lambda x: x.p = n.path)[1] as f, list_contains(r.folders, n.path) as is_folder
        from rep r join nu n on n.vault_id = r.vault_id and n.user_id = r.user_id and n.rn = r.rn + 1) q1) q2),
  ed as (select * from rep qualify rn = max(rn) over (partition by vault_id, user_id)),
  rp as (select vault_id, user_id, x.p as path, x.t as text, x.o as first_path, x.h as hops, blocked from (select vault_id, user_id, blocked, unnest(files) as x from ed) u)"""

DEPTH = oracle(f"""with {_ROUTE}, dr as (select q.vault_id, q.user_id, t.ms, t.event_id as seq, 'drain' as route, count(*) as n from (select * from ro where route = 'queued') q
        asof join (select * from tr where status = 'connected') t on q.user_id = t.client_id and q.ms < t.ms group by all), u as (select * from ro union all select * from dr)
      select vault_id, user_id, ms, seq, route, cast(sum(case route when 'queued' then 1 when 'drain' then -n else 0 end) over (partition by vault_id order by ms, seq, user_id, route rows unbounded preceding) as bigint) as depth from u""", "fx_status", "fx_ops")

QUERIES = {
    "offline_drain": Query(lambda spark, d: ops.offline_drain(twice(spark, d), changes(spark, d)), oracle(f"with {OFFLINE}", "fx_status", "fx_ops")),
    "order_queue": Query(lambda spark, d: ops.order_queue(log(spark, d)).select("vault_id", "user_id", "id", "nth"), oracle(f"select vault_id, user_id, id, cast(row_number() over ({_Q}) as integer) as nth from fx_ops", "fx_ops")),
    "drain_queue": Query(lambda spark, d: ops.drain_queue(log(spark, d)).select("id", "outcome"), oracle(f"with {_DRAIN} select id, outcome from dq", "fx_ops")),
    "replay_ops": Query(lambda spark, d: ops.replay_ops(log(spark, d)), oracle(f"with {REPLAY} select vault_id, user_id, path, text, first_path, hops, blocked from rp", "fx_ops", recursive=True)),
    "replay_fast": Query(lambda spark, d: ops.replay_fast(log(spark, d)), oracle("""with e as (select *, sum(cast(type = 'delete' as integer)) over (partition by vault_id, user_id, path order by ms, seq rows unbounded preceding) as epoch from fx_ops where type in ('create', 'delete')),
      l as (select *, max(epoch) over (partition by vault_id, user_id, path) as last from e), c as (select *, row_number() over (partition by vault_id, user_id, path order by ms, seq) as nth from l where type = 'create' and epoch = last)
      select vault_id, user_id, path, content as text from c where nth = 1""", "fx_ops")),
    "rename_chains": Query(lambda spark, d: ops.rename_chains(ops.file_moves(log(spark, d))), oracle(f"with {REPLAY} select vault_id, user_id, first_path, path as final_path, hops from rp where hops > 0", "fx_ops", recursive=True)),
    "queue_depth": Query(depth, DEPTH),
    "queue_depth_split": Query(lambda spark, d: depth(spark, d, split=True), DEPTH),
    "route_ops": Query(lambda spark, d: routed(spark, d).drop("n"), oracle(f"with {_ROUTE} select vault_id, user_id, ms, seq, route from ro", "fx_status", "fx_ops")),
    "drain_summary": Query(lambda spark, d: ops.drain_summary(ops.drain_queue(log(spark, d))), oracle(f"with {_DRAIN} select vault_id, type, count(*) filter (outcome = 'applied') as applied, count(*) filter (outcome <> 'applied') as remaining, arg_min(id, struct_pack(ms, seq)) filter (outcome = 'failed') as first_blocker from dq group by rollup(vault_id, type)", "fx_ops")),
    "dedupe_ops": Query(lambda spark, d: ops.dedupe_ops(twice(spark, d)), oracle("select id, ms, seq, type, path from fx_ops", "fx_ops")),
    "clear_queue": Query(lambda spark, d: ops.clear_queue(log(spark, d), log(spark, d).select("vault_id").distinct().filter("vault_id like '%3' or vault_id like '%8'")).select("id", "vault_id"), oracle("select id, vault_id from fx_ops where vault_id not like '%3' and vault_id not like '%8'", "fx_ops")),
}
