"""Queries for P1 to P16."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as ops
from ..sources.fixtures import frame, oracle, with_ms
from ..sources.scratch import written
from .admission import _MESSAGES, SESSIONS, budget, log
from .registry import Query

QUIET = 3600_000
#: The moment between two presence snapshots: 15 days into the log.
MIDDLE = 1705276800000


def found(spark, d):
    return ops.sessions(log(spark, d), budget(spark, d))


def as_of(spark, d):
    return log(spark, d).agg(F.max("ms")).scalar()


def roster(spark, d):
    return ops.vault_roster(log(spark, d), with_ms(frame(spark, d, "fx_members")))


def vaults(spark, d):
    return ops.vault_activity(roster(spark, d), found(spark, d), as_of(spark, d))


def totals(spark, d):
    """All from one fold of the message budget, which is written once."""
    spent = written(budget(spark, d), "budget")
    sessions = written(ops.sessions(log(spark, d), spent), "sessions")
    return ops.server_totals(log(spark, d), sessions, ops.vault_activity(roster(spark, d), sessions, as_of(spark, d)), spent)


def access(spark, d):
    wanted = log(spark, d).select("vault_id", "user_id").filter("user_id <> ''").distinct()
    held = roster(spark, d).select("vault_id", F.explode("permissions").alias("user_id", "permission"))
    return ops.access_check(wanted, held)


def presence(spark, d):
    return with_ms(frame(spark, d, "fx_presence"))


def delta(spark, d):
    rows = presence(spark, d)
    return ops.presence_delta(ops.presence_latest(rows.filter(F.col("ms") < MIDDLE)), ops.presence_latest(rows))


def status(spark, d):
    return with_ms(frame(spark, d, "fx_status"))


_ROSTER = """j as (select vault_id, case when coalesce(user_id, '') = '' then 'anonymous' else user_id end as user_id, ms, event_id from fx_conn where kind = 'connect' and regexp_full_match(vault_id, '[A-Za-z0-9_-]{1,128}')),
  first as (select vault_id, arg_min(user_id, event_id) as owner, min(ms) as created_ms from j group by 1),
  gr as (select vault_id, owner as user_id, 'admin' as permission, -1 as event_id from first union all select m.vault_id, m.user_id, m.permission, m.event_id from fx_members m),
  held as (select vault_id, user_id, arg_max(permission, event_id) as permission from gr group by all),
  ros as (select f.vault_id, owner, created_ms, member_count, permissions from first f join (select vault_id, count(*) as member_count, map_from_entries(list(struct_pack(k := user_id, v := permission) order by user_id)) as permissions from held group by 1) h on f.vault_id = h.vault_id)"""
_ACT = "act as (select r.vault_id, owner, member_count, coalesce(n, 0) as active_sessions, coalesce(n, 0) > 0 as is_active from ros r left join (select vault_id, count(*) filter ((select max(ms) from fx_conn) - last_ms < 300000) as n from ses where is_open group by 1) s on r.vault_id = s.vault_id)"
_LATEST = "(select * from (select *, row_number() over (partition by client_id order by ms desc, seq desc) as nth from {src}) q where nth = 1 and not is_null)"
_GAUGE = """g as (select ip, vault_id, ms, event_id, kind, connection_id, user_id, case kind when 'connect' then 1 when 'disconnect' then -1 end as change from fx_conn where kind in ('connect', 'disconnect')),
  t as (select ip, ms, event_id, sum(change) over (partition by ip order by ms, event_id rows unbounded preceding) as total from g),
  o as (select ip, ms, event_id, cast(total - least(0, min(total) over (partition by ip order by ms, event_id rows unbounded preceding)) as bigint) as open from t)"""
_TRANS = """k as (select *, lag(status) over (partition by client_id order by ms, event_id) as before from fx_status where status in ('connected', 'disconnected', 'connecting')),
  tr as (select client_id, ms, event_id, before, status, case when status = 'connected' then 'sync' when before = 'connected' then 'queue' end as starts from k where before is distinct from status)"""

QUERIES = {
    "sessions": Query(found, oracle(f"with {_MESSAGES}, {SESSIONS} select * from ses", "fx_conn", recursive=True)),
    "active_sessions": Query(lambda spark, d: ops.active_sessions(found(spark, d), as_of(spark, d)), oracle(f"with {_MESSAGES}, {SESSIONS}, x as (select max(ms) as a from fx_conn) select connection_id, vault_id, user_id, last_ms, a - last_ms as idle_ms, a - last_ms < 30000 as is_active from ses, x where is_open", "fx_conn", recursive=True)),
    "vault_activity": Query(vaults, oracle(f"with {_MESSAGES}, {SESSIONS}, {_ROSTER}, {_ACT} select * from act", "fx_conn", "fx_members", recursive=True)),
    "server_totals": Query(totals, oracle(f"""with {_MESSAGES}, {SESSIONS}, {_ROSTER}, {_ACT}
      select (select count(*) from fx_conn where kind = 'connect') as total_connections, (select count(*) from ses where is_open) as current_connections, (select count(*) from act) as total_vaults, (select count(*) from act where is_active) as active_vaults,
      (select count(*) from bud where not allowed) as rate_limit_hits, (select count(*) from bud join m using (event_id) where allowed and direction = 'out') as messages_processed""", "fx_conn", "fx_members", recursive=True)),
    "connection_gauge": Query(lambda spark, d: ops.connection_gauge(log(spark, d), "ip"), oracle(f"with {_GAUGE} select ip, ms, event_id, open from o", "fx_conn")),
    "connection_gauge_split": Query(lambda spark, d: ops.connection_gauge(log(spark, d), "ip", split=True), oracle(f"with {_GAUGE} select ip, ms, event_id, open from o", "fx_conn")),
    "connection_gauge_all": Query(lambda spark, d: ops.connection_gauge(log(spark, d), None), oracle("""with g as (select ms, event_id, sum(case kind when 'connect' then 1 else -1 end) over (order by ms, event_id rows unbounded preceding) as total from fx_conn where kind in ('connect', 'disconnect'))
      select ms, event_id, cast(total - least(0, min(total) over (order by ms, event_id rows unbounded preceding)) as bigint) as open from g""", "fx_conn")),
    "peak_concurrency": Query(lambda spark, d: ops.peak_concurrency(ops.connection_gauge(log(spark, d), "ip"), "ip"), oracle(f"with {_GAUGE} select ip, max(open) as peak, arg_min(ms, ms) filter (open = top) as peak_ms from (select *, max(open) over (partition by ip) as top from o) q group by 1", "fx_conn")),
    "recent_events": Query(lambda spark, d: ops.recent_events(log(spark, d), "ip"), oracle(f"""with {_GAUGE} select * from (select ip, cast(row_number() over (partition by ip order by ms desc, event_id desc) as integer) as nth, event_id, kind, connection_id,
      case when kind = 'connect' then vault_id end as vault, case when kind = 'connect' then user_id end as "user", ms from g) q where nth <= 100""", "fx_conn")),
    "vault_roster": Query(lambda spark, d: roster(spark, d).withColumn("permissions", F.to_json("permissions")), oracle(f"with {_ROSTER} select vault_id, owner, created_ms, member_count, cast(to_json(permissions) as varchar) as permissions from ros", "fx_conn", "fx_members")),
    "access_check": Query(access, oracle(f"with {_ROSTER}, h as (select held.* from held join first using (vault_id)) select w.vault_id, w.user_id, permission, permission is not null as has_access from (select distinct vault_id, user_id from fx_conn where user_id <> '') w left join h on w.vault_id = h.vault_id and w.user_id = h.user_id", "fx_conn", "fx_members")),
    "presence_latest": Query(lambda spark, d: ops.presence_latest(presence(spark, d)), oracle(f"select client_id, vault_id, name, current_file, ms from {_LATEST.format(src='fx_presence')} l", "fx_presence")),
    "presence_delta": Query(delta, oracle(f"""with a as (select * from {_LATEST.format(src=f'(select * from fx_presence where ms < {MIDDLE}) z')} l), b as (select * from {_LATEST.format(src='fx_presence')} l),
      c as (select coalesce(a.client_id, b.client_id) as client_id, case when a.client_id is null then 'added' when b.client_id is null then 'removed'
        when a.vault_id is distinct from b.vault_id or a.name is distinct from b.name or a.current_file is distinct from b.current_file then 'updated' end as change from a full join b on a.client_id = b.client_id)
      select * from c where change is not null""", "fx_presence")),
    "users_per_vault": Query(lambda spark, d: ops.users_per(ops.presence_latest(presence(spark, d))).filter("file is null").select("vault_id", "clients"), oracle(f"select vault_id, count(*) as clients from {_LATEST.format(src='fx_presence')} l group by 1", "fx_presence")),
    "users_per_document": Query(lambda spark, d: ops.users_per(ops.presence_latest(presence(spark, d))).filter("file is not null").select("vault_id", "file", "named"), oracle(f"select vault_id, coalesce(current_file, 'no document') as file, count(name) as named from {_LATEST.format(src='fx_presence')} l group by all", "fx_presence")),
    "status_transitions": Query(lambda spark, d: ops.status_transitions(status(spark, d)), oracle(f"with {_TRANS} select * from tr", "fx_status")),
    "reconnect_schedule": Query(lambda spark, d: ops.reconnect_schedule(status(spark, d)), oracle("""with e as (select *, cast(sum(case when status = 'connected' then 1 else 0 end) over (partition by client_id order by ms, event_id rows unbounded preceding) as bigint) as episode from fx_status where status in ('connected', 'disconnected')),
      n as (select client_id, episode, event_id, cast(row_number() over (partition by client_id, episode order by ms, event_id) - 1 as integer) as n from e where status = 'disconnected')
      select *, case when n < 5 then cast(1000 * pow(2, n) as bigint) end as delay_ms from n""", "fx_status")),
    "offline_periods": Query(lambda spark, d: ops.offline_periods(ops.status_transitions(status(spark, d))), oracle(f"""with {_TRANS}, w as (select *, status = 'connected' as online, lag(status = 'connected') over (partition by client_id order by ms, event_id) as was from tr),
      e as (select *, lead(ms) over (partition by client_id order by ms, event_id) as until_ms from w where online is distinct from coalesce(was, false))
      select client_id, ms as from_ms, until_ms, until_ms - ms as length_ms from e where not online""", "fx_status")),
    "debounce": Query(lambda spark, d: ops.debounce(with_ms(spark.read.parquet(f"{d}/events.parquet")), "user_id", QUIET).select("user_id", "event_id", "ms"), f"""select user_id, event_id, (epoch_us(ts) // 1000) as ms from (select *, lead((epoch_us(ts) // 1000)) over (partition by user_id order by (epoch_us(ts) // 1000), event_id) as nx from events) q where nx is null or nx - (epoch_us(ts) // 1000) >= {QUIET}"""),
}
