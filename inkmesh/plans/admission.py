"""Queries for A1 to A10. The log is sparse, so windows are hours where production has seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission as ops
from ..operators import sessions
from ..sources.fixtures import frame, oracle, with_ms
from .registry import Query

MOST, WINDOW = 3, 6 * 3600_000
OPEN = 3
LIMITS = {"default": (10, 6 * 3600_000, "connection"), "connection": (2, 6 * 3600_000, "ip"), "message": (3, 12 * 3600_000, "connection"), "auth": (3, 6 * 3600_000, "connection")}


def throttled(source: str, key: str, most: str = str(MOST), window: str = str(WINDOW), order: str = "ms, event_id", after: int = 1 << 60) -> str:
    """Recursive SQL for the throttle: one step per request number of a key; ``after`` its window, a record is forgotten. Defines ``thr``."""
    return f"""num as (select *, row_number() over (partition by {key} order by {order}) as rn from {source}),
      thr as (
        select {key} as k, cast(0 as bigint) as rn, cast(null as bigint) as event_id, cast(null as bigint) as ms, true as allowed, cast(0 as bigint) as cnt, cast(-1 as bigint) as reset_ms, cast(0 as bigint) as violations, cast(0 as bigint) as most, cast(0 as bigint) as win
        from num group by 1
        union all
        select k, rn, event_id, ms, c0 < most, case when c0 < most then c0 + 1 else c0 end, r0, case when c0 < most then v0 else v0 + 1 end, most, win from (
          select t.k, n.rn, n.event_id, n.ms, cast({most} as bigint) as most, cast({window} as bigint) as win,
            case when n.ms >= t.reset_ms then 0 else t.cnt end as c0, case when n.ms >= t.reset_ms then n.ms + {window} else t.reset_ms end as r0,
            case when n.ms - t.reset_ms > {after} then 0 when n.ms >= t.reset_ms then greatest(0, t.violations - 1) else t.violations end as v0
          from thr t join num n on n.{key} = t.k and n.rn = t.rn + 1) s)"""


_RATE = """event_id, ms, allowed, case when allowed then most - cnt end as remaining,
  case when not allowed then cast(win * least(pow(2, violations), 32) as bigint) end as retry_after, violations, reset_ms from thr where rn > 0"""
_MESSAGES = "m as (select * from fx_conn where kind = 'message' and direction is not null)"
_DRAWS = """lim(class, most, win, map) as (values ('default', 10, 21600000, 'connection'), ('connection', 2, 21600000, 'ip'), ('message', 3, 43200000, 'connection'), ('auth', 3, 21600000, 'connection')),
  dr as (select event_id, ms, 'connection' as class, ip as who, 0 as nth from fx_conn where kind = 'connect'
    union all select event_id, ms, 'auth', ip, 1 from fx_conn where kind = 'connect' and token <> ''
    union all select event_id, ms, 'message', connection_id, 2 from fx_conn where kind = 'message'
    union all select event_id, ms, 'default', ip, 3 from fx_conn where kind = 'disconnect'),
  rq as (select dr.event_id * 4 + nth as event_id, ms, class, cast(most as bigint) as most_n, cast(win as bigint) as win_n, map || ':' || who as record from dr join lim using (class))"""


def log(spark, d):
    return with_ms(frame(spark, d, "fx_conn"))


def limited(spark, d):
    return ops.rate_limit(log(spark, d), "ip", MOST, WINDOW)


def crowd(df):
    """The log with forty addresses, so that each has many requests."""
    return df.withColumn("ip", F.concat(F.lit("10.1.0."), F.col("event_id") % 40))


def budget(spark, d):
    return ops.message_budget(log(spark, d), MOST, WINDOW)


def traffic(df):
    """The log with larger messages, and some that cannot be read: every 37th row has no size."""
    return df.withColumn("msg_bytes", F.when(F.col("event_id") % 37 != 0, F.col("msg_bytes") * 8))


def admitted(spark, d):
    return ops.admission(traffic(log(spark, d)), {k: v[:2] for k, v in LIMITS.items()}, OPEN)


def state_expiry(spark, d):
    rows = log(spark, d)
    return ops.state_expiry(sessions.sessions(rows, budget(spark, d)), limited(spark, d), "ip", rows.agg(F.max("ms")).scalar())


SESSIONS = f"""{throttled("m", "connection_id")},
  bud as (select event_id, allowed from thr where rn > 0),
  lg as (select c.*, coalesce(b.allowed, false) as ok from fx_conn c left join bud b on c.event_id = b.event_id),
  ses as (select connection_id, min(ms) as created_ms, arg_min(vault_id, (ms, event_id)) filter (regexp_full_match(vault_id, '[A-Za-z0-9_-]{{1,128}}')) as vault_id,
    arg_min(case when coalesce(user_id, '') = '' then 'anonymous' else user_id end, (ms, event_id)) as user_id, arg_min(ip, (ms, event_id)) as ip,
    coalesce(max(ms) filter (kind = 'connect' or (kind = 'message' and ok)), min(ms)) as last_ms, max(ms) filter (kind = 'disconnect') as closed_ms,
    arg_max(kind, (ms, event_id)) <> 'disconnect' as is_open
    from lg group by 1)"""

_FLAGS = """regexp_full_match(origin, 'https?://(localhost|127\\.0\\.0\\.1)(:[0-9]+)?') as origin_ok, coalesce(token = 'secret-1', false) as token_ok,
    coalesce(regexp_full_match(vault_id, '[A-Za-z0-9_-]{1,128}'), false) as vault_ok, coalesce(user_id, '') = '' or regexp_full_match(user_id, '[A-Za-z0-9_.@-]{1,64}') as user_ok"""
#: The whole of A6 as one recursion by IP: both rate records, the open sessions with their last activity and message budget, and the
#: first failing check. Defines ``adm``.
ADMISSION = f"""ev as (select *, {_FLAGS}, event_id % 37 <> 0 as readable, row_number() over (partition by ip order by ms, event_id) as rn from fx_conn),
  adm as (
    select ip, cast(0 as bigint) as rn, cast(null as bigint) as event_id, cast(null as bigint) as ms, '' as decision, cast(null as varchar) as reason, cast(0 as bigint) as open, cast([] as struct(c varchar, l bigint, n bigint, e bigint)[]) as ses,
      cast(0 as bigint) as c_n, cast(-1 as bigint) as c_end, cast(0 as bigint) as a_n, cast(-1 as bigint) as a_end from ev group by 1
    union all
    select ip, rn, event_id, ms, decision, reason,
      case when decision = 'admit' then open + 1 when decision = 'close' and reason is distinct from 'no_session' then greatest(0, open - 1) else open end,
      case decision when 'admit' then list_append(list_filter(ses, lambda x: x.c <> connection_id), struct_pack(c := connection_id, l := ms, n := cast(0 as bigint), e := cast(-1 as bigint)))
        when 'close' then list_filter(ses, lambda x: x.c <> connection_id)
        when 'pass' then list_append(list_filter(ses, lambda x: x.c <> connection_id), struct_pack(c := connection_id, l := ms, n := m0 + 1, e := m_end0)) else ses end,
      case when asks_c then c0 + cast(c0 < {LIMITS['connection'][0]} as bigint) else c_n end, case when asks_c then c_end0 else c_end end,
      case when asks_a then a0 + cast(a0 < {LIMITS['auth'][0]} as bigint) else a_n end, case when asks_a then a_end0 else a_end end
    from (select *, case kind when 'connect' then case when reason is null then 'admit' else 'reject' end when 'disconnect' then 'close'
        else case reason when 'no_session' then 'drop' when 'message_rate' then 'throttle' when 'internal' then 'close' when 'too_large' then 'close' else 'pass' end end as decision from (
      select *, kind = 'connect' and open < {OPEN} as asks_c, kind = 'connect' and open < {OPEN} and c0 < {LIMITS['connection'][0]} and origin_ok as asks_a,
        case kind when 'disconnect' then case when s is null then 'no_session' end
          when 'message' then case when s is null then 'no_session' when not readable then 'internal' when msg_bytes * 8 > 1048576 then 'too_large' when m0 >= {LIMITS['message'][0]} then 'message_rate' end
          else case when open >= {OPEN} then 'ip_limit' when c0 >= {LIMITS['connection'][0]} then 'connection_rate' when not origin_ok then 'origin'
            when a0 >= {LIMITS['auth'][0]} then 'auth_rate' when not token_ok then 'token' when not vault_ok then 'vault_id' when not user_ok then 'user_id' end end as reason
      from (select * replace (greatest(0, open - len(was) + len(ses)) as open), case when ms >= s.e then 0 else s.n end as m0, case when ms >= s.e then ms + {LIMITS['message'][1]} else s.e end as m_end0
        from (select *, list_filter(ses, lambda x: x.c = connection_id)[1] as s from (
          select f.ip, f.open, f.ses as was, list_filter(f.ses, lambda x: e.ms - x.l <= {ops.IDLE}) as ses, f.c_n, f.c_end, f.a_n, f.a_end, e.rn, e.event_id, e.ms, e.kind, e.msg_bytes, e.readable, e.connection_id, e.origin_ok, e.token_ok, e.vault_ok, e.user_ok,
            case when e.ms >= f.c_end then 0 else f.c_n end as c0, case when e.ms >= f.c_end then e.ms + {LIMITS['connection'][1]} else f.c_end end as c_end0,
            case when e.ms >= f.a_end then 0 else f.a_n end as a0, case when e.ms >= f.a_end then e.ms + {LIMITS['auth'][1]} else f.a_end end as a_end0
          from adm f join ev e on e.ip = f.ip and e.rn = f.rn + 1) s1) s2) s3) s4) s5)"""
DECIDED = "select ip, event_id, ms, decision, reason, case when decision = 'reject' then 1008 when reason = 'too_large' then 1009 when reason = 'internal' then 1011 end as close_code, open from adm where rn > 0"

QUERIES = {
    "rate_limit": Query(limited, oracle(f"with {throttled('fx_conn', 'ip')} select k as ip, {_RATE}", "fx_conn", recursive=True)),
    "rate_limit_hot": Query(lambda spark, d: ops.rate_limit(crowd(log(spark, d)), "ip", 2, WINDOW, ops.AFTER_RESET, hot=100), oracle(f"""with h as (select event_id, ms, '10.1.0.' || (event_id % 40) as ip from fx_conn), {throttled('h', 'ip', '2', after=ops.AFTER_RESET)}
      select k as ip, {_RATE}""", "fx_conn", recursive=True)),
    "rate_limit_classes": Query(lambda spark, d: ops.rate_limit_classes(log(spark, d), ops.limits_frame(spark, LIMITS)), oracle(f"with {_DRAWS}, {throttled('rq', 'record', 'n.most_n', 'n.win_n', 'ms, event_id')} select k as record, thr.event_id // 4 as event_id, class, allowed, violations from thr join rq on rq.event_id = thr.event_id where rn > 0", "fx_conn", recursive=True)),
    "rate_limit_simple": Query(lambda spark, d: ops.rate_limit_simple(log(spark, d), "ip", MOST, WINDOW), oracle(f"""with num as (select *, row_number() over (partition by ip order by ms, event_id) as rn from fx_conn),
      f as (select ip, cast(0 as bigint) as rn, cast(null as bigint) as event_id, cast(null as bigint) as ms, true as allowed, cast(0 as bigint) as cnt, cast(null as bigint) as start from num group by 1
        union all select f.ip, n.rn, n.event_id, n.ms, f.start is null or n.ms - f.start > {WINDOW} or f.cnt < {MOST},
          case when f.start is null or n.ms - f.start > {WINDOW} then 1 when f.cnt < {MOST} then f.cnt + 1 else f.cnt end, case when f.start is null or n.ms - f.start > {WINDOW} then n.ms else f.start end
        from f join num n on n.ip = f.ip and n.rn = f.rn + 1)
      select ip, ms, event_id, allowed from f where rn > 0""", "fx_conn", recursive=True)),
    "message_budget": Query(budget, oracle(f"with {_MESSAGES}, {throttled('m', 'connection_id')} select k as connection_id, {_RATE}", "fx_conn", recursive=True)),
    "ip_connection_limit": Query(lambda spark, d: ops.ip_connection_limit(log(spark, d), OPEN), oracle(f"""with num as (select *, row_number() over (partition by ip order by ms, event_id) as rn from fx_conn where kind in ('connect', 'disconnect')),
      f as (select ip, cast(0 as bigint) as rn, cast(null as bigint) as event_id, '' as kind, true as admitted, cast(0 as bigint) as open from num group by 1
        union all select f.ip, n.rn, n.event_id, n.kind, n.kind <> 'connect' or f.open < {OPEN},
          case when n.kind = 'connect' then case when f.open < {OPEN} then f.open + 1 else f.open end else greatest(0, f.open - 1) end from f join num n on n.ip = f.ip and n.rn = f.rn + 1)
      select ip, event_id, kind, admitted, open from f where rn > 0""", "fx_conn", recursive=True)),
    "admission": Query(admitted, oracle(f"with {ADMISSION} {DECIDED}", "fx_conn", recursive=True)),
    "rejections_by_reason": Query(lambda spark, d: ops.rejections_by_reason(admitted(spark, d)), oracle(f"with {ADMISSION} select reason, ip, count(*) as rejects, min(ms) as first_ms, max(ms) as last_ms from adm where decision = 'reject' group by cube(reason, ip)", "fx_conn", recursive=True)),
    "top_offenders": Query(lambda spark, d: ops.top_offenders(limited(spark, d), "ip"), oracle(f"""with {throttled('fx_conn', 'ip')}, a as (select k as ip, {_RATE})
      select ip, max(violations) as violations, max(retry_after) as retry_after, count(*) filter (not allowed) as rejects from a group by ip order by 2 desc, 3 desc nulls last, 4 desc, 1 limit 10""", "fx_conn", recursive=True)),
    "throttle_hits": Query(lambda spark, d: ops.throttle_hits(log(spark, d), budget(spark, d)), oracle(f"""with {_MESSAGES}, {throttled('m', 'connection_id')}
      select direction, count(*) filter (not allowed) as hits, count(*) filter (allowed) as allowed from thr join m using (event_id) where thr.rn > 0 group by 1""", "fx_conn", recursive=True)),
    "state_expiry": Query(state_expiry, oracle(f"""with {_MESSAGES}, {SESSIONS}, x as (select max(ms) as as_of from fx_conn),
      {throttled('fx_conn', 'ip').replace('num as', 'num2 as').replace('from num ', 'from num2 ').replace('join num n', 'join num2 n').replace('thr as', 'thr2 as').replace('from thr t', 'from thr2 t')}
      select 'session' as kind, connection_id as id, as_of - last_ms > 86400000 as expired from ses, x where is_open
      union all select 'throttle', k, any_value(as_of) - max(reset_ms) > 3600000 from thr2, x where rn > 0 group by k""", "fx_conn", recursive=True)),
}
