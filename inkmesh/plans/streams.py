"""Queries for the streaming forms. Each runs over the given table's files as a stream until they are used up; a closing row
moves the watermark past the latest row, so that the results are whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions
from ..sources import io, schemas
from ..sources.fixtures import file_stream, frame, oracle, with_ms
from ..sources.scratch import scratch
from ..streaming import operators as ops
from ..streaming import panel, watch
from ..streaming.run import closing, drained
from . import admission, oplog, reconcile
from .admission import LIMITS, MOST, OPEN, WINDOW, throttled
from .registry import Query
from .sessions import _LATEST, QUIET

HOUR = 3600_000
#: Silence after which a client is gone, and the share of rows that come late in the query on them.
TTL, LATE = 12 * HOUR, 20


def log(spark, d):
    return with_ms(frame(spark, d, "fx_conn", stream=True))


def latest(df) -> int:
    return df.agg(F.max("ms")).first()[0] or 0


def whole(spark, d, view: str, ready=lambda df: df, wait: int = HOUR + 2, **values):
    """The view's stream with a closing row; ``wait`` is the lateness that its operator allows and more."""
    return closing(ready(with_ms(frame(spark, d, view, stream=True))), latest(with_ms(frame(spark, d, view))) + wait, **values)


def presence(spark, d):
    said = drained(ops.stream_presence(whole(spark, d, "fx_presence"), ttl=TTL), "presence")
    return sessions.presence_latest(said.withColumn("is_null", F.col("removed")))


def debounced(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    stream = closing(file_stream(spark, d, "events", events.schema), latest(with_ms(events)) + 24 * HOUR)
    return drained(ops.stream_debounce(stream, "user_id", QUIET), "debounce")


def conn_files(spark, d) -> str:
    """The log as files of the log's schema, as a server writes them."""
    path = f"{scratch(spark, 'conn-log')}/log"
    frame(spark, d, "fx_conn").selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in schemas.CONN_LOG.split(", ")]).write.parquet(path)
    return path


def conn_stream(spark, d):
    """The log's files read as a table and as a stream: rows of both, with how often each came."""
    path = conn_files(spark, d)
    both = io.conn_log(spark, path).select("event_id").unionByName(drained(io.conn_log_stream(spark, path).select("event_id"), "log"))
    found = io.conn_log(spark, path).select("event_id", "ts", "connection_id", "ip", "kind", "direction", "msg_bytes")
    return with_ms(found).drop("ts").join(both.groupBy("event_id").agg(F.count(F.lit(1)).alias("read")), "event_id")


def sessions_panel(spark, d):
    """The panel after all ticks, fed from the log's files."""
    path = conn_files(spark, d)
    rows = with_ms(io.conn_log(spark, path))
    stream = closing(with_ms(io.conn_log_stream(spark, path)), latest(rows) + 10_002)
    out = []
    drained(panel.stream_session_changes(stream, MOST, WINDOW), "panel", each=lambda df, n, to: (out.append(to), panel.upsert(df, n, to)), read=False)
    return panel.panel(spark, out[-1])


def late_rows(spark, d):
    """Every ``LATE``th row comes when all others have gone through: the late rows of each IP, counted beside the result."""
    rows = with_ms(frame(spark, d, "fx_conn")).select("ip", "ms", "event_id")
    path, is_late = f"{scratch(spark, 'late')}/log", F.col("event_id") % LATE == 0
    last = rows.agg(F.max("ms").alias("ms")).select(F.lit(None).cast("string").alias("ip"), F.col("ms") + HOUR + 2, F.lit(-1).cast("long"))
    rows.filter(~is_late).union(last).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    made = drained(ops.stream_rate_limit(stream, "ip", MOST, WINDOW, late=True), "late", again=lambda: rows.filter(is_late).write.mode("append").parquet(path))
    return made.groupBy("ip").agg(F.sum("late").alias("late"), F.count_if(F.col("late").isNull()).alias("on_time"), F.count_if("allowed").alias("allowed"))


def reconciled(spark, d):
    """The plan after all changes, decided as of the latest operation: the closing row's time less the lateness allowed."""
    recent = whole(spark, d, "fx_recent", wait=HOUR)
    rows = watch.changes(frame(spark, d, "fx_inventory", stream=True), recent)
    return watch.plan_now(drained(watch.stream_reconcile(rows, reconcile.LONG, live=False), "reconcile"))


def offline(spark, d):
    changes = with_ms(frame(spark, d, "fx_status", stream=True))
    return drained(ops.stream_ops(whole(spark, d, "fx_ops", oplog.again), changes), "ops")


def panels(spark, d):
    return drained(ops.stream_status(log(spark, d)), "status", "complete", ops.status_sinks).select("panel", "item", "n", "bytes")


#: Sessions that end: a run of events goes on until a close or a gap of more than a day; it has ended too if the log goes on for more
#: than a day after its last event.
_ENDED = f"""
  e as (select connection_id, event_id, ms, kind, lag(ms) over w as pm, lag(kind) over w as pk, lead(ms) over w as nm from fx_conn window w as (partition by connection_id order by ms, event_id)),
  r as (select *, sum(case when pk is null or pk = 'disconnect' or ms - pm > {24 * HOUR} then 1 else 0 end) over (partition by connection_id order by ms, event_id) as run from e),
  c as (select *, min(ms) over (partition by connection_id, run) as created from r), x as (select max(ms) as a from fx_conn)
  select connection_id, created as created_ms, pm as last_ms, ms as ended_ms, 'closed' as how, event_id, ms from c where kind = 'disconnect' and pk <> 'disconnect' and ms - pm <= {24 * HOUR}
  union all select connection_id, created, ms, ms + {24 * HOUR}, 'expired', null, ms + {24 * HOUR} from c, x where kind <> 'disconnect' and coalesce(nm, a) - ms > {24 * HOUR}"""

QUERIES = {
    "conn_log_stream": Query(conn_stream, oracle("select event_id, ms, connection_id, ip, kind, direction, msg_bytes, cast(2 as bigint) as read from fx_conn", "fx_conn")),
    "sessions_panel": Query(sessions_panel, oracle(f"with {admission._MESSAGES}, {admission.SESSIONS} select * from ses", "fx_conn", recursive=True)),
    "status_sinks": Query(panels, oracle("""select 'totals' as panel, 'all' as item, cast(count(*) as bigint) as n, cast(sum(msg_bytes) as bigint) as bytes from fx_conn
      union all select 'kinds', kind, count(*), cast(sum(msg_bytes) as bigint) from fx_conn group by kind union all select 'vaults', vault_id, count(*), cast(sum(msg_bytes) as bigint) from fx_conn group by vault_id""", "fx_conn")),
    "stream_admission": Query(lambda spark, d: drained(ops.stream_admission(whole(spark, d, "fx_conn", admission.traffic, kind="connect"), {k: v[:2] for k, v in LIMITS.items()}, OPEN), "admission"), oracle(f"with {admission.ADMISSION} {admission.DECIDED}", "fx_conn", recursive=True)),
    "stream_rate_limit": Query(lambda spark, d: drained(ops.stream_rate_limit(whole(spark, d, "fx_conn"), "ip", MOST, WINDOW), "rate"), oracle(f"with {throttled('fx_conn', 'ip', after=HOUR)} select k as ip, {admission._RATE}", "fx_conn", recursive=True)),
    "late_rows": Query(late_rows, oracle(f"""with o as (select * from fx_conn where event_id % {LATE} <> 0), {throttled('o', 'ip', after=HOUR)}, l as (select ip, count(*) as late from fx_conn where event_id % {LATE} = 0 group by 1)
      select coalesce(k, ip) as ip, any_value(late) as late, count(k) as on_time, count(*) filter (k is not null and allowed) as allowed from (select * from thr where rn > 0) t full join l on k = ip group by 1""", "fx_conn", recursive=True)),
    "stream_sessions": Query(lambda spark, d: drained(ops.stream_sessions(whole(spark, d, "fx_conn")), "sessions"), oracle(f"with {_ENDED}", "fx_conn")),
    "stream_debounce": Query(debounced, f"""
      with e as (select user_id, event_id, epoch_us(ts) as us, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as nx from events)
      select user_id, event_id from e where nx is null or nx - us >= {QUIET * 1000}"""),
    "stream_presence": Query(presence, oracle(f"select client_id, vault_id, name, current_file, ms from {_LATEST.format(src='fx_presence')} l where (select max(ms) from fx_presence) - ms <= {TTL}", "fx_presence")),
    "stream_reconcile": Query(reconciled, reconcile.QUERIES["periodic_reconcile"].sql),
    "stream_status": Query(lambda spark, d: drained(ops.stream_status(log(spark, d)), "totals", "complete", lambda df, n, out: df.write.mode("overwrite").parquet(out)), oracle("select vault_id, kind, count(*) as n, cast(sum(msg_bytes) as bigint) as bytes from fx_conn group by all", "fx_conn")),
    "stream_ops": Query(offline, oracle(f"with {oplog.OFFLINE}", "fx_status", "fx_ops")),
}
