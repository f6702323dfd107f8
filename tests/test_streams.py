"""Streams equal their batch forms up to the watermark, whatever the order of arrival; state that can go goes."""

import time

from pyspark.sql import functions as F

from inkmesh.operators import admission, oplog, reconcile, sessions
from inkmesh.plans import admission as plans
from inkmesh.plans import oplog as oplog_plans
from inkmesh.plans import streams
from inkmesh.plans import sessions as session_plans
from inkmesh.sources import io
from inkmesh.sources.fixtures import frame, with_ms
from inkmesh.sources.scratch import scratch
from inkmesh.streaming import operators as ops
from inkmesh.streaming import panel, watch
from inkmesh.streaming.run import ROCKS, closing, drained

from .conftest import DATA


def _rows(df):
    return sorted(map(repr, df.collect()))


def _same(stream, batch):
    assert _rows(stream.select(batch.columns)) == _rows(batch)


def test_admission(spark):
    batch = plans.admitted(spark, DATA)
    _same(streams.QUERIES["stream_admission"].run(spark, DATA), batch)
    assert {1008, 1009, 1011} <= {r.close_code for r in batch.select("close_code").distinct().collect()}


def test_sessions(spark):
    batch = ops.ended_sessions(plans.log(spark, DATA))
    _same(streams.QUERIES["stream_sessions"].run(spark, DATA), batch)
    assert batch.filter("how = 'expired'").count() > 0


def test_debounce(spark):
    events = with_ms(spark.read.parquet(f"{DATA}/events.parquet"))
    _same(streams.QUERIES["stream_debounce"].run(spark, DATA), sessions.debounce(events, "user_id", session_plans.QUIET).select("user_id", "event_id"))


def test_presence(spark):
    rows = session_plans.presence(spark, DATA)
    _same(streams.QUERIES["stream_presence"].run(spark, DATA), sessions.presence_latest(rows, rows.agg(F.max("ms")).scalar(), streams.TTL))


def test_offline_queues(spark):
    _same(streams.QUERIES["stream_ops"].run(spark, DATA), oplog.offline_drain(oplog_plans.twice(spark, DATA), oplog_plans.changes(spark, DATA)))


def test_panel_of_all_sessions(spark):
    _same(streams.QUERIES["sessions_panel"].run(spark, DATA), session_plans.found(spark, DATA))


def test_silent_session_expires_by_timer(spark):
    rows = [("a", 10**9, 1, "connect"), ("b", 10**9, 2, "connect"), ("b", 10**9 + ops.DAY + 1, 3, "message"), ("c", 10**9 + 3 * ops.DAY, 4, "connect")]
    df = spark.createDataFrame(rows, "connection_id string, ms long, event_id long, kind string")
    want = {("a", 10**9, "expired"), ("b", 10**9, "expired"), ("b", 10**9 + ops.DAY + 1, "expired")}
    assert {(r.connection_id, r.created_ms, r.how) for r in ops.ended_sessions(df).collect()} == want
    path = f"{scratch(spark, 'silent')}/log"
    df.write.parquet(path)
    stream = closing(spark.readStream.schema(df.schema).parquet(path), 10**9 + 3 * ops.DAY + streams.HOUR + 2)
    assert {(r.connection_id, r.created_ms, r.how) for r in drained(ops.stream_sessions(stream), "silent").collect()} == want


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id") % 3).alias("ip"), (F.col("id") * 61 % 200 * 1000 + 10**9).alias("ms"), F.col("id").alias("event_id"))
    path = f"file://{tmp_path}/log"
    rows.orderBy(F.rand(7)).repartition(5).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    limited = lambda s: ops.stream_rate_limit(s, "ip", 3, 10_000, delay="1 day", after_reset=None)
    assert drained(limited(stream), "order").count() == 0  # all still within the allowed lateness
    late = spark.createDataFrame([("z", 10**12, -1)], rows.schema)
    got = drained(limited(stream), "order", again=lambda: late.coalesce(1).write.mode("append").parquet(path))
    assert _rows(got) == _rows(admission.rate_limit(rows, "ip", 3, 10_000))


class Steps:
    """A stream that is fed file by file, with the state's rows and the rows made after each."""

    def __init__(self, spark, schema, form):
        self.spark, self.schema, self.form, self.folder = spark, schema, form, scratch(spark, "steps")
        spark.createDataFrame([], schema).write.parquet(f"{self.folder}/in")

    def feed(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        stream = self.form(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        query = stream.writeStream.option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).format("parquet").option("path", f"{self.folder}/out").start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"], self.spark.read.schema(stream.schema).parquet(f"{self.folder}/out").collect()


def test_throttle_and_presence_leave_the_state(spark):
    hour, start = streams.HOUR, 10**12
    schema = "ip string, ms long, event_id long"
    run = Steps(spark, schema, lambda s: ops.stream_rate_limit(s, "ip", 1, 1000, delay="1 minute"))
    full, _ = run.feed([(f"k{k}", start + k, k) for k in range(20)] + [("z", start + 100_000, 99)])
    held, made = run.feed([("z", start + hour, 100)])  # all twenty have gone through, none has been silent for an hour
    assert len(made) == 21 and held >= 40 // 2
    gone, _ = run.feed([("z", start + 2 * hour + 200_000, 101)])
    assert gone < held and gone <= 8 < full
    _, made = run.feed([("k0", start + 2 * hour + 190_000, 102), ("z", start + 3 * hour, 103)])
    assert [(r.allowed, r.violations) for r in made if r.event_id == 102] == [(True, 0)]

    schema = "client_id string, ms long, seq long, vault_id string, name string, current_file string, is_null boolean"
    run = Steps(spark, schema, lambda s: ops.stream_presence(s, delay="1 minute", ttl=hour))
    rows = [(f"c{k}", start + k, k, "v", "n", "f", k % 2 == 1) for k in range(20)]
    run.feed(rows + [("z", start + 100_000, 0, "v", "n", "f", False)])
    held, made = run.feed([("z", start + 170_000, 0, "v", "n", "f", False)])
    assert len(made) == 21 and sum(r.removed for r in made) == 10
    gone, made = run.feed([("z", start + hour + 200_000, 0, "v", "n", "f", False)])
    assert gone < held and sum(r.removed for r in made) == 20
    assert {r.ms for r in made if r.seq is None} == {start + k + hour for k in range(0, 20, 2)}


def test_rows_behind_the_watermark_are_counted_and_change_nothing(spark):
    start = 10**12
    run = Steps(spark, "ip string, ms long, event_id long", lambda s: ops.stream_rate_limit(s, "ip", 1, 1000, delay="1 minute", late=True))
    run.feed([("a", start, 1), ("a", start + 100_000, 2)])
    run.feed([("a", start + 5, 3), ("a", start + 6, 4), ("b", start + 7, 5), ("a", start + 90_000, 6)])
    _, made = run.feed([("z", start + 10**6, 7)])
    assert {(r.ip, r.late) for r in made if r.late} == {("a", 2), ("b", 1)}
    assert sorted(r.event_id for r in made if r.late is None) == [1, 2, 6]


def test_offline_queue_waits_for_its_client(spark):
    t, op, status = 10**12, "vault_id string, user_id string, id long, ms long, seq long, type string, new_path string", "client_id string, ms long, event_id long, status string"
    o = [("v", "u", 1, t + 10, 1, "create", None), ("v", "u", 2, t + 20, 2, "rename", None), ("w", "u", 3, t + 30, 3, "create", None), ("v", "u", 4, t + 40, 4, "create", None), ("v", "u", 1, t + 45, 5, "create", None), ("v", "u", 5, t + 60, 6, "move", "x"), ("v", "u", 6, t + 80, 7, "create", None)]
    c = [("u", t + 50, 1, "connected"), ("u", t + 55, 2, "syncing"), ("u", t + 70, 3, "disconnected"), ("u", t + 90, 4, "connecting"), ("u", t + 100, 5, "connected")]
    folder = scratch(spark, "queue")
    spark.createDataFrame(o, op).write.parquet(f"{folder}/ops")
    spark.createDataFrame(c, status).write.parquet(f"{folder}/status")
    read = lambda n, s: spark.readStream.schema(s).parquet(f"{folder}/{n}")
    got = drained(ops.stream_ops(closing(read("ops", op), t + 2 * streams.HOUR), read("status", status)), "queue")
    want = {(1, "queued", "applied", 50), (2, "queued", "failed", 50), (3, "queued", "applied", 50), (4, "queued", "left", 50), (5, "direct", "applied", 60), (6, "queued", "left", 100)}
    assert {(r.id, r.route, r.outcome, r.at_ms - t) for r in got.collect()} == want and got.count() == 6
    batch = oplog.offline_drain(spark.createDataFrame(o, op), sessions.status_transitions(spark.createDataFrame(c, status)))
    assert {(r.id, r.route, r.outcome, r.at_ms - t) for r in batch.collect()} == want


def test_reconciliation_reads_no_batch_twice_and_says_changes_only(spark):
    quiet, start = 50_000, 10**12
    run = Steps(spark, "vault_id string, path string, replica string, present boolean, op string, ms long", lambda s: watch.stream_reconcile(s, quiet, live=False, delay="0 seconds"))
    file = lambda path, replica, ms, there=True: ("v", path, replica, there, None, start + ms)
    own = lambda path, op, ms: ("v", path, "local", None, op, start + ms)
    said = lambda made: sorted((r.path, r.action) for r in made)
    first, made = run.feed([file("a", "local", 0), own("a", "create", 0), file("b", "remote", 0), file("c", "local", 0), file("c", "remote", 0), own("d", "delete", 0), own("z", "rename", 31_000)])
    assert said(made) == [("a", "suppressed"), ("b", "pull")]
    _, made = run.feed([own("z", "rename", 100_000)])
    assert said(made) == [("a", "push"), ("a", "suppressed"), ("b", "pull")]
    _, made = run.feed([file("a", "remote", 110_000), file("b", "remote", 110_000, False), file("c", "local", 90_000, False), own("z", "rename", 200_000)])
    assert said(made) == [("a", "push"), ("a", "settled"), ("a", "suppressed"), ("b", "pull"), ("b", "settled"), ("c", "pull")]
    last, made = run.feed([own("y", "delete", 400_000)])
    assert len(made) == 6 and last < first  # b is nowhere now, and the quiet times of d and z are over


def _until(query, done, seconds=90):
    end = time.time() + seconds
    try:
        while not done():
            assert query.isActive and time.time() < end, query.exception()
            time.sleep(0.3)
    finally:
        query.stop()


def test_reconciliation_live(spark):
    folder, now = scratch(spark, "live"), int(time.time() * 1000)
    schema = "vault_id string, path string, replica string, present boolean, op string, ms long"
    spark.createDataFrame([("v", "a", "local", True, None, now), ("v", "a", "local", None, "create", now + 3000), ("v", "b", "remote", True, None, now)], schema).write.parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = watch.stream_reconcile(spark.readStream.schema(schema).parquet(f"{folder}/in"), quiet=4000, tick=1000)
    query = stream.writeStream.option("checkpointLocation", f"{folder}/log").trigger(processingTime="1 second").format("parquet").option("path", f"{folder}/out").start()
    found = lambda: spark.read.schema(stream.schema).parquet(f"{folder}/out")
    _until(query, lambda: ("a", "push") in {(r.path, r.action) for r in found().collect()})
    rows = sorted((r.path, r.at_ms, r.action) for r in found().collect())
    assert [(p, a) for p, _, a in rows if (p, a) != ("a", "suppressed")] == [("a", "push"), ("b", "pull")]
    assert min(at for p, at, a in rows if a == "push") > now + 7000


def test_panel_ticks(spark):
    folder = scratch(spark, "ticks")
    log = with_ms(frame(spark, DATA, "fx_conn")).filter("connection_id like 'c1%'")
    columns = [c.split()[0] for c in streams.schemas.CONN_LOG.split(", ")]
    cut = log.agg(F.percentile_approx("ms", 0.5)).first()[0]
    log.filter(F.col("ms") <= cut).select(columns).coalesce(1).write.parquet(f"{folder}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    changes = panel.stream_session_changes(with_ms(io.conn_log_stream(spark, f"{folder}/in")), 3, 3600_000, delay="0 seconds")
    query = ops.ticking(changes, panel.upsert, f"{folder}/panel", f"{folder}/log", mode="append")
    batch = lambda rows: sessions.sessions(rows, admission.message_budget(rows, 3, 3600_000))
    seen = lambda: {tuple(r) for r in panel.panel(spark, f"{folder}/panel").collect()} if panel._ticks(spark, f"{folder}/panel") else set()
    want = lambda rows: {tuple(r) for r in batch(rows).select(panel.panel(spark, f"{folder}/panel").columns).collect()}
    ticks = []

    def second():
        """The first tick's panel, then the log's second half."""
        if not ticks and seen() == want(log.filter(F.col("ms") <= cut)):
            ticks.append(panel._ticks(spark, f"{folder}/panel"))
            log.filter(F.col("ms") > cut).select(columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        return bool(ticks) and seen() == want(log)

    _until(query, lambda: bool(panel._ticks(spark, f"{folder}/panel")) and second())
    assert panel._ticks(spark, f"{folder}/panel")[-1] > ticks[0][-1]


def test_panel_merges_its_folders(spark):
    out = f"{scratch(spark, 'merge')}/panel"
    for n in range(2 * panel.MERGE + 3):
        rows = [(f"c{k}", "v", "u", "i", 0, n, None, True, n, n) for k in range(n % 4 + 1)]
        for _ in range(1 + n % 2):  # a batch may run twice
            panel.upsert(spark.createDataFrame(rows, panel.SESSION), n, out)
        assert len(panel._ticks(spark, out)) <= panel.MERGE + 1
    assert {(r.connection_id, r.last_ms) for r in panel.panel(spark, out).collect()} == {("c0", 22), ("c1", 22), ("c2", 22), ("c3", 19)}


def test_renames_count_under_the_new_path_if_asked(spark):
    log = spark.createDataFrame([("v", "local", "rename", "old", "new", 100), ("v", "local", "create", "other", None, 100)], "vault_id string, replica string, op string, path string, new_path string, ms long")
    files = spark.createDataFrame([("v", "local", "new"), ("v", "local", "other")], "vault_id string, replica string, path string")
    plan = lambda key: {(r.path, r.action) for r in reconcile.periodic_reconcile(files, reconcile.recent_ops(log, F.lit(200), key), F.lit(200), 150).collect()}
    assert plan("old") == {("new", "push"), ("other", "suppressed")} and plan("new") == {("new", "suppressed"), ("other", "suppressed")}
