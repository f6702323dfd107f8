"""Step functions and folds: published vectors, boundaries, properties."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmesh.functions.folds import Gate, Outbox, Presence, Replica, Session, Simple, Throttle
from inkmesh.operators import admission, oplog

LIMITS = {"connection": (5, 60_000), "auth": (3, 60_000)}


def test_eleventh_of_ten_is_refused():
    t = Throttle()
    out = [t.step(0, 10, 1000) for _ in range(11)]
    assert [x[0] for x in out] == [True] * 10 + [False]
    assert out[-1][2] == 2000


def test_back_off_stops_at_32_windows():
    t = Throttle()
    out = [t.step(0, 5, 1000) for _ in range(16)]
    assert t.violations == 11 and out[-1][2] == 32_000


def test_window_is_anchored_and_its_end_resets():
    t = Throttle()
    for now in (500, 600):
        t.step(now, 1, 1000)
    assert t.violations == 1
    assert t.step(1499, 1, 1000)[0] is False and t.step(1500, 1, 1000)[0] is True
    assert t.violations == 1
    t.step(999_999, 1, 1000)
    assert t.violations == 0  # once, however many windows passed


def test_simple_needs_more_than_the_window():
    s = Simple()
    assert [s.step(n, 1, 1000) for n in (0, 1000, 1001)] == [True, False, True]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=60), st.integers(1, 4), st.integers(1, 100))
def test_throttle_equals_plain_words(gaps, most, window):
    now, count, reset, bad = 0, 0, None, 0
    t = Throttle()
    for g in gaps:
        now += g
        if reset is None or now >= reset:
            bad = bad if reset is None else max(0, bad - 1)
            count, reset = 0, now + window
        ok = count < most
        count, bad = (count + 1, bad) if ok else (count, bad + 1)
        assert t.step(now, most, window)[0] is ok
        assert (t.count, t.reset, t.violations) == (count, reset, bad)


def test_gate_spends_budgets_in_order():
    g = Gate({"connection": (2, 1000), "auth": (1, 1000)}, most_open=9)
    ok = dict(origin_ok=True, token_ok=True, vault_ok=True, user_ok=True)
    assert g.connect(0, "a", **(ok | {"origin_ok": False})) == "origin"
    assert "auth" not in g.rates  # not spent
    assert g.connect(0, "a", **(ok | {"token_ok": False})) == "token"
    assert g.connect(0, "a", **ok) == "connection_rate"  # spent by the two rejected ones
    assert g.connect(1000, "a", **ok) is None
    assert g.open == 1 and g.close("a") and not g.close("a") and g.open == 0


def test_gate_counts_open_connections():
    g = Gate({"connection": (99, 1000), "auth": (99, 1000)}, most_open=1)
    ok = dict(origin_ok=True, token_ok=True, vault_ok=True, user_ok=True)
    assert g.connect(0, "a", **ok) is None and g.connect(0, "b", **ok) == "ip_limit"
    g.close("a")
    assert g.connect(0, "b", **(ok | {"vault_ok": False})) == "vault_id" and g.open == 0


def test_replica_stops_at_a_rename_without_target():
    r = Replica()
    steps = [("create", "a", None, "x"), ("create", "a", None, "y"), ("modify", "a", None, None), ("rename", "a", "b", None), ("rename", "b", None, None), ("delete", "b", None, None)]
    assert [r.step(*s) for s in steps] == ["applied", "skipped", "skipped", "applied", "failed", "left"]
    assert r.files == {"b": "x"} and r.origin == {"b": ("a", 1)}


def test_replica_fails_on_a_taken_target_and_clears_folders():
    r = Replica()
    for p in ("d/a", "d/b", "e"):
        r.step("create", p, None, None)
    assert r.step("createFolder", "d", None, None) == "applied"
    assert r.step("deleteFolder", "d", None, None) == "applied" and list(r.files) == ["e"]
    r.step("create", "f", None, None)
    assert r.step("move", "e", "f", None) == "failed"


def test_session_expires_strictly():
    s = Session()
    assert s.step(0, "connect", 10) is None and s.step(10, "message", 10) is None
    assert s.step(21, "message", 10) == (0, 10, 20, "expired")
    assert s.step(22, "disconnect", 10) == (21, 21, 22, "closed") and s.step(23, "disconnect", 10) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 4), st.integers(1, 50))
def test_simple_equals_plain_words(gaps, most, window):
    now, starts, s = 0, [], Simple()
    for g in gaps:
        now += g
        if not starts or now - starts[0] > window:
            starts, ok = [now], True
        else:
            ok = len(starts) < most
            starts += [now] if ok else []
        assert s.step(now, most, window) is ok


EVENTS = st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["connect", "message", "disconnect"]), st.sampled_from("abc"), st.lists(st.booleans(), min_size=4, max_size=4), st.sampled_from([True, True, False, None])), max_size=60)


@settings(max_examples=120, deadline=None)
@given(EVENTS, st.sampled_from([None, 40]))
def test_gate_equals_plain_words(events, idle):
    g, limits = Gate({"connection": (3, 50), "auth": (2, 60), "message": (2, 25)}, 2, idle=idle, after_reset=None), {"connection": (3, 50), "auth": (2, 60), "message": (2, 25)}
    now, open_, live, windows = 0, 0, {}, {}

    def spend(name, who):
        most, width = limits[name]
        n, end = windows.get((name, who), (0, None))
        n, end = (0, now + width) if end is None or now >= end else (n, end)
        windows[name, who] = (min(most, n + 1), end)
        return n < most

    def leave(c):
        nonlocal open_
        if live.pop(c, None) is not None:
            windows.pop(("message", c), None)
            open_ = max(0, open_ - 1)
            return True
        return False

    for gap, kind, c, oks, size in events:
        now += gap
        for x in [x for x, last in live.items() if idle is not None and now - last > idle]:
            leave(x)
        if kind == "disconnect":
            assert g.close(c, now) is leave(c)
        elif kind == "message":
            want = "no_session" if c not in live else "internal" if size is None else "too_large" if not size else None if spend("message", c) else "message_rate"
            if want in ("internal", "too_large"):
                leave(c)
            elif want is None:
                live[c] = now
            assert g.message(now, c, size) == want
        else:
            if open_ >= 2:
                want = "ip_limit"
            elif not spend("connection", ""):
                want = "connection_rate"
            elif not oks[0]:
                want = "origin"
            elif not spend("auth", ""):
                want = "auth_rate"
            else:
                want = next((name for ok, name in zip(oks[1:], ("token", "vault_id", "user_id")) if not ok), None)
            if want is None:
                windows.pop(("message", c), None)
                live[c], open_ = now, open_ + 1
            assert g.connect(now, c, *oks) == want
        assert g.open == open_ and set(g.sessions) == set(live)


def test_gate_closes_sessions_that_send_too_much():
    g = Gate({"connection": (99, 1000), "auth": (99, 1000), "message": (1, 1000)}, most_open=1, idle=5000, after_reset=3000)
    ok = dict(origin_ok=True, token_ok=True, vault_ok=True, user_ok=True)
    assert g.message(0, "a", True) == "no_session" and g.connect(0, "a", **ok) is None
    assert [g.message(n, "a", True) for n in (1, 2)] == [None, "message_rate"]
    assert g.connect(3, "b", **ok) == "ip_limit"
    assert g.message(4, "a", False) == "too_large" and g.connect(5, "b", **ok) is None  # the slot is free
    assert g.message(6, "b", None) == "internal" and g.open == 0
    assert g.connect(7, "c", **ok) is None and g.connect(5007, "d", **ok) == "ip_limit" and g.connect(5008, "d", **ok) is None
    assert g.next_end() == min(5008 + 5000, 7 + 1000 + 3000 if "connection" not in g.rates else g.rates["connection"].reset + 3000)
    assert not g.expire(9000) and g.expire(20_000) and g.next_end() == float("inf")


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["create", "createFolder", "rename", "move", "delete", "deleteFolder", "modify"]), st.sampled_from(["a", "b", "d", "d/a", "d/e/b"]), st.sampled_from(["a", "c", "d", "d/a", None, ""])), max_size=40))
def test_replica_equals_plain_words(steps):
    r, files, folders, stuck = Replica(), {}, set(), False
    for n, (kind, path, new) in enumerate(steps):
        before, got = dict(files), r.step(kind, path, new, f"t{n}")
        if stuck:
            want = "left"
        elif kind in ("rename", "move"):
            taken = new != path and (new in files or new in folders)
            want = "failed" if not new or path in files and taken else "applied" if path in files else "skipped"
            stuck = want == "failed"
            if want == "applied":
                text, first, hops = files.pop(path)
                files[new] = (text, first, hops + 1)
        else:
            want = "skipped"
            if kind == "create" and path not in files and path not in folders:
                files[path], want = (f"t{n}", path, 0), "applied"
            elif kind == "createFolder" and path not in files and path not in folders:
                want = folders.add(path) or "applied"
            elif kind in ("delete", "deleteFolder") and path in files:
                want = files.pop(path) and "applied"
            elif kind == "deleteFolder" and path in folders:
                inside = lambda x: (x + "/").startswith(path + "/")  # noqa: B023, E731
                files, folders, want = {f: v for f, v in files.items() if not inside(f)}, {f for f in folders if not inside(f)}, "applied"
        assert got == want and r.blocked == stuck
        assert {f: (t, *r.origin[f]) for f, t in r.files.items()} == files and r.folders == folders
        if not (kind in ("rename", "move") and new == path):
            assert {a for a, _ in r.moved if a} == set(before) - set(files) and {b for _, b in r.moved if b} == set(files) - set(before)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.sampled_from(["connect", "message", "disconnect"])), max_size=40), st.integers(1, 20))
def test_session_equals_plain_words(events, idle):
    now, run, want, got, s = 0, [], [], [], Session()
    for gap, kind in events:
        now += gap
        if run and now - run[-1] > idle:
            want.append((run[0], run[-1], run[-1] + idle, "expired"))
            run = []
        if kind != "disconnect":
            run.append(now)
        elif run:
            want.append((run[0], run[-1], now, "closed"))
            run = []
        got += [x] if (x := s.step(now, kind, idle)) else []
    assert got == want


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["op", "op", "connected", "disconnected", "connecting", "syncing"]), st.sampled_from("vw"), st.sampled_from(["create", "rename", "move"]), st.sampled_from([None, "", "x"]), st.integers(0, 15)), max_size=50))
def test_outbox_equals_plain_words(events):
    box, now, online, waiting, bad, seen = Outbox(remember=20), 0, False, [], set(), {}
    for gap, what, vault, kind, new, key in events:
        now += gap
        if what == "op":
            got = box.operation(now, vault, key, kind, new)
            if key in seen and now - seen[key] <= 20:
                assert got is None
                continue
            seen[key] = now
            assert got == ((vault, key, now, "direct", "applied", now) if online else None)
            waiting += [] if online else [(vault, key, now, kind in ("rename", "move") and not new)]
            continue
        rows, back = set(box.status(now, what)), what == "connected" and not online
        online = what == "connected" if what != "syncing" else online
        want = set()
        for v, k, at, fails in waiting if back else []:
            want.add((v, k, at, "queued", "left" if v in bad else "failed" if fails else "applied", now))
            bad |= {v} if fails else set()
        waiting = [] if back else waiting
        assert rows == want
    assert box.forget(now + 100) is not (online or bool(waiting) or bool(bad))


def test_presence_ends_strictly():
    p = Presence(ttl=10, last=5)
    assert p.lapse(15) is None and p.lapse(16) == 15 and p.lapse(99) is None
    assert Presence(None, 5).lapse(10**9) is None


def test_throttle_forgets_strictly():
    t = Throttle()
    for now in (0, 0, 0):
        t.step(now, 1, 100, 50)
    assert t.violations == 2 and not t.forget(150, 50) and not t.forget(10**9, None)
    assert t.step(151, 1, 100, 50) == (True, 0, None) and t.violations == 0


def test_hot_key_and_empty_input(spark):
    rows = spark.range(3000).select(F.lit("one").alias("ip"), (F.col("id") * 7 % 3000).alias("ms"), F.col("id").alias("event_id"))
    out = admission.rate_limit(rows, "ip", 5, 100)
    t, want = Throttle(), []
    for ms in sorted(r.ms for r in rows.collect()):
        want.append(t.step(ms, 5, 100)[0])
    assert [r.allowed for r in out.orderBy("ms").collect()] == want
    assert admission.rate_limit(rows.limit(0), "ip", 5, 100).count() == 0


def test_replay_of_one_queue(spark):
    rows = [(1, 0, 0, "create", "a", None, "t"), (2, 1, 1, "rename", "a", "b", None), (3, 1, 2, "rename", "b", "c", None), (4, 2, 3, "rename", "c", None, None), (5, 3, 4, "delete", "c", None, None)]
    ops = spark.createDataFrame([("v", "u", *r) for r in rows], "vault_id string, user_id string, id long, ms long, seq long, type string, path string, new_path string, content string")
    out = oplog.replay_ops(ops).collect()
    assert [(r.path, r.text, r.first_path, r.hops, r.blocked) for r in out] == [("c", "t", "a", 2, True)]


def test_rename_onto_a_folder_fails():
    from inkmesh.functions.folds import Replica

    s = Replica()
    assert [s.step("create", "a", None, "x"), s.step("createFolder", "f", None, None), s.step("rename", "a", "f", None), s.step("create", "b", None, None)] == ["applied", "applied", "failed", "left"]


def test_rename_chains_of_one_queue(spark):
    rows = [("create", "a", None), ("rename", "a", "b"), ("create", "a", None), ("rename", "b", "b"), ("move", "b", "c"), ("rename", "a", "d/x"), ("createFolder", "d", None), ("create", "e", None), ("rename", "e", "d/y"), ("deleteFolder", "d", None), ("create", "d/x", None), ("rename", "d/x", "f")]
    rows += [("rename", "f" if k == 0 else f"g{k - 1}", f"g{k}") for k in range(102)]  # more than a query's usual number of steps
    ops = spark.createDataFrame([("v", "u", k, k // 2, k, t, p, n, None) for k, (t, p, n) in enumerate(rows)], "vault_id string, user_id string, id long, ms long, seq long, type string, path string, new_path string, content string")
    found = oplog.rename_chains(oplog.file_moves(ops))
    assert {(r.first_path, r.final_path, r.hops) for r in found.collect()} == {("a", "c", 3), ("d/x", "g101", 103)}
    replayed = oplog.replay_ops(ops).filter("hops > 0")
    assert {(r.first_path, r.path, r.hops) for r in replayed.collect()} == {(r.first_path, r.final_path, r.hops) for r in found.collect()}
    assert oplog.rename_chains(oplog.file_moves(ops.limit(0))).count() == 0
