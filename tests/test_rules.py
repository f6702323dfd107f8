"""Published vectors of the rules, and strict thresholds."""

import pytest
from pyspark.sql import functions as F

from inkmesh.functions import rules
from inkmesh.operators import content, reconcile, sessions
from inkmesh.sources import io


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("valid-vault-123", "valid-vault-123"), ("a" * 200, None), ("<b>x</b>", None), ("abc\n", None), ("", None), (None, None)])
def test_vault_id(spark, given, want):
    assert one(spark, rules.vault_id(F.col("v")), v=given) == want


@pytest.mark.parametrize(("given", "want"), [("user@example.com", "user@example.com"), ("<i>", None), ('a "b"', None), ("", "anonymous"), (None, "anonymous"), ("a" * 65, None)])
def test_user_id(spark, given, want):
    assert one(spark, rules.user_id(F.col("v")), v=given) == want


@pytest.mark.parametrize(("a", "b", "want"), [("t-1", "t-1", True), ("t-1", "t-2", False), ("a b", "a b", False), (None, "x", False), ("x" * 257, "x" * 257, False)])
def test_token(spark, a, b, want):
    assert one(spark, rules.token_ok(F.col("a"), F.col("b")), a=a, b=b) is want


@pytest.mark.parametrize(("header", "url", "want"), [("t-1", "t-2", True), ("t-2", "t-1", False), ("Bearer t-1", "t-1", False), ("", "t-1", True), (None, "t-1", True), (None, None, False)])
def test_header_wins_over_url_token(spark, header, url, want):
    assert one(spark, rules.token_ok(rules.given_token(F.col("h"), F.col("u")), F.lit("t-1")), h=header, u=url) is want


@pytest.mark.parametrize(("given", "want"), [("../../../etc/passwd", None), ("a/./b//c", "/safe/directory/a/b/c"), ("x/../y", "/safe/directory/y"), ("/safe/directory", "/safe/directory"), ("/safe/directoryx", None), ("a b", None), ("..", None)])
def test_safe_path(spark, given, want):
    assert one(spark, rules.safe_path(F.col("v"), "/safe/directory"), v=given) == want


@pytest.mark.parametrize(("given", "want"), [("short", True), ("x" * (1 << 20), True), ("x" * ((1 << 20) + 1), False), ("é" * (1 << 19) + "x", False), (None, True), ("", True)])
def test_message_size(spark, given, want):
    assert one(spark, rules.size_ok(F.col("v")), v=given) is want


@pytest.mark.parametrize(("given", "want"), [("http://localhost:3000", True), ("https://127.0.0.1", True), ("http://localhost:3000\n", False), ("http://localhost.evil", False), ("", False), (None, False)])
def test_origin(spark, given, want):
    assert one(spark, rules.origin_ok(F.col("v")), v=given) is want


@pytest.mark.parametrize(("given", "want"), [("failed at /srv/data/x.js", "failed at [PATH]"), ("from 10.1.2.3 now", "from [IP] now"), ("key abcdefghij0123456789", "key [TOKEN]"), ("token abc123def456", "token abc123def456"), ("see /a/10.0.0.1/b", "see [PATH]"), ("", rules.UNKNOWN_ERROR), (None, rules.UNKNOWN_ERROR), ("é" * 300, "é" * 200)])
def test_redaction(spark, given, want):
    assert one(spark, rules.redacted(F.col("v")), v=given) == want


@pytest.mark.parametrize(("given", "want"), [("ws://h", "ws://h"), ("https://h/x", "wss://h/x"), ("http://h", "ws://h"), ("//h", "wss://h"), ("h:1", "wss://h:1"), (None, None)])
def test_endpoint(spark, given, want):
    assert one(spark, rules.endpoint(F.col("v")), v=given) == want


@pytest.mark.parametrize(("a", "b", "want"), [("a\n\nc", "\nb\n", "a\n\nc\nb"), ("a", "b", None), ("", "r", "r"), ("l", "", "l"), ("x\n\n", "\nx\n\ny\ny", "x\n\n\ny"), (None, None, "")])
def test_line_merge(spark, a, b, want):
    assert one(spark, content.line_merge(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("given", "want"), [("a/b.md", "a/b.local-TS.md"), ("noext", ".local-TS.noext"), ("v1.2/x", "v1.local-TS.2/x")])
def test_backup_path(spark, given, want):
    assert one(spark, content.backup_path(F.col("v"), "local", F.lit("TS")), v=given) == want


@pytest.mark.parametrize(("a", "b", "c", "want"), [("1.1.1.1, x", "2.2.2.2", "3.3.3.3", "1.1.1.1, x"), ("", "2.2.2.2", "3.3.3.3", "2.2.2.2"), (None, "", "", "unknown")])
def test_client_ip(spark, a, b, c, want):
    assert one(spark, io.client_ip(F.col("a"), F.col("b"), F.col("c")), a=a, b=b, c=c) == want


def test_ties_keep_the_local_side(spark):
    rows = spark.createDataFrame([("v", "p", "a", "b", 5, 5), ("v", "q", "a", "b", 5, 6)], "vault_id string, path string, local_text string, remote_text string, local_ms long, remote_ms long")
    assert {r.path: (r.text, r.method) for r in content.resolve_auto(rows).collect()} == {"p": ("a", "local"), "q": ("b", "remote")}


@pytest.mark.parametrize(("age", "want"), [(10_000, "suppressed"), (10_001, "push")])
def test_periodic_is_strict(spark, age, want):
    inv = spark.createDataFrame([("v", "local", "a"), ("v", "remote", "b")], "vault_id string, replica string, path string")
    recent = spark.createDataFrame([("v", "local", "create", "a", 100_000 - age)], "vault_id string, replica string, op string, path string, ms long")
    out = {r.path: r.action for r in reconcile.periodic_reconcile(inv, recent, F.lit(100_000)).collect()}
    assert out == {"a": want, "b": "pull"}


def test_debounce_splits_at_exactly_the_quiet_time(spark):
    rows = spark.createDataFrame([("u", 0, 1), ("u", 99, 2), ("u", 199, 3)], "user_id string, ms long, event_id long")
    assert sorted(r.event_id for r in sessions.debounce(rows, "user_id").collect()) == [2, 3]


def test_gauge_never_falls_below_zero(spark):
    kinds = ["disconnect", "connect", "connect", "disconnect", "disconnect", "disconnect", "connect"]
    rows = spark.createDataFrame([("i", k, n, n) for n, k in enumerate(kinds)], "ip string, kind string, ms long, event_id long")
    assert [r.open for r in sessions.connection_gauge(rows, "ip").orderBy("ms").collect()] == [0, 1, 2, 1, 0, 0, 1]


def test_unreadable_queue_is_empty(spark):
    rows = spark.createDataFrame([("v", "[{"), ("v", '[{"id":1,"type":"create","path":"a"}]'), ("v", None)], "vault_id string, queue string")
    assert [(r.id, r.type, r.path) for r in io.read_queue(rows).collect()] == [(1, "create", "a")]


def test_tree_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.md").write_text("x")
    (tmp_path / "y.md").write_text("y")
    assert sorted(r.path for r in io.tree_inventory(spark, str(tmp_path), "v", "local").collect()) == ["d/x.md", "y.md"]
