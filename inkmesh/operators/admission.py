"""A1 to A10: throttling and admission over connection logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.folds import Gate, Simple, Throttle
from ..sources import schemas
from ..sources.scratch import written
from .folding import keyed_fold
from .split import split_rate_limit

#: Fixed values in milliseconds: idle time after which a session ends, and time after its window at which a rate is forgotten.
IDLE, AFTER_RESET = 24 * 3600_000, 3600_000
RATE = "{key} string, ms long, event_id long, allowed boolean, remaining long, retry_after long, violations long, reset_ms long"


def rate_limit(df: DataFrame, key: str, most: int | None = None, window: int | None = None, after_reset: int | None = None, hot: int | None = None) -> DataFrame:
    """A1: each request's decision. ``most`` and ``window`` may be columns of those names instead (A2). With ``after_reset``, a record
    that is past its window by more than that is forgotten. Keys with more than ``hot`` requests, if that is given, are cut into
    spans that many tasks fold (see ``split``); they are counted first."""
    per_row = most is None
    if hot is not None and not per_row:
        crowded = written(df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("_hot"), "hot")
        own = lambda how: df.join(crowded, F.col(key).eqNullSafe(F.col("_hot")), how)
        rest = rate_limit(own("left_anti"), key, most, window, after_reset)
        return rest.unionByName(split_rate_limit(own("left_semi"), key, most, window, after_reset, RATE.format(key=key)))

    def step(s: Throttle, r: dict) -> tuple:
        n, w = (r["most"], r["window"]) if per_row else (most, window)
        allowed, remaining, wait = s.step(r["ms"], n, w, after_reset)
        return (r[key], r["ms"], r["event_id"], allowed, remaining, wait, s.violations, s.reset)

    fields = ["ms", "event_id", *(["most", "window"] if per_row else [])]
    return keyed_fold(df, [key], ["ms", "event_id", *(["nth"] if per_row else [])], Throttle, step, fields, RATE.format(key=key))


def classed_requests(log: DataFrame, limits: DataFrame) -> DataFrame:
    """The budgets that each row draws on: connections and log-ins by IP, messages by connection; the limits table has
    one row per class, so it is broadcast."""
    is_connect, is_message = F.col("kind") == "connect", F.col("kind") == "message"
    draw = lambda cond, cls, who, nth: F.when(cond, F.struct(F.lit(cls).alias("class"), F.col(who).alias("who"), F.lit(nth).alias("nth")))
    draws = F.array_compact(F.array(draw(is_connect, "connection", "ip", 0), draw(is_connect & (F.col("token") != ""), "auth", "ip", 1), draw(is_message, "message", "connection_id", 2), draw(~is_connect & ~is_message, "default", "ip", 3)))
    rows = log.select("event_id", "ms", F.explode(draws).alias("d")).select("event_id", "ms", "d.*")
    known = rows.join(F.broadcast(limits), "class")
    return known.withColumn("record", F.concat_ws(":", "map", "who"))


def rate_limit_classes(log: DataFrame, limits: DataFrame) -> DataFrame:
    """A2: classes that share a map share the record of an identifier."""

    def step(s: Throttle, r: dict) -> tuple:
        allowed, _, _ = s.step(r["ms"], r["most"], r["window"])
        return (r["record"], r["event_id"], r["class"], allowed, s.violations)

    return keyed_fold(classed_requests(log, limits), ["record"], ["ms", "event_id", "nth"], Throttle, step, ["ms", "event_id", "class", "most", "window"], "record string, event_id long, class string, allowed boolean, violations long")


def rate_limit_simple(df: DataFrame, key: str, most: int, window: int) -> DataFrame:
    """A3."""

    def step(s: Simple, r: dict) -> tuple:
        return (r[key], r["ms"], r["event_id"], s.step(r["ms"], most, window))

    return keyed_fold(df, [key], ["ms", "event_id"], Simple, step, ["ms", "event_id"], f"{key} string, ms long, event_id long, allowed boolean")


def message_budget(log: DataFrame, most: int, window: int) -> DataFrame:
    """A4: messages of both directions draw on one budget per connection."""
    return rate_limit(log.filter("kind = 'message' and direction is not null"), "connection_id", most, window)


def ip_connection_limit(log: DataFrame, most_open: int) -> DataFrame:
    """A5: connections of an IP that are open before each row, and whether the row is admitted."""

    def step(s: list, r: dict) -> tuple:
        before = s[0]
        ok = r["kind"] != "connect" or before < most_open
        s[0] = before + 1 if r["kind"] == "connect" and ok else max(0, before - 1) if r["kind"] == "disconnect" else before
        return (r["ip"], r["event_id"], r["kind"], ok, s[0])

    return keyed_fold(log.filter("kind in ('connect', 'disconnect')"), ["ip"], ["ms", "event_id"], lambda: [0], step, ["ms", "event_id", "kind"], "ip string, event_id long, kind string, admitted boolean, open long")


def flags(log: DataFrame, expected_token: str, allowed_origins: list[str] | None = None) -> DataFrame:
    """The stateless checks as columns, computed before any fold."""
    return log.withColumns({
        "origin_ok": rules.origin_ok(F.col("origin"), allowed_origins),
        "token_ok": rules.token_ok(F.col("token"), F.lit(expected_token)),
        "vault_ok": rules.vault_id(F.col("vault_id")).isNotNull(),
        "user_ok": rules.user_id(F.col("user_id")).isNotNull(),
        "size_ok": F.coalesce(F.col("msg_bytes"), F.lit(0)) <= schemas.MAX_MESSAGE,
        "readable": F.col("msg_bytes").isNotNull(),
    })


#: Columns that the admission fold reads, and its rows.
GATE = ["ms", "event_id", "kind", "connection_id", "origin_ok", "token_ok", "vault_ok", "user_ok", "size_ok", "readable"]
DECISIONS = "ip string, event_id long, ms long, decision string, reason string, close_code long, open long"
_CODES = {"too_large": schemas.TOO_LARGE, "internal": schemas.INTERNAL}


def decide(s: Gate, r: dict) -> tuple:
    """One event at the gate. Connects are admitted or rejected; messages pass, are throttled, or close their session; messages
    of connections without a session are dropped."""
    row = lambda decision, why=None, code=None: (r["ip"], r["event_id"], r["ms"], decision, why, code, s.open)
    if r["kind"] == "disconnect":
        return row("close", None) if s.close(r["connection_id"], r["ms"]) else row("close", "no_session")
    if r["kind"] == "connect":
        why = s.connect(r["ms"], r["connection_id"], r["origin_ok"], r["token_ok"], r["vault_ok"], r["user_ok"])
        return row("reject", why, schemas.POLICY) if why else row("admit")
    why = s.message(r["ms"], r["connection_id"], r["size_ok"] if r["readable"] else None)
    return row({None: "pass", "no_session": "drop", "message_rate": "throttle"}.get(why, "close"), why, _CODES.get(why))


def admission(log: DataFrame, limits: dict[str, tuple[int, int]], most_open: int, expected_token: str = "secret-1", allowed_origins: list[str] | None = None, idle: int | None = IDLE, after_reset: int | None = AFTER_RESET) -> DataFrame:
    """One fold by IP, as every stateful check is keyed by it. Connects get a decision, closes end sessions, and so do messages
    that are too large (1009) or cannot be read (1011: their size is null). A session that is idle for more than ``idle`` ends."""
    rows = flags(log, expected_token, allowed_origins).filter("kind in ('connect', 'disconnect', 'message')")
    return keyed_fold(rows, ["ip"], ["ms", "event_id"], lambda: Gate(limits, most_open, idle=idle, after_reset=after_reset), decide, GATE, DECISIONS)


def rejections_by_reason(decided: DataFrame) -> DataFrame:
    """Rejects for each reason and IP, and over all of either (null)."""
    return decided.filter("decision = 'reject'").cube("reason", "ip").agg(F.count(F.lit(1)).alias("rejects"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def top_offenders(limited: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The keys with the most violations and the longest advised wait."""
    each = limited.groupBy(key).agg(F.max("violations").alias("violations"), F.max("retry_after").alias("retry_after"), F.count_if(~F.col("allowed")).alias("rejects"))
    return each.orderBy(F.desc("violations"), F.desc_nulls_last("retry_after"), F.desc("rejects"), key).limit(n)


def throttle_hits(log: DataFrame, limited: DataFrame) -> DataFrame:
    """Throttled and allowed messages by direction."""
    joined = log.select("event_id", "direction").join(limited.select("event_id", "allowed"), "event_id")
    return joined.groupBy("direction").agg(F.count_if(~F.col("allowed")).alias("hits"), F.count_if("allowed").alias("allowed"))


def state_expiry(sessions: DataFrame, limited: DataFrame, key: str, as_of: Column, idle: int = IDLE, after_reset: int = AFTER_RESET) -> DataFrame:
    """A10: open sessions idle for longer than ``idle`` and throttle records past their window by more than ``after_reset``."""
    kept = sessions.filter("is_open").select(F.lit("session").alias("kind"), F.col("connection_id").alias("id"), (as_of - F.col("last_ms") > idle).alias("expired"))
    last = limited.groupBy(key).agg(F.max("reset_ms").alias("reset_ms"))
    return kept.unionByName(last.select(F.lit("throttle").alias("kind"), F.col(key).alias("id"), (as_of - F.col("reset_ms") > after_reset).alias("expired")))


def limits_frame(spark, limits: dict[str, tuple[int, int, str]] = schemas.LIMITS) -> DataFrame:
    """The four limits as a table of fixed size."""
    return spark.createDataFrame([(c, n, w, m) for c, (n, w, m) in limits.items()], "class string, most long, window long, map string")
