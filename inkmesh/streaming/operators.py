"""T1 to T7 and S7 as streaming frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import Gate, Outbox, Presence, Session, Throttle
from ..operators.admission import AFTER_RESET, DECISIONS, GATE, IDLE, RATE, decide, flags
from ..operators.folding import keyed_fold
from .ordered import ALWAYS, ordered_fold

DAY = 24 * 3600_000
ENDED = "connection_id string, created_ms long, last_ms long, ended_ms long, how string, event_id long, ms long"


def stream_rate_limit(log: DataFrame, key: str, most: int, window: int, delay: str = "1 hour", after_reset: int | None = AFTER_RESET, late: bool = False) -> DataFrame:
    """T1, the throttle alone; a record leaves the state ``after_reset`` its window. ``late`` as in ``ordered_fold``."""

    def step(s: Throttle, r: dict) -> tuple:
        allowed, remaining, wait = s.step(r["ms"], most, window, after_reset)
        return (r[key], r["ms"], r["event_id"], allowed, remaining, wait, s.violations, s.reset)

    def lapse(s: Throttle, key: dict, mark: int) -> list[tuple]:
        s.forget(mark + 1, after_reset)  # rows to come are later than the watermark
        return []

    wake = lambda s: None if s.reset is None else ALWAYS if after_reset is None else s.reset + after_reset
    return ordered_fold(log, [key], ["ms", "event_id"], Throttle, step, ["ms", "event_id"], RATE.format(key=key), delay, lapse, wake, late)


def stream_admission(log: DataFrame, limits: dict[str, tuple[int, int]], most_open: int, expected_token: str = "secret-1", delay: str = "1 hour", idle: int | None = IDLE, after_reset: int | None = AFTER_RESET, late: bool = False) -> DataFrame:
    """The whole admission, by IP; sessions and rates leave the state as in batch."""

    def lapse(s: Gate, key: dict, mark: int) -> list[tuple]:
        s.expire(mark + 1)
        return []

    wake = lambda s: s.next_end() if s.sessions or s.open or s.rates else None
    rows = flags(log, expected_token).filter("kind in ('connect', 'disconnect', 'message')")
    return ordered_fold(rows, ["ip"], ["ms", "event_id"], lambda: Gate(limits, most_open, idle=idle, after_reset=after_reset), decide, GATE, DECISIONS, delay, lapse, wake, late)


def _row(connection: str, ended: tuple[int, int, int, str] | None, event_id: int | None) -> tuple | None:
    """An expiry belongs to no event, whatever brings it to light."""
    return None if ended is None else (connection, *ended, event_id if ended[3] == "closed" else None, ended[2])


def _end(idle: int) -> Callable[[Session, dict], tuple | None]:
    def step(s: Session, r: dict) -> tuple | None:
        s.as_of = r.get("as_of", 0)
        return _row(r["connection_id"], s.step(r["ms"], r["kind"], idle), r["event_id"])

    return step


def ended_sessions(log: DataFrame, idle: int = DAY) -> DataFrame:
    """The batch form of T2, as of the latest event of the log."""

    def finish(s: Session, key: tuple) -> list[tuple]:
        row = _row(key[0], s.lapse(s.as_of, idle), None)
        return [row] if row else []

    rows = log.withColumn("as_of", log.agg(F.max("ms")).scalar())
    return keyed_fold(rows, ["connection_id"], ["ms", "event_id"], Session, _end(idle), ["ms", "event_id", "kind", "as_of"], ENDED, finish)


def stream_sessions(log: DataFrame, idle: int = DAY, delay: str = "1 hour") -> DataFrame:
    """Sessions that end, by close or after a day without activity; a timer ends those that no event ends."""
    lapse = lambda s, key, mark: [row] if (row := _row(key["connection_id"], s.lapse(mark - 2, idle), None)) else []
    wake = lambda s: None if s.created is None else s.last + idle + 3
    return ordered_fold(log, ["connection_id"], ["ms", "event_id"], Session, _end(idle), ["ms", "event_id", "kind"], ENDED, delay, lapse, wake)


def stream_debounce(events: DataFrame, key: str, quiet_ms: int, delay: str = "1 hour") -> DataFrame:
    """The last event of each run with gaps under ``quiet_ms``; a gap of exactly that splits, so the window's is a
    microsecond shorter."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    runs = rows.groupBy(key, F.session_window("ts", f"{quiet_ms * 1000 - 1} microseconds")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return runs.select(key, "event_id")


def stream_presence(presence: DataFrame, delay: str = "1 hour", ttl: int | None = None) -> DataFrame:
    """T4: each change of a client's state in order; null states remove. A client without a sign for more than ``ttl`` is removed at
    that time by a row without ``seq``, and leaves the state."""

    def step(s: Presence, r: dict) -> tuple:
        s.last = None if r["is_null"] else r["ms"]
        now = (None, None, None) if r["is_null"] else (r["vault_id"], r["name"], r["current_file"])
        return (r["client_id"], r["ms"], r["seq"], *now, bool(r["is_null"]))

    def lapse(s: Presence, key: dict, mark: int) -> list[tuple]:
        gone = s.lapse(mark - 2)
        return [] if gone is None else [(key["client_id"], gone, None, None, None, None, True)]

    wake = lambda s: None if s.last is None or ttl is None else s.last + ttl + 3
    return ordered_fold(presence, ["client_id"], ["ms", "seq"], lambda: Presence(ttl), step, ["ms", "seq", "vault_id", "name", "current_file", "is_null"], "client_id string, ms long, seq long, vault_id string, name string, current_file string, removed boolean", delay, lapse, wake)


def stream_status(log: DataFrame) -> DataFrame:
    """Running totals by vault and kind."""
    return log.groupBy("vault_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("msg_bytes").alias("bytes"))


def status_sinks(batch: DataFrame, number: int, out: str) -> None:
    """Three tables, each written anew at a trigger: totals, kinds, vaults."""
    batch.persist()
    panel = lambda name, by: batch.groupBy(F.lit(name).alias("panel"), by.alias("item")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    for name, by in (("totals", F.lit("all")), ("kinds", F.col("kind")), ("vaults", F.col("vault_id"))):
        panel(name, by).write.mode("overwrite").parquet(f"{out}/table={name}")
    batch.unpersist()


def stream_ops(ops: DataFrame, changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Operations and status changes of clients in one stream; see ``Outbox``. A change goes before an operation of its time.
    A client that is offline and has nothing queued leaves the state."""
    o = ops.select("user_id", "ms", F.lit(1).alias("side"), "seq", "vault_id", "id", "type", "new_path", F.lit(None).cast("string").alias("status"))
    none = {c: F.lit(None).cast(t) for c, t in o.dtypes}
    c = changes.select(F.col("client_id").alias("user_id"), "ms", F.lit(0).alias("side"), F.col("event_id").alias("seq"), *[none[x].alias(x) for x in ("vault_id", "id", "type", "new_path")], "status")

    def step(s: Outbox, r: dict) -> list[tuple]:
        if r["side"] == 0:
            return [(vault, r["user_id"], *rest) for vault, *rest in s.status(r["ms"], r["status"])]
        row = s.operation(r["ms"], r["vault_id"], r["id"], r["type"], r["new_path"])
        return [] if row is None else [(row[0], r["user_id"], *row[1:])]

    def lapse(s: Outbox, key: dict, mark: int) -> list[tuple]:
        s.forget(mark + 1)
        return []

    def wake(s: Outbox) -> float | None:
        ends = min(s.seen.values(), default=None)
        return ends + s.remember if ends is not None else ALWAYS if s.online or s.held or s.stopped else None

    return ordered_fold(o.unionByName(c), ["user_id"], ["ms", "side", "seq"], Outbox, step, ["ms", "side", "seq", "vault_id", "id", "type", "new_path", "status"], "vault_id string, user_id string, id long, ms long, route string, outcome string, at_ms long", delay, lapse, wake, many=True)


def ticking(stream: DataFrame, each: Callable[[DataFrame, int, str], None], out: str, log: str, seconds: int = 2, mode: str = "complete"):
    """A live status writer: ``each`` at every tick, until it is stopped."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(processingTime=f"{seconds} seconds").foreachBatch(lambda df, n: each(df, n, out)).start()
