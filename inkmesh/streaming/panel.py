"""The sessions panel, a table by connection that a stream keeps up to date.

A fold turns the log into the changed session after each event. Each tick writes the sessions that changed, once each, to a
folder of its own; a reader takes the latest row of each connection. Every ``MERGE`` ticks the folders become one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.folds import Throttle
from .ordered import ALWAYS, ordered_fold

MERGE = 10
SESSION = "connection_id string, vault_id string, user_id string, ip string, created_ms long, last_ms long, closed_ms long, is_open boolean, ms long, event_id long"


@dataclass
class Connection:
    """A connection as its events come in order; only connects and messages within the budget are activity."""

    seen: bool = False
    vault: str | None = None
    user: str | None = None
    ip: str | None = None
    created: int | None = None
    last: int | None = None
    closed: int | None = None
    open: bool = False
    latest: int = 0
    budget: Throttle = field(default_factory=Throttle)

    def step(self, now: int, kind: str, vault: str | None, user: str | None, ip: str, counted: bool, most: int, window: int) -> None:
        if not self.seen:
            self.seen, self.user, self.ip, self.created = True, user, ip, now
        self.vault, self.open, self.latest = self.vault or vault, kind != "disconnect", now
        if kind == "disconnect":
            self.closed = now
        elif kind == "connect" or kind == "message" and counted and self.budget.step(now, most, window)[0]:
            self.last = now


def stream_session_changes(log: DataFrame, most: int, window: int, delay: str = "10 seconds", idle: int | None = None) -> DataFrame:
    """The session of a connection after each of its events. With ``idle``, a connection leaves the state when it has been silent
    for longer; what comes later is a new session."""

    def step(s: Connection, r: dict) -> tuple:
        s.step(r["ms"], r["kind"], r["valid_vault"], r["valid_user"], r["ip"], r["counted"], most, window)
        return (r["connection_id"], s.vault, s.user, s.ip, s.created, s.created if s.last is None else s.last, s.closed, s.open, r["ms"], r["event_id"])

    def lapse(s: Connection, key: dict, mark: int) -> list[tuple]:
        s.seen = s.seen and not (idle is not None and mark + 1 - s.latest > idle)
        return []

    wake = lambda s: None if not s.seen else ALWAYS if idle is None else s.latest + idle
    rows = log.withColumns({"valid_vault": rules.vault_id(F.col("vault_id")), "valid_user": rules.user_id(F.col("user_id")), "counted": F.col("direction").isNotNull()})
    return ordered_fold(rows, ["connection_id"], ["ms", "event_id"], Connection, step, ["ms", "event_id", "kind", "valid_vault", "valid_user", "ip", "counted"], SESSION, delay, lapse, wake)


def _latest(rows: DataFrame, *order: str) -> DataFrame:
    own = [c for c in rows.columns if c not in ("tick", "connection_id")]
    return rows.groupBy("connection_id").agg(F.max_by(F.struct(*own), F.struct(*order)).alias("s")).select("connection_id", "s.*")


def _folder(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _ticks(spark: SparkSession, out: str) -> list[int]:
    """The numbers of the folders that are complete."""
    store, path = _folder(spark, out)
    found = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    return sorted(int(n.partition("=")[2]) for n in found if n.startswith("tick=") and store.exists(_folder(spark, f"{out}/{n}/_SUCCESS")[1]))


def panel(spark: SparkSession, out: str) -> DataFrame:
    """The sessions as of the last tick."""
    rows = spark.read.schema(SESSION).parquet(*[f"{out}/tick={n}" for n in _ticks(spark, out)])
    return _latest(rows, "ms", "event_id").drop("ms", "event_id")


def upsert(batch: DataFrame, number: int, out: str) -> None:
    """Writes the sessions that a batch changed. A batch that is run again writes the same folder again; folders are merged into
    the latest of them before, and one that is merged twice says the same twice."""
    spark = batch.sparkSession
    _latest(batch, "ms", "event_id").write.mode("overwrite").parquet(f"{out}/tick={2 * number + 1}")
    old = [n for n in _ticks(spark, out) if n < 2 * number]
    if len(old) >= MERGE:
        rows = spark.read.schema(SESSION).parquet(*[f"{out}/tick={n}" for n in old])
        _latest(rows, "ms", "event_id").write.mode("overwrite").parquet(f"{out}/tick={2 * number}")
        for n in old:
            store, path = _folder(spark, f"{out}/tick={n}")
            store.delete(path, True)
