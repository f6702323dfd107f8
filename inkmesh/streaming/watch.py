"""T5: reconciliation as a state machine of each path.

A path's state is a flag for each side, the last own operations on it, and what was last said about it. Changes set it as
they come; a timer at the next full tick decides, so only paths that differ are ever looked at, and those that wait for the end
of their quiet time once, at the first tick after it. What is said is said once, when it changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reconcile import PERIODIC

#: Fixed value: milliseconds between checks.
TICK = 30_000
SIDES, OWN = ("local", "remote"), ("create", "delete", "rename")


def decide(flags: list[bool], own: list[int], as_of: int, quiet: int) -> tuple[str, int | None]:
    """What to do with a path, and the time up to which that is suppressed. The first time known, creation before rename, counts
    for a push, the deletion for a pull."""
    if flags[0] == flags[1]:
        return "settled", None
    last = (own[0] or own[2]) if flags[0] else own[1]
    if as_of - last > quiet:
        return "push" if flags[0] else "pull", None
    return "suppressed", last + quiet


class Watch(StatefulProcessor):
    def __init__(self, quiet: int, tick: int, live: bool):
        self.quiet, self.tick, self.live = quiet, tick, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "local boolean, remote boolean, local_ms long, remote_ms long, create_ms long, delete_ms long, rename_ms long, said string, timer long")

    def _now(self, times) -> int:
        return times.getCurrentProcessingTimeInMs() if self.live else times.getCurrentWatermarkInMs()

    def _keep(self, flags: list[bool], since: list[int], own: list[int], said: str, at: int | None, timer: int | None) -> None:
        if at is not None and (timer is None or at < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        if any(flags) or timer is not None:
            self.state.update((*flags, *since, *own, said, timer))
        else:
            self.state.clear()

    def _opened(self) -> tuple:
        s = self.state.get()
        return ([False, False], [0, 0], [0, 0, 0], "settled", None) if s is None else (list(s[0:2]), list(s[2:4]), list(s[4:7]), s[7], s[8])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flags, since, own, said, timer = self._opened()
        for batch in rows:
            for replica, present, op, ms in zip(*(batch[c].tolist() for c in ("replica", "present", "op", "ms"))):
                if op is None and replica in SIDES:
                    k = SIDES.index(replica)
                    if ms >= since[k]:
                        flags[k], since[k] = bool(present), ms
                elif op in OWN and replica == "local":
                    own[OWN.index(op)] = max(own[OWN.index(op)], ms)
        now = self._now(timerValues)
        differs = flags[0] != flags[1] or said != "settled"
        last = max(own)  # a path that is nowhere is remembered while its operations are quiet
        at = (now // self.tick + 1) * self.tick if differs or not any(flags) and last and now - last <= self.quiet else None
        self._keep(flags, since, own, said, at, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flags, since, own, said, _ = self._opened()
        now = self._now(timerValues)
        action, until = decide(flags, own, now, self.quiet)
        if not any(flags) and max(own) and now - max(own) <= self.quiet:
            until = max(own) + self.quiet
        self._keep(flags, since, own, action, None if until is None else -(-(until + 1) // self.tick) * self.tick, None)
        if action != said:
            yield pd.DataFrame([(key[0], key[1], action, now)], columns=["vault_id", "path", "action", "at_ms"])

    def close(self) -> None:
        pass


def changes(inventory: DataFrame, recent: DataFrame) -> DataFrame:
    """One stream of both inputs: files that are there (or, with ``present`` false, no longer) and own operations. A row without a
    time holds since ever."""
    there = inventory if "present" in inventory.columns else inventory.withColumn("present", F.lit(True))
    there = there if "ms" in there.columns else there.withColumn("ms", F.lit(0).cast("long"))
    files = there.select("vault_id", "path", "replica", "present", F.lit(None).cast("string").alias("op"), F.coalesce("ms", F.lit(0)).alias("ms"))
    return files.unionByName(recent.select("vault_id", "path", "replica", F.lit(None).cast("boolean").alias("present"), "op", "ms"))


def stream_reconcile(rows: DataFrame, quiet: int = PERIODIC, tick: int = TICK, live: bool = True, delay: str = "1 hour") -> DataFrame:
    """``vault_id, path, action, at_ms`` of ``changes``: push, pull, suppressed, or settled again, each time that this changes.

    Live, ticks are of the processing time. Else they are of the event time, and decisions are as of the watermark: the batch
    result at that moment, whatever the order of arrival. A path on both sides keeps its two flags; one on neither leaves the state.
    """
    if not live:
        rows = rows.withColumn("_at", F.timestamp_millis("ms")).withWatermark("_at", delay).select("vault_id", "path", "replica", "present", "op", "ms")
    mode = "ProcessingTime" if live else "EventTime"
    return rows.groupBy("vault_id", "path").transformWithStateInPandas(statefulProcessor=Watch(quiet, tick, live), outputStructType="vault_id string, path string, action string, at_ms long", outputMode="Append", timeMode=mode)


def plan_now(said: DataFrame) -> DataFrame:
    """The actions that hold after all that was said."""
    last = said.groupBy("vault_id", "path").agg(F.max_by("action", "at_ms").alias("action"))
    return last.filter("action <> 'settled'")
