"""Ordered replay of queued file operations. A queue is one user's in one vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import Replica
from ..sources.scratch import written
from .folding import keyed_fold
from .runs import running

QUEUE = ["vault_id", "user_id"]


def _queue():
    return Window.partitionBy(*QUEUE).orderBy("ms", "seq")


def order_queue(ops: DataFrame) -> DataFrame:
    """O1: place of each operation in its queue; ties keep the order of insertion."""
    return ops.withColumn("nth", F.row_number().over(_queue()))


def drain_queue(ops: DataFrame) -> DataFrame:
    """O2: operations before the first failure are applied; it and all later ones stay."""
    fails = F.col("type").isin("rename", "move") & (F.coalesce("new_path", F.lit("")) == "")
    failed = F.sum(F.when(fails, 1).otherwise(0)).over(_queue().rowsBetween(Window.unboundedPreceding, 0))
    return ops.withColumn("outcome", F.when(failed == 0, "applied").when(fails & (failed == 1), "failed").otherwise("left"))


def replay_ops(ops: DataFrame) -> DataFrame:
    """O3: the files each queue ends with, their text, and where they came from; one streaming fold."""

    def step(s: Replica, r: dict) -> None:
        s.step(r["type"], r["path"], r["new_path"], r["content"])

    def finish(s: Replica, key: tuple) -> list[tuple]:
        return [(*key, path, text, *s.origin[path], s.blocked) for path, text in sorted(s.files.items())]

    return keyed_fold(ops, QUEUE, ["ms", "seq"], Replica, step, ["type", "path", "new_path", "content"], "vault_id string, user_id string, path string, text string, first_path string, hops long, blocked boolean", finish)


def replay_fast(ops: DataFrame) -> DataFrame:
    """With creations and deletions only, a path lives if a creation follows its last deletion, with the first such text."""
    by = Window.partitionBy(*QUEUE, "path").orderBy("ms", "seq")
    rows = ops.filter(F.col("type").isin("create", "delete")).withColumn("epoch", F.sum(F.when(F.col("type") == "delete", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    last = rows.withColumn("last", F.max("epoch").over(Window.partitionBy(*QUEUE, "path"))).filter("type = 'create' and epoch = last")
    return last.withColumn("nth", F.row_number().over(by)).filter("nth = 1").select(*QUEUE, "path", F.col("content").alias("text"))


def file_moves(ops: DataFrame) -> DataFrame:
    """What each operation of O3 did to files: ``old`` and ``new`` path, null for a creation's old and a deletion's new one."""

    def step(s: Replica, r: dict) -> tuple | None:
        s.step(r["type"], r["path"], r["new_path"], r["content"])
        return (r["vault_id"], r["user_id"], r["ms"], r["seq"], [{"old": a, "new": b} for a, b in s.moved]) if s.moved else None

    out = "vault_id string, user_id string, ms long, seq long, moved array<struct<old: string, new: string>>"
    return keyed_fold(ops, QUEUE, ["ms", "seq"], Replica, step, ["ms", "seq", "type", "path", "new_path", "content"], out).select(*QUEUE, "ms", "seq", F.inline("moved"))


def rename_chains(moves: DataFrame) -> DataFrame:
    """Files that moved and still are there: first and final path, and the renames between, by a recursive query over ``file_moves``.

    Each arrival of a file at a path is followed by at most one departure from it, which a window finds; a rename is both. The
    recursion follows all files at once, a rename further each time. It runs here, as its bounds belong to the session, and the
    moves are written first, as each step reads them.
    """
    spark = moves.sparkSession
    events = F.array(F.struct(F.col("old").alias("path"), F.lit(0).alias("arrives")), F.struct(F.col("new").alias("path"), F.lit(1).alias("arrives")))
    rows = moves.select(*QUEUE, "ms", "seq", F.col("old").isNull().alias("born"), F.inline(events)).filter("path is not null")
    by = Window.partitionBy(*QUEUE, "path").orderBy("ms", "seq", "arrives")
    at = F.struct("ms", "seq")
    paired = rows.withColumns({"after": F.lead(at).over(by), "before": F.lag(at).over(by)})
    arrivals = paired.filter("arrives = 1").select(*QUEUE, at.alias("at"), "path", "born", F.col("after").isNotNull().alias("gone"))
    left = paired.filter("arrives = 0").select(*QUEUE, at.alias("at"), F.col("path").alias("from_path"), F.col("before").alias("from_at"))
    links = written(arrivals.join(left, [*QUEUE, "at"], "left"), "moves")
    bounds = {"spark.sql.cteRecursionLevelLimit": "-1", "spark.sql.cteRecursionRowLimit": "-1"}
    before = {k: spark.conf.get(k) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, v)
        return written(spark.sql("""with recursive chain as (
            select vault_id, user_id, at, path, path as first_path, cast(0 as bigint) as hops, gone from {links} where born
            union all
            select l.vault_id, l.user_id, l.at, l.path, c.first_path, c.hops + 1, l.gone from chain c join {links} l
              on l.vault_id = c.vault_id and l.user_id = c.user_id and l.from_at = c.at and l.from_path = c.path and not l.born)
          select vault_id, user_id, first_path, path as final_path, hops from chain where hops > 0 and not gone""", links=links), "chains")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def queue_depth(routed: DataFrame, split: bool = False) -> DataFrame:
    """Pending operations of each vault over time: queued ones enter, a drain empties the user's part. A vault's rows are one
    task's work, or with ``split`` dealt over all tasks (see ``runs``)."""
    change = F.when(F.col("route") == "queued", 1).when(F.col("route") == "drain", -F.col("n")).otherwise(0)
    order = ["ms", "seq", "user_id", "route"]
    if split:
        depth = running(routed.withColumn("change", change), ["vault_id"], order, "change").withColumnRenamed("total", "depth")
    else:
        by = Window.partitionBy("vault_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        depth = routed.withColumn("depth", F.sum(change).over(by))
    return depth.select("vault_id", "user_id", "ms", "seq", "route", "depth")


def route_ops(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """An operation of a user who is connected at its time goes direct, else into the queue (as-of: the last change
    at or before it, by union and window instead of a range join)."""
    more = [c for c in ops.columns if c in ("id", "type", "new_path")]
    o = ops.select("user_id", "ms", "vault_id", "seq", *more, F.lit(None).cast("string").alias("status"), F.lit(1).alias("side"))
    c = changes.select(F.col("client_id").alias("user_id"), "ms", F.lit(None).cast("string").alias("vault_id"), F.col("event_id").alias("seq"), *[F.lit(None).cast(ops.schema[c].dataType).alias(c) for c in more], "status", F.lit(0).alias("side"))
    by = Window.partitionBy("user_id").orderBy("ms", "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    known = o.unionByName(c).withColumn("now", F.last("status", ignorenulls=True).over(by)).filter("side = 1")
    return known.select("vault_id", "user_id", "ms", "seq", *more, F.when(F.col("now") == "connected", "direct").otherwise("queued").alias("route"), F.lit(1).cast("long").alias("n"))


def drains(routed: DataFrame, changes: DataFrame) -> DataFrame:
    """Moments at which a user's queue of a vault drains: each return to ``connected`` after operations were queued."""
    back = changes.filter("status = 'connected'").select(F.col("client_id").alias("user_id"), "ms", F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("vault_id"), F.lit(0).alias("side"))
    queued = routed.filter("route = 'queued'").select("user_id", "ms", "seq", "vault_id", F.lit(1).alias("side"))
    by = Window.partitionBy("user_id").orderBy(F.desc("ms"), F.desc("side"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.struct("ms", "seq")
    rows = back.unionByName(queued).withColumn("next", F.last(F.when(F.col("side") == 0, mark), ignorenulls=True).over(by)).filter("side = 1 and next is not null")
    return rows.groupBy("vault_id", "user_id", F.col("next.ms").alias("ms"), F.col("next.seq").alias("seq")).agg(F.count(F.lit(1)).alias("n")).select("vault_id", "user_id", "ms", "seq", F.lit("drain").alias("route"), "n")


def offline_drain(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """O7 and O2 together, the batch form of T7: operations that go direct, and those that a return to ``connected`` drains, with what
    becomes of them. Those that still wait are left out; an id counts once, at its first time."""
    once = ops.groupBy("id").agg(F.min(F.struct("ms", "seq", "vault_id", "user_id", "type", "new_path")).alias("o")).select("id", "o.*")
    routed = route_ops(once, changes)
    back = changes.filter("status = 'connected'").select(F.col("client_id").alias("user_id"), "ms", F.lit(True).alias("back"))
    ahead = Window.partitionBy("user_id").orderBy(F.desc("ms"), F.desc_nulls_last("route")).rowsBetween(Window.unboundedPreceding, 0)
    next_back = F.last(F.when(F.col("back"), F.col("ms")), ignorenulls=True).over(ahead)
    queued = routed.filter("route = 'queued'").unionByName(back, allowMissingColumns=True).withColumn("at_ms", next_back).filter("back is null and at_ms is not null")
    drained = drain_queue(queued).select("vault_id", "user_id", "id", "ms", "route", "outcome", "at_ms")
    direct = routed.filter("route = 'direct'").select("vault_id", "user_id", "id", "ms", "route", F.lit("applied").alias("outcome"), F.col("ms").alias("at_ms"))
    return direct.unionByName(drained)


def drain_summary(drained: DataFrame) -> DataFrame:
    """Applied and remaining operations of each vault and type, of each vault, and the first blocker."""
    stuck = F.when(F.col("outcome") == "failed", F.col("seq"))
    return drained.rollup("vault_id", "type").agg(F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") != "applied").alias("remaining"), F.min_by("id", F.when(stuck.isNotNull(), F.struct("ms", "seq"))).alias("first_blocker"))


def dedupe_ops(ops: DataFrame) -> DataFrame:
    """An operation id counts once, at its first time."""
    return ops.groupBy("id").agg(F.min(F.struct("ms", "seq", "type", "path")).alias("o")).select("id", "o.*")


def clear_queue(ops: DataFrame, vaults: DataFrame) -> DataFrame:
    """O10."""
    return ops.join(vaults, "vault_id", "left_anti")
