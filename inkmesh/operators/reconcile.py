"""Reconciliation of file inventories of many vaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values in milliseconds: structural conflicts, periodic checks, observed changes.
CONFLICT, PERIODIC, OBSERVED = 60_000, 10_000, 5_000


def _sides(inventory: DataFrame) -> DataFrame:
    """One row per path with a flag for each side: a single aggregation in place of a full join."""
    return inventory.groupBy("vault_id", "path").agg(F.bool_or(F.col("replica") == "local").alias("local"), F.bool_or(F.col("replica") == "remote").alias("remote"))


def inventory_diff(inventory: DataFrame) -> DataFrame:
    """R1."""
    side = F.when(F.col("local") & F.col("remote"), "common").when(F.col("local"), "local_only").otherwise("remote_only")
    return _sides(inventory).select("vault_id", "path", side.alias("side"))


def sync_plan(inventory: DataFrame) -> DataFrame:
    """R2: push what only the local side has, pull what only the other has; common files belong to the content stage.

    An empty side needs no case of its own: pushing or pulling all is what the difference then says.
    """
    action = F.when(F.col("side") == "local_only", "push").when(F.col("side") == "remote_only", "pull")
    return inventory_diff(inventory).select("vault_id", "path", action.alias("action"), F.when(action == "pull", F.lit("")).alias("text")).filter("action is not null")


def sync_summary(inventory: DataFrame) -> DataFrame:
    """Counts per vault; the notice names the larger side."""
    plan = _sides(inventory).groupBy("vault_id")
    return plan.agg(F.count_if(F.col("local") & ~F.col("remote")).alias("pushed"), F.count_if(F.col("remote") & ~F.col("local")).alias("pulled"), F.greatest(F.count_if("local"), F.count_if("remote")).alias("notice"))


def recent_ops(ops: DataFrame, as_of: Column, rename_key: str = "old") -> DataFrame:
    """The latest time of each operation on each path up to a moment; a rename is kept under its old path, or with
    ``rename_key='new'`` under the new one."""
    path = F.col("path") if rename_key == "old" else F.when(F.col("op") == "rename", F.coalesce("new_path", "path")).otherwise(F.col("path"))
    return ops.filter(F.col("ms") <= as_of).withColumn("path", path).groupBy("vault_id", "replica", "op", "path").agg(F.max("ms").alias("ms"))


def _times(recent: DataFrame, replica: str = "local") -> DataFrame:
    """One row per path with the last time of each operation."""
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("ms"))).alias(f"{op}_ms")
    return recent.filter(F.col("replica") == replica).groupBy("vault_id", "path").agg(last("create"), last("delete"), last("rename"))


def structural_conflicts(inventory: DataFrame, recent: DataFrame, as_of: Column, within: int = CONFLICT) -> DataFrame:
    """Conflicts between one-sided paths and what the local side did lately."""
    rows = inventory_diff(inventory).filter("side <> 'common'").join(_times(recent), ["vault_id", "path"], "left")
    deleted = F.coalesce(as_of - F.col("delete_ms") < within, F.lit(False))
    created = F.coalesce(as_of - F.col("create_ms") < within, F.lit(False))
    outcome = F.when((F.col("side") == "remote_only") & deleted, "conflict").when(F.col("side") == "remote_only", "create").when(created, "push").otherwise("conflict")
    hint = F.when(outcome == "conflict", F.when(F.col("side") == "remote_only", "keepRemote").otherwise("keepLocal"))
    return rows.select("vault_id", "path", "side", outcome.alias("outcome"), hint.alias("suggested"))


def periodic_reconcile(inventory: DataFrame, recent: DataFrame, as_of: Column, quiet: int = PERIODIC) -> DataFrame:
    """One-sided paths are pushed or pulled unless an own operation is too recent (exactly ``quiet`` still is).

    The first time known, creation before rename, decides. A rename counts under the path that ``recent_ops`` keeps it by.
    """
    rows = inventory_diff(inventory).filter("side <> 'common'").join(_times(recent), ["vault_id", "path"], "left")
    own = F.coalesce(F.nullif("create_ms", F.lit(0)), F.nullif("rename_ms", F.lit(0)), F.lit(0))
    since = as_of - F.when(F.col("side") == "local_only", own).otherwise(F.coalesce("delete_ms", F.lit(0)))
    action = F.when(since > quiet, F.when(F.col("side") == "local_only", "push").otherwise("pull")).otherwise("suppressed")
    return rows.select("vault_id", "path", action.alias("action"))


def apply_remote_inserts(inventory: DataFrame, recent: DataFrame, as_of: Column, quiet: int = OBSERVED) -> DataFrame:
    """Remote files and folders to create locally: not there, and not created locally within ``quiet``. Both sides are one
    aggregation by path; a path that is a file on one side and a folder on the other is there."""
    files = inventory.select("vault_id", "replica", "path", F.lit(False).alias("is_folder"))
    folders = folder_rollup(inventory).select("vault_id", "replica", F.col("folder").alias("path"), F.lit(True).alias("is_folder"))
    sides = files.unionByName(folders).groupBy("vault_id", "path").agg(F.bool_or(F.col("replica") == "local").alias("here"), F.bool_or("is_folder").alias("is_folder"))
    rows = sides.filter("not here").join(_times(recent).select("vault_id", "path", "create_ms"), ["vault_id", "path"], "left")
    return rows.filter(F.col("create_ms").isNull() | (as_of - F.col("create_ms") > quiet)).select("vault_id", "path", "is_folder")


def folder_rollup(inventory: DataFrame) -> DataFrame:
    """Files below each ancestor folder of each replica."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    rows = inventory.select("vault_id", "replica", "path", F.explode(above).alias("folder"))
    return rows.groupBy("vault_id", "replica", "folder").agg(F.count(F.lit(1)).alias("files"))


def reconcile_deletes(inventory: DataFrame, recent: DataFrame, as_of: Column, quiet: int = OBSERVED) -> DataFrame:
    """Local files and folders that the remote side lacks, unless deleted locally within ``quiet``; folders say
    whether they still hold remote files."""
    folders = folder_rollup(inventory).select("vault_id", "replica", F.col("folder").alias("path"), F.lit(True).alias("is_folder"), "files")
    files = inventory.select("vault_id", "replica", "path", F.lit(False).alias("is_folder"), F.lit(0).cast("long").alias("files"))
    both = files.unionByName(folders)
    gone = both.filter("replica = 'local'").join(inventory.filter("replica = 'remote'").select("vault_id", "path"), ["vault_id", "path"], "left_anti")
    live = folders.filter("replica = 'remote'").select("vault_id", "path", F.lit(True).alias("live"))
    rows = gone.join(live, ["vault_id", "path"], "left").join(_times(recent).select("vault_id", "path", "delete_ms"), ["vault_id", "path"], "left")
    kept = rows.filter(F.col("delete_ms").isNull() | (as_of - F.col("delete_ms") > quiet))
    return kept.select("vault_id", "path", "is_folder", (F.col("is_folder") & F.coalesce("live", F.lit(False))).alias("has_live_children"))


def inventory_from_events(ops: DataFrame) -> DataFrame:
    """Paths that the online events leave: a rename is a deletion and a creation; the last event of a path decides."""
    kind = F.when(F.col("type").isin("create", "createFolder"), 1).when(F.col("type").isin("delete", "deleteFolder"), 0)
    moved = (F.col("type") == "rename") & F.col("new_path").isNotNull()
    e = lambda path, add, nth: F.struct(F.col(path).alias("p"), F.lit(add).alias("add"), F.lit(nth).alias("nth"))
    changes = F.when(moved, F.array(e("path", 0, 0), e("new_path", 1, 1))).when(kind.isNotNull(), F.array(F.struct(F.col("path").alias("p"), kind.alias("add"), F.lit(0).alias("nth"))))
    rows = ops.select("vault_id", "ms", "seq", F.explode(changes).alias("c"))
    last = rows.groupBy("vault_id", F.col("c.p").alias("path")).agg(F.max_by("c.add", F.struct("ms", "seq", "c.nth")).alias("add"))
    return last.filter("add = 1").select("vault_id", "path")


def joined_inventory(inventory: DataFrame, moves: DataFrame) -> DataFrame:
    """The inventories under the vaults that ``moves(vault_id, into)`` names, each path of a replica once; moves into
    oneself are refused."""
    moved = inventory.join(moves.filter("vault_id <> into"), "vault_id", "left")
    return moved.select(F.coalesce("into", "vault_id").alias("vault_id"), "replica", "path").distinct()


def join_vault(inventory: DataFrame, moves: DataFrame) -> DataFrame:
    """Files of the joined vaults, and the old ids as history."""
    asked = moves.filter("vault_id <> into")
    paths = joined_inventory(inventory, moves).select("vault_id", "path").distinct().groupBy("vault_id").agg(F.count(F.lit(1)).alias("files"))
    history = asked.groupBy(F.col("into").alias("vault_id")).agg(F.array_sort(F.collect_set("vault_id")).alias("history"))
    return paths.join(history, "vault_id", "left")


def replica_convergence(inventory: DataFrame) -> DataFrame:
    """Paths that some replica of their vault lacks, and which: the replicas' set less each path's."""
    replicas = inventory.groupBy("vault_id").agg(F.collect_set("replica").alias("every"))
    held = inventory.groupBy("vault_id", "path").agg(F.collect_set("replica").alias("held"))
    rows = held.join(replicas, "vault_id").withColumn("missing", F.array_except("every", "held"))
    return rows.filter(F.size("missing") > 0).select("vault_id", "path", F.array_sort("missing").alias("missing"))
