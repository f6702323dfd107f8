"""Document versions, conflicts and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["vault_id", "path"]


def latest_version(versions: DataFrame) -> DataFrame:
    """The last text of each document."""
    return versions.groupBy(*KEY).agg(F.max_by("text", F.struct("ms", "seq")).alias("text"), F.max("ms").alias("ms"))


def joined_versions(local: DataFrame, remote: DataFrame, base: DataFrame) -> DataFrame:
    """The two sides and the base of each document, of frames ``vault_id, path, text, ms`` with a row a document: a union and
    one aggregation instead of two joins. What a side lacks is null; documents of the base alone are left out."""
    sides = {"local": local, "remote": remote, "base": base}
    rows = [df.select(*KEY, "text", "ms", F.lit(n).alias("side")) for n, df in sides.items()]
    of = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c))).alias(f"{n}_{c}")
    out = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(*KEY).agg(*[of(n, c) for n in sides for c in ("text", "ms")], F.bool_or(F.col("side") != "base").alias("live"))
    return out.filter("live").select(*KEY, "base_text", "local_text", "remote_text", "local_ms", "remote_ms")


def is_conflict(local: Column, remote: Column, base: Column) -> Column:
    """Also when only the remote side moved on, which parity asks for."""
    return F.coalesce((~local.eqNullSafe(remote)) & (base != "") & ~base.eqNullSafe(remote), F.lit(False))


def content_conflicts(versions: DataFrame) -> DataFrame:
    return versions.filter(is_conflict(F.col("local_text"), F.col("remote_text"), F.col("base_text")))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def line_merge(local: Column, remote: Column) -> Column:
    """The other side if one is empty; null if some line index is written on both sides; else the local lines and the
    remote written lines that are not among them, in order, once."""
    a, b = F.split(local, "\n"), F.split(remote, "\n")
    both = F.exists(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].isNotNull() & x["b"].isNotNull() & ~_blank(x["a"]) & ~_blank(x["b"]))
    added = F.array_distinct(F.filter(b, lambda x: ~_blank(x) & ~F.array_contains(a, x)))
    return F.when(F.coalesce(local, F.lit("")) == "", F.coalesce(remote, F.lit(""))).when(F.coalesce(remote, F.lit("")) == "", local).when(~both, F.array_join(F.concat(a, added), "\n"))


def auto_text(local: Column, remote: Column, local_ms: Column, remote_ms: Column) -> tuple[Column, Column]:
    """C4: text and method; equal times keep the local side."""
    merged = line_merge(local, remote)
    newer = F.coalesce(remote_ms > local_ms, F.lit(False))
    return F.coalesce(merged, F.when(newer, remote).otherwise(local)), F.when(merged.isNotNull(), "merge").when(newer, "remote").otherwise("local")


def resolve_auto(conflicts: DataFrame, remote_ms: Column | None = None) -> DataFrame:
    text, method = auto_text(F.col("local_text"), F.col("remote_text"), F.col("local_ms"), F.col("remote_ms") if remote_ms is None else remote_ms)
    return conflicts.select(*KEY, text.alias("text"), method.alias("method"))


def backup_path(path: Column, side: str, stamp: Column) -> Column:
    """``base.side-stamp.ext`` at the last dot of the whole path; without a dot the base is empty and the path the extension."""
    dot = F.length(path) - F.instr(F.reverse(path), ".") + 1
    has = F.instr(path, ".") > 0
    base = F.when(has, F.substr(path, F.lit(1), dot - 1)).otherwise(F.lit(""))
    ext = F.when(has, F.substr(path, dot + 1)).otherwise(path)
    return F.concat(base, F.lit(f".{side}-"), stamp, F.lit("."), ext)


def resolve_backup(conflicts: DataFrame, stamp: Column) -> DataFrame:
    """The remote text stays under the path, both sides get copies."""
    row = lambda role, path, text: F.struct(F.lit(role).alias("role"), path.alias("file"), F.col(text).alias("text"))
    rows = F.array(row("original", F.col("path"), "remote_text"), row("local", backup_path(F.col("path"), "local", stamp), "local_text"), row("remote", backup_path(F.col("path"), "remote", stamp), "remote_text"))
    return conflicts.select(*KEY, F.explode(rows).alias("r")).select(*KEY, "r.*")


def resolve_manual(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """A missing decision (dismissed) keeps the local side; an unknown one, or a merge that fails, leaves it unresolved."""
    rows = conflicts.join(decisions, KEY, "left").withColumn("resolution", F.coalesce("resolution", F.lit("keepLocal")))
    merged = line_merge(F.col("local_text"), F.col("remote_text"))
    text = F.when(F.col("resolution") == "keepLocal", F.col("local_text")).when(F.col("resolution") == "keepRemote", F.col("remote_text")).when(F.col("resolution") == "merge", merged)
    outcome = F.when(F.col("resolution") == "backup", "backup").when(text.isNotNull(), F.col("resolution")).otherwise("unresolved")
    return rows.select(*KEY, outcome.alias("outcome"), text.alias("text"))


def resolve_conflicts(conflicts: DataFrame, decisions: DataFrame, strategy: Column, stamp: Column) -> DataFrame:
    """What cannot be resolved is backed up; else by strategy (auto, manual, backup), unknown ones as auto."""
    way = F.when(~F.col("is_resolvable"), "backup").when(strategy.isin("manual", "backup"), strategy).otherwise("auto")
    rows = conflicts.join(decisions, KEY, "left").withColumn("way", way)
    chosen = F.coalesce("resolution", F.lit("keepLocal"))
    text, method = auto_text(F.col("local_text"), F.col("remote_text"), F.col("local_ms"), F.col("remote_ms"))
    by_hand = F.when(chosen == "keepLocal", F.col("local_text")).when(chosen == "keepRemote", F.col("remote_text")).when(chosen == "merge", line_merge(F.col("local_text"), F.col("remote_text")))
    rows = rows.withColumns({
        "text": F.when(F.col("way") == "auto", text).when(F.col("way") == "manual", by_hand),
        "method": F.when(F.col("way") == "auto", method).when((F.col("way") == "manual") & (chosen != "backup"), F.when(by_hand.isNotNull(), chosen).otherwise("unresolved")).otherwise("backup"),
    })
    single = rows.filter("method <> 'backup'").select(*KEY, "method", F.col("path").alias("file"), "text")
    copies = resolve_backup(rows.filter("method = 'backup'"), stamp).select(*KEY, F.lit("backup").alias("method"), "file", "text")
    return single.unionByName(copies)


def open_document_action(versions: DataFrame) -> DataFrame:
    """What opening a document does with the editor's (local) and the shared (remote) text."""
    editor, shared = F.coalesce("local_text", F.lit("")), F.coalesce("remote_text", F.lit(""))
    action = (
        F.when(shared == "", "seed")
        .when(shared == editor, "none")
        .when(_blank(shared) & ~_blank(editor), "keep_editor")
        .when(_blank(editor), "take_shared")
        .when(is_conflict(editor, shared, F.col("base_text")), "resolve")
        .otherwise("take_shared")
    )
    return versions.select(*KEY, action.alias("action"))


def typed(resolved: DataFrame, structural: DataFrame) -> DataFrame:
    """Resolutions of both types of conflict: those of texts, and those of paths (R4), which are settled for the suggested side."""
    paths = structural.filter("outcome = 'conflict'").select(*KEY, F.lit("structure").alias("type"), F.when(F.col("suggested") == "keepRemote", "remote").otherwise("local").alias("method"))
    return resolved.select(*KEY, F.lit("content").alias("type"), "method").unionByName(paths)


def conflict_summary(resolved: DataFrame) -> DataFrame:
    """Counts and the share merged, by vault, type and method, and over all of each."""
    return resolved.cube("vault_id", "type", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("method") == "merge") / F.count(F.lit(1)), 6).alias("share_merged"))


def three_way_status(versions: DataFrame) -> DataFrame:
    """C10."""
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    status = F.when(same("base_text", "local_text") & same("base_text", "remote_text"), "unchanged").when(same("base_text", "remote_text"), "local_only").when(same("base_text", "local_text"), "remote_only").when(same("local_text", "remote_text"), "same_change").otherwise("both_changed")
    return versions.select(*KEY, status.alias("status"))


def changed_lines(versions: DataFrame) -> DataFrame:
    """C11: written line indexes of each side and their overlap, by rows instead of arrays."""
    side = lambda c, n: versions.select(*KEY, F.posexplode(F.split(c, "\n")).alias("at", "line")).filter(~_blank(F.col("line"))).select(*KEY, "at", F.lit(n).alias("side"))
    rows = side("local_text", 1).unionByName(side("remote_text", 2)).groupBy(*KEY, "at").agg(F.sum("side").alias("sides"))
    return rows.groupBy(*KEY).agg(F.count_if(F.col("sides") != 2).alias("local_lines"), F.count_if(F.col("sides") != 1).alias("remote_lines"), F.count_if(F.col("sides") == 3).alias("overlap"))
