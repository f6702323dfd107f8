"""Sessions, presence and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .runs import running

#: Idle times of an active session and an active vault, known states, retries, debounce, history.
ACTIVE_SESSION, ACTIVE_VAULT, DEBOUNCE, HISTORY = 30_000, 300_000, 100, 100
STATES, MOST_TRIES, FIRST_DELAY = ("connected", "disconnected", "connecting"), 5, 1000


def sessions(log: DataFrame, budget: DataFrame) -> DataFrame:
    """One row per connection; only connects and allowed messages bump the activity."""
    rows = log.join(budget.select("event_id", "allowed"), "event_id", "left")
    valid = rules.vault_id(F.col("vault_id"))
    active = (F.col("kind") == "connect") | ((F.col("kind") == "message") & F.coalesce("allowed", F.lit(False)))
    at = F.struct("ms", "event_id")
    return rows.groupBy("connection_id").agg(
        F.min("ms").alias("created_ms"),
        F.min_by(valid, F.when(valid.isNotNull(), at)).alias("vault_id"),
        F.min_by(rules.user_id(F.col("user_id")), at).alias("user_id"),
        F.min_by("ip", at).alias("ip"),
        F.coalesce(F.max(F.when(active, F.col("ms"))), F.min("ms")).alias("last_ms"),
        F.max(F.when(F.col("kind") == "disconnect", F.col("ms"))).alias("closed_ms"),
        (F.max_by("kind", at) != "disconnect").alias("is_open"),
    )


def active_sessions(found: DataFrame, as_of: Column) -> DataFrame:
    """P2."""
    idle = as_of - F.col("last_ms")
    return found.filter("is_open").select("connection_id", "vault_id", "user_id", "last_ms", idle.alias("idle_ms"), (idle < ACTIVE_SESSION).alias("is_active"))


def vault_roster(log: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Owner (first valid user), members, permissions with the last write winning. ``changes`` to unknown vaults are ignored."""
    joined = log.filter("kind = 'connect'").select(rules.vault_id(F.col("vault_id")).alias("vault_id"), rules.user_id(F.col("user_id")).alias("user_id"), "ms", "event_id").filter("vault_id is not null and user_id is not null")
    first = joined.groupBy("vault_id").agg(F.min_by("user_id", F.struct("ms", "event_id")).alias("owner"), F.min("ms").alias("created_ms"))
    grants = first.select("vault_id", F.col("owner").alias("user_id"), F.lit("admin").alias("permission"), F.lit(-1).cast("long").alias("ms"), F.lit(-1).cast("long").alias("event_id"))
    if changes is not None:
        grants = grants.unionByName(changes.select("vault_id", "user_id", "permission", "ms", "event_id"))
    held = grants.groupBy("vault_id", "user_id").agg(F.max_by("permission", F.struct("ms", "event_id")).alias("permission"))
    members = held.groupBy("vault_id").agg(F.count(F.lit(1)).alias("member_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("user_id", "permission")))).alias("permissions"))
    return first.join(members, "vault_id")


def access_check(wanted: DataFrame, permissions: DataFrame) -> DataFrame:
    """The permission of each (vault, user) pair; null if none."""
    return wanted.join(permissions, ["vault_id", "user_id"], "left").withColumn("has_access", F.col("permission").isNotNull())


def vault_activity(roster: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """Vaults without sessions appear with 0."""
    recent = found.filter("is_open").withColumn("recent", (as_of - F.col("last_ms")) < ACTIVE_VAULT)
    counts = recent.groupBy("vault_id").agg(F.count_if("recent").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return roster.join(counts, "vault_id", "left").select("vault_id", "owner", "member_count", n.alias("active_sessions"), (n > 0).alias("is_active"))


def server_totals(log: DataFrame, found: DataFrame, vaults: DataFrame, budget: DataFrame) -> DataFrame:
    """One row; outbound allowed messages count as processed."""
    messages = log.filter("kind = 'message'").select("event_id", "direction").join(budget.select("event_id", "allowed"), "event_id")
    parts = [
        log.agg(F.count_if(F.col("kind") == "connect").alias("total_connections")),
        found.agg(F.count_if("is_open").alias("current_connections")),
        vaults.agg(F.count(F.lit(1)).alias("total_vaults"), F.count_if("is_active").alias("active_vaults")),
        messages.agg(F.count_if(~F.col("allowed")).alias("rate_limit_hits"), F.count_if(F.col("allowed") & (F.col("direction") == "out")).alias("messages_processed")),
    ]
    return parts[0].select("*", *[p.select(c).scalar().alias(c) for p in parts[1:] for c in p.columns])


def connection_gauge(log: DataFrame, key: str | None, split: bool = False) -> DataFrame:
    """P5: open connections of each key after each event, never below 0: the running sum less its lowest point so far. A key's rows
    are one task's work; with ``split``, or over all rows (``key`` is None), they are dealt over all tasks (see ``runs``)."""
    change = F.when(F.col("kind") == "connect", 1).when(F.col("kind") == "disconnect", -1)
    own = [] if key is None else [key]
    rows = log.withColumn("change", change).filter("change is not null").select(*own, "ms", "event_id", "change")
    if split or not own:
        run = running(rows, own, ["ms", "event_id"], "change")
    else:
        by = Window.partitionBy(key).orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        run = rows.withColumn("total", F.sum("change").over(by)).withColumn("low", F.min("total").over(by))
    return run.select(*own, "ms", "event_id", (F.col("total") - F.least(F.lit(0), "low")).alias("open"))


def peak_concurrency(gauge: DataFrame, key: str) -> DataFrame:
    """The highest gauge and when it was first reached."""
    return gauge.groupBy(key).agg(F.max("open").alias("peak"), F.max_by("ms", F.struct("open", -F.col("ms"))).alias("peak_ms"))


def recent_events(log: DataFrame, key: str, n: int = HISTORY) -> DataFrame:
    """The last ``n`` connects and disconnects of each key; disconnects name no vault and user."""
    keep = F.col("kind") == "connect"
    by = Window.partitionBy(key).orderBy(F.desc("ms"), F.desc("event_id"))
    rows = log.filter("kind in ('connect', 'disconnect')").withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= n)
    return rows.select(key, "nth", "event_id", "kind", "connection_id", F.when(keep, F.col("vault_id")).alias("vault"), F.when(keep, F.col("user_id")).alias("user"), "ms")


def presence_latest(presence: DataFrame, as_of: Column | None = None, ttl: int | None = None) -> DataFrame:
    """P10: the latest state of each client; a null state removes it, and so does silence for more than ``ttl``."""
    state = F.struct("vault_id", "name", "current_file", "is_null", "ms")
    last = presence.groupBy("client_id").agg(F.max_by(state, F.struct("ms", "seq")).alias("s"))
    here = ~F.col("s.is_null") if ttl is None else ~F.col("s.is_null") & (as_of - F.col("s.ms") <= ttl)
    return last.filter(here).select("client_id", "s.vault_id", "s.name", "s.current_file", "s.ms")


def presence_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clients added, updated or removed between two snapshots."""
    a, b = (x.select("client_id", F.struct("vault_id", "name", "current_file").alias(n)) for x, n in ((before, "a"), (after, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "updated").when(~F.col("a").eqNullSafe(F.col("b")), "updated")
    return a.join(b, "client_id", "full").select("client_id", change.alias("change")).filter("change is not null")


def users_per(latest: DataFrame) -> DataFrame:
    """Clients by vault, and by vault and file; states without a name are not listed by file."""
    file = F.coalesce("current_file", F.lit("no document"))
    rows = latest.select("vault_id", file.alias("file"), "name")
    return rows.groupingSets([["vault_id"], ["vault_id", "file"]], "vault_id", "file").agg(F.count(F.lit(1)).alias("clients"), F.count("name").alias("named"))


def status_transitions(status: DataFrame) -> DataFrame:
    """Changes between known states of each client, and what going online or offline starts."""
    by = Window.partitionBy("client_id").orderBy("ms", "event_id")
    known = status.filter(F.col("status").isin(*STATES)).withColumn("before", F.lag("status").over(by))
    changed = known.filter(~F.col("before").eqNullSafe(F.col("status")))
    starts = F.when(F.col("status") == "connected", "sync").when((F.col("before") == "connected"), "queue")
    return changed.select("client_id", "ms", "event_id", "before", "status", starts.alias("starts"))


def reconnect_schedule(status: DataFrame, first: int = FIRST_DELAY, most: int = MOST_TRIES) -> DataFrame:
    """Tries of each episode without a connection and their delays; ``connected`` resets the count."""
    by = Window.partitionBy("client_id").orderBy("ms", "event_id")
    marked = status.filter(F.col("status").isin("connected", "disconnected")).withColumn("episode", F.sum(F.when(F.col("status") == "connected", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    tries = marked.filter("status = 'disconnected'").withColumn("n", F.row_number().over(Window.partitionBy("client_id", "episode").orderBy("ms", "event_id")) - 1)
    return tries.select("client_id", "episode", "event_id", "n", F.when(F.col("n") < most, (first * F.pow(F.lit(2), "n")).cast("long")).alias("delay_ms"))


def offline_periods(changes: DataFrame) -> DataFrame:
    """From leaving ``connected`` to the next ``connected``; open at the end if there is none."""
    by = Window.partitionBy("client_id").orderBy("ms", "event_id")
    on = changes.withColumn("online", F.col("status") == "connected").withColumn("was", F.lag("online").over(by))
    edges = on.filter(~F.col("online").eqNullSafe(F.coalesce("was", F.lit(False)))).withColumn("until_ms", F.lead("ms").over(by))
    return edges.filter("not online").select("client_id", F.col("ms").alias("from_ms"), "until_ms", (F.col("until_ms") - F.col("ms")).alias("length_ms"))


def debounce(events: DataFrame, key: str, quiet: int = DEBOUNCE) -> DataFrame:
    """Events that none of the same key follows within ``quiet`` milliseconds."""
    by = Window.partitionBy(key).orderBy("ms", "event_id")
    return events.withColumn("next_ms", F.lead("ms").over(by)).filter((F.col("next_ms") - F.col("ms") >= quiet) | F.col("next_ms").isNull()).drop("next_ms")
