"""Queries for C1 to C11. Texts are returned by digest, to keep results small."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import content as ops
from ..sources.fixtures import frame, oracle
from . import reconcile
from .registry import Query

STAMP = "2024-01-31T00-00-00-000Z"
_BL = "not regexp_matches({}, '\\S')"
_MERGE = f"""case when coalesce(local_text, '') = '' then coalesce(remote_text, '') when coalesce(remote_text, '') = '' then local_text
  when len(list_filter(range(1, least(len(string_split(local_text, chr(10))), len(string_split(remote_text, chr(10)))) + 1), lambda i: regexp_matches(string_split(local_text, chr(10))[i], '\\S') and regexp_matches(string_split(remote_text, chr(10))[i], '\\S'))) = 0
  then array_to_string(list_concat(string_split(local_text, chr(10)), list_filter(list_transform(range(1, len(string_split(remote_text, chr(10))) + 1),
    lambda i: case when regexp_matches(string_split(remote_text, chr(10))[i], '\\S') and not list_contains(string_split(local_text, chr(10)), string_split(remote_text, chr(10))[i]) and not list_contains(string_split(remote_text, chr(10))[1:i - 1], string_split(remote_text, chr(10))[i]) then string_split(remote_text, chr(10))[i] end), lambda x: x is not null)), chr(10)) end"""
_CONF = "cf as (select * from fx_versions where local_text is distinct from remote_text and base_text <> '' and base_text is distinct from remote_text)"
_AUTO = f"{_CONF}, mg as (select *, {_MERGE} as merged from cf), au as (select *, coalesce(merged, case when remote_ms > local_ms then remote_text else local_text end) as text, case when merged is not null then 'merge' when remote_ms > local_ms then 'remote' else 'local' end as method from mg)"
_DEC = "{a}, mn as (select m.*, coalesce(resolution, 'keepLocal') as res, case coalesce(resolution, 'keepLocal') when 'keepLocal' then local_text when 'keepRemote' then remote_text when 'merge' then merged end as hand from au m left join fx_decisions d on m.vault_id = d.vault_id and m.path = d.path)".format(a=_AUTO)
_FILE = f"case when strpos(path, '.') > 0 then regexp_replace(path, '^(.*)\\.([^.]*)$', '\\1.{{s}}-{STAMP}.\\2') else '.{{s}}-{STAMP}.' || path end"


def versions(spark, d):
    return frame(spark, d, "fx_versions")


def joined(spark, d):
    """The three sides as frames of their own: some documents lack one or two of them."""
    v, n = versions(spark, d), F.length("path") % 5
    side = lambda c, skip: v.filter(n != skip).select("vault_id", "path", F.col(f"{c}_text").alias("text"), F.col("local_ms" if c == "base" else f"{c}_ms").alias("ms"))
    return ops.joined_versions(side("local", 0), side("remote", 1), side("base", 2).filter("text is not null"))


def conflicts(spark, d):
    return ops.content_conflicts(versions(spark, d))


def history(spark, d):
    """Both sides as versions of one document in time."""
    v = versions(spark, d)
    side = lambda c, n: v.select("vault_id", "path", F.col(f"{c}_text").alias("text"), F.col(f"{c}_ms").alias("ms"), F.lit(n).alias("seq"))
    return side("local", 0).unionByName(side("remote", 1))


def _digest(df, text="text"):
    return df.withColumn(text, F.md5(F.col(text)))


def manual(spark, d):
    return ops.resolve_manual(conflicts(spark, d), frame(spark, d, "fx_decisions"))


def strategy():
    n = F.length("path") % 4
    return F.when(n == 0, "auto").when(n == 1, "manual").when(n == 2, "backup").otherwise("unheard-of")


QUERIES = {
    "latest_version": Query(lambda spark, d: _digest(ops.latest_version(history(spark, d))), oracle("""with h as (select vault_id, path, local_text as text, local_ms as ms, 0 as seq from fx_versions union all select vault_id, path, remote_text, remote_ms, 1 from fx_versions)
      select vault_id, path, md5(text) as text, ms from (select *, row_number() over (partition by vault_id, path order by ms desc, seq desc) as k from h) q where k = 1""", "fx_versions")),
    "content_conflicts": Query(lambda spark, d: conflicts(spark, d).select("vault_id", "path", "local_ms", "remote_ms", "is_resolvable"), oracle(f"with {_CONF} select vault_id, path, local_ms, remote_ms, is_resolvable from cf", "fx_versions")),
    "joined_versions": Query(lambda spark, d: _digest(_digest(_digest(joined(spark, d), "local_text"), "remote_text"), "base_text"), oracle("""select vault_id, path, case when length(path) % 5 <> 2 then md5(base_text) end as base_text,
      case when length(path) % 5 <> 0 then md5(local_text) end as local_text, case when length(path) % 5 <> 1 then md5(remote_text) end as remote_text,
      case when length(path) % 5 <> 0 then local_ms end as local_ms, case when length(path) % 5 <> 1 then remote_ms end as remote_ms from fx_versions""", "fx_versions")),
    "line_merge": Query(lambda spark, d: _digest(versions(spark, d).select("vault_id", "path", ops.line_merge(F.col("local_text"), F.col("remote_text")).alias("text"))), oracle(f"select vault_id, path, md5({_MERGE}) as text from fx_versions", "fx_versions")),
    "resolve_auto": Query(lambda spark, d: _digest(ops.resolve_auto(conflicts(spark, d))), oracle(f"with {_AUTO} select vault_id, path, md5(text) as text, method from au", "fx_versions")),
    "resolve_backup": Query(lambda spark, d: _digest(ops.resolve_backup(conflicts(spark, d), F.lit(STAMP))), oracle(f"""with {_CONF} select vault_id, path, 'original' as role, path as file, md5(remote_text) as text from cf
      union all select vault_id, path, 'local', {_FILE.format(s='local')}, md5(local_text) from cf union all select vault_id, path, 'remote', {_FILE.format(s='remote')}, md5(remote_text) from cf""", "fx_versions")),
    "resolve_manual": Query(lambda spark, d: _digest(manual(spark, d)), oracle(f"with {_DEC} select vault_id, path, case when res = 'backup' then 'backup' when hand is not null then res else 'unresolved' end as outcome, md5(hand) as text from mn", "fx_versions", "fx_decisions")),
    "resolve_conflicts": Query(lambda spark, d: _digest(ops.resolve_conflicts(conflicts(spark, d), frame(spark, d, "fx_decisions"), strategy(), F.lit(STAMP))), oracle(f"""with {_DEC}, w as (select *, case when not is_resolvable then 'backup' when length(path) % 4 = 1 then 'manual' when length(path) % 4 = 2 then 'backup' else 'auto' end as way from mn),
      o as (select *, case when way = 'auto' then method when way = 'manual' and res <> 'backup' then case when hand is not null then res else 'unresolved' end else 'backup' end as how from w)
      select vault_id, path, how as method, path as file, md5(case when way = 'auto' then text else hand end) as text from o where how <> 'backup'
      union all select vault_id, path, 'backup', path, md5(remote_text) from o where how = 'backup' union all select vault_id, path, 'backup', {_FILE.format(s='local')}, md5(local_text) from o where how = 'backup'
      union all select vault_id, path, 'backup', {_FILE.format(s='remote')}, md5(remote_text) from o where how = 'backup'""", "fx_versions", "fx_decisions")),
    "open_document_action": Query(lambda spark, d: ops.open_document_action(versions(spark, d)), oracle(f"""with v as (select *, coalesce(local_text, '') as e, coalesce(remote_text, '') as s from fx_versions)
      select vault_id, path, case when s = '' then 'seed' when s = e then 'none' when {_BL.format('s')} and regexp_matches(e, '\\S') then 'keep_editor' when {_BL.format('e')} then 'take_shared'
      when e is distinct from s and base_text <> '' and base_text is distinct from s then 'resolve' else 'take_shared' end as action from v""", "fx_versions")),
    "conflict_summary": Query(lambda spark, d: ops.conflict_summary(ops.typed(ops.resolve_auto(conflicts(spark, d)), reconcile.structural(spark, d))), oracle(f"""with {_AUTO}, st as ({reconcile.STRUCTURAL}),
      al as (select vault_id, 'content' as type, method from au union all select vault_id, 'structure', case when suggested = 'keepRemote' then 'remote' else 'local' end from st where outcome = 'conflict')
      select vault_id, type, method, count(*) as n, round(count(*) filter (method = 'merge') / count(*), 6) as share_merged from al group by cube(vault_id, type, method)""", "fx_versions", "fx_inventory", "fx_recent")),
    "joined_conflicts": Query(lambda spark, d: ops.content_conflicts(joined(spark, d)).select("vault_id", "path", "local_ms", "remote_ms"), oracle("""with j as (select vault_id, path, case when length(path) % 5 <> 2 then base_text end as base, case when length(path) % 5 <> 0 then local_text end as l, case when length(path) % 5 <> 1 then remote_text end as r,
        case when length(path) % 5 <> 0 then local_ms end as local_ms, case when length(path) % 5 <> 1 then remote_ms end as remote_ms from fx_versions)
      select vault_id, path, local_ms, remote_ms from j where l is distinct from r and base <> '' and base is distinct from r""", "fx_versions")),
    "three_way_status": Query(lambda spark, d: ops.three_way_status(versions(spark, d)), oracle("""select vault_id, path, case when base_text is not distinct from local_text and base_text is not distinct from remote_text then 'unchanged' when base_text is not distinct from remote_text then 'local_only'
      when base_text is not distinct from local_text then 'remote_only' when local_text is not distinct from remote_text then 'same_change' else 'both_changed' end as status from fx_versions""", "fx_versions")),
    "changed_lines": Query(lambda spark, d: ops.changed_lines(versions(spark, d)), oracle("""with l as (select vault_id, path, unnest(string_split(local_text, chr(10))) as line, generate_subscripts(string_split(local_text, chr(10)), 1) as pos, 1 as side from fx_versions
        union all select vault_id, path, unnest(string_split(remote_text, chr(10))), generate_subscripts(string_split(remote_text, chr(10)), 1), 2 from fx_versions),
      s as (select vault_id, path, pos, sum(side) as sides from l where regexp_matches(line, '\\S') group by all)
      select vault_id, path, count(*) filter (sides <> 2) as local_lines, count(*) filter (sides <> 1) as remote_lines, count(*) filter (sides = 3) as overlap from s group by all""", "fx_versions")),
}
