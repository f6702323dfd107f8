"""Views over the given tables in the shapes of the operators' inputs; each runs in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "fx_conn": """
select event_id, ts,
  concat('c', cast(user_id as varchar(9)), '-', cast(event_id % 3 as varchar(9))) as connection_id,
  concat('10.0.0.', cast(user_id % 25 as varchar(9))) as ip,
  case when event_id % 11 = 0 then 'https://other.example' else 'http://localhost:3000' end as origin,
  case when event_id % 17 = 0 then 'bad id!' else concat('vault-', cast(user_id % 10 as varchar(9))) end as vault_id,
  case when event_id % 19 = 0 then '' else concat('u', cast(user_id as varchar(9))) end as user_id,
  case when event_id % 13 = 0 then 'wrong' else 'secret-1' end as token,
  case event_type when 'signup' then 'connect' when 'error' then 'disconnect' else 'message' end as kind,
  case when event_type = 'view' then 'in' when event_type in ('click', 'purchase') then 'out' end as direction,
  cast(floor(value * 4096) as bigint) as msg_bytes
from events
""",
    "fx_ops": """
select event_id as id, event_id as seq,
  case event_type when 'signup' then 'create' when 'error' then 'delete' when 'view' then 'modify'
    when 'click' then 'rename' else 'createFolder' end as type,
  ts, concat('vault-', cast(user_id % 10 as varchar(9))) as vault_id,
  concat('u', cast(user_id as varchar(9))) as user_id,
  concat('n', cast(cast(floor(value) as bigint) % 20 as varchar(9)), '.md') as path,
  case when event_type = 'click' and event_id % 50 <> 0
    then concat('n', cast((cast(floor(value) as bigint) + 7) % 20 as varchar(9)), '.md') end as new_path,
  props as content
from events
""",
    "fx_inventory": """
select source as vault_id, 'local' as replica,
  concat(source, '/', lang, '/', cast(doc_id as varchar(9)), '.md') as path
from documents where doc_id % 3 <> 0
union all
select source as vault_id, 'remote' as replica,
  concat(source, '/', lang, '/', cast(doc_id as varchar(9)), '.md') as path
from documents where doc_id % 5 <> 0
""",
    "fx_versions": """
select source as vault_id, concat(lang, '/', cast(doc_id as varchar(9)), '.md') as path,
  case when doc_id % 7 <> 0 then text end as base_text,
  case when doc_id % 10 = 9 then concat('alpha', chr(10), chr(10), 'beta')
    when doc_id % 4 = 0 then concat(text, chr(10), 'local') when doc_id % 4 = 1 then '' else text end as local_text,
  case when doc_id % 10 = 9 then concat(chr(10), 'gamma', chr(10))
    when doc_id % 3 = 0 then concat(text, chr(10), 'remote') else text end as remote_text,
  1704067200000 + doc_id * 1000 as local_ms,
  1704067200000 + ((doc_id * 7919) % 100000) * 1000 as remote_ms,
  doc_id % 23 <> 0 as is_resolvable
from documents
""",
    "fx_presence": """
select concat('u', cast(user_id as varchar(9))) as client_id, ts,
  concat('vault-', cast(user_id % 10 as varchar(9))) as vault_id,
  concat('user ', cast(user_id as varchar(9))) as name,
  case when event_type = 'purchase' then null
    else concat('n', cast(cast(floor(value) as bigint) % 20 as varchar(9)), '.md') end as current_file,
  event_type = 'error' as is_null, event_id as seq
from events
""",
    "fx_status": """
select concat('u', cast(user_id as varchar(9))) as client_id, ts, event_id,
  case event_type when 'signup' then 'connected' when 'error' then 'disconnected'
    when 'click' then 'connecting' when 'view' then 'connected' else 'syncing' end as status
from events
""",
}
#: Further views of the same kind: replicas' recent operations, group members, decisions, request urls.
VIEWS |= {
    "fx_recent": """
select vault_id, replica, op, path, ts from (
  select concat('src', cast(event_id % 20 as varchar(9))) as vault_id,
    case when event_id % 2 = 0 then 'local' else 'remote' end as replica,
    case event_id % 3 when 0 then 'create' when 1 then 'delete' else 'rename' end as op,
    concat('src', cast(event_id % 20 as varchar(9)), '/en/', cast(event_id % 1000 as varchar(9)), '.md') as path, ts
  from events) t
""",
    "fx_members": """
select concat('vault-', cast(user_id % 10 as varchar(9))) as vault_id, concat('u', cast(user_id as varchar(9))) as user_id,
  case when event_type = 'purchase' then 'admin' when event_type = 'click' then 'write' else 'read' end as permission, ts, event_id
from events where event_type in ('purchase', 'click', 'view')
""",
    "fx_decisions": """
select source as vault_id, concat(lang, '/', cast(doc_id as varchar(9)), '.md') as path,
  case doc_id % 6 when 0 then 'keepLocal' when 1 then 'keepRemote' when 2 then 'merge' when 3 then 'backup' when 4 then 'other' end as resolution
from documents where doc_id % 5 <> 0
""",
    "fx_urls": """
select page_id, concat(url, case when strpos(url, '?') > 0 then '&' else '?' end, 'vaultId=vault-', cast(page_id % 7 as varchar(9)),
  case when page_id % 11 = 0 then '%20x' else '' end,
  case when page_id % 3 = 0 then '' else concat('&userId=u', cast(page_id % 50 as varchar(9))) end,
  case when page_id % 4 = 0 then '' else concat('&token=secret-', cast(page_id % 9 as varchar(9))) end) as request
from (select page_id, case when strpos(url, '#') > 0 then substring(url, 1, strpos(url, '#') - 1) else url end as url from pages where url is not null) t
""",
}


def tables_of(name: str) -> list[str]:
    return sorted(set(re.findall(r"from (events|documents|pages)\b", VIEWS[name])))


def frame(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A view of ``VIEWS`` over the tables in ``sf_dir``, or over the tables' files as a stream."""
    sql, given = VIEWS[name], {}
    for table in tables_of(name):
        sql = re.sub(rf"from {table}\b", f"from {{{table}}}", sql)
        path = f"{sf_dir}/{table}.parquet"
        rows = spark.read.parquet(path)
        given[table] = file_stream(spark, sf_dir, table, rows.schema) if stream else rows
    return spark.sql(sql.replace("strpos(", "instr("), **given)


def file_stream(spark: SparkSession, sf_dir: str, table: str, schema) -> DataFrame:
    """The files of a table as a stream; the pattern lets a table be one file or a folder of files."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parq[u]et")


def with_ms(df: DataFrame, ts: str = "ts", ms: str = "ms") -> DataFrame:
    """Adds the epoch milliseconds of a timestamp, whatever the session's time zone."""
    return df.withColumn(ms, F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))"))


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL: ``body`` after the named views, each with ``ms`` where it has ``ts``."""
    ctes = [f"{n} as (select *{', epoch_us(ts) // 1000 as ms' if ' ts' in VIEWS[n] else ''} from ({VIEWS[n]}) v)" for n in names]
    body = body.strip()
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(ctes) + (", " + body[5:] if body.lower().startswith("with ") else "\n" + body)
