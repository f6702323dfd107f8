"""Queries for sources and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators.admission import flags
from ..sources import io
from ..sources.fixtures import frame, oracle
from .registry import Query

TOKEN = "secret-1"
_VALID = "regexp_full_match(vault_id, '[A-Za-z0-9_-]{1,128}')"
_USER = "case when coalesce(user_id, '') = '' then 'anonymous' when regexp_full_match(user_id, '[A-Za-z0-9_.@-]{1,64}') then user_id end"
_ORIGIN = "coalesce(regexp_full_match(origin, 'https?://(localhost|127\\.0\\.0\\.1)(:[0-9]+)?'), false)"
_TOKEN_OK = f"coalesce(length(token) <= 256 and regexp_full_match(token, '[A-Za-z0-9_.-]+') and token = '{TOKEN}', false)"
_REDACT = """coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(text, '/[a-zA-Z0-9/_.-]+', '[PATH]', 'g'),
  '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', '[IP]', 'g'), '[a-zA-Z0-9_-]{20,}', '[TOKEN]', 'g'), 1, 200), ''), 'An error occurred')"""


def conn_log(spark, d):
    """Every row with its client address: the log's own, else one from the user."""
    log = frame(spark, d, "fx_conn")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.col("ip")).when(F.col("event_id") % 3 == 1, F.lit(""))
    real = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("192.0.2."), F.col("event_id") % 250))
    socket = F.when(F.col("event_id") % 7 != 0, F.col("ip"))
    return log.select("event_id", "kind", "connection_id", "msg_bytes", io.client_ip(forwarded, real, socket).alias("client_ip"))


def op_queue_json(spark, d):
    """Queues written as JSON and read again; each seventh user's is damaged and so empty."""
    ops = frame(spark, d, "fx_ops")
    queues = io.write_queue(ops, "vault_id", "user_id")
    damaged = queues.withColumn("queue", F.when(F.substring("user_id", -1, 1) == "7", F.lit("[{")).otherwise(F.col("queue")))
    return io.read_queue(damaged.drop("user_id")).groupBy("vault_id", F.col("userId").alias("user_id"), "type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("newPath").alias("last_new_path"))


def request_params(spark, d):
    p = io.request_params(frame(spark, d, "fx_urls"), "request")
    return p.select("page_id", rules.vault_id(F.col("vault_id")).alias("vault_id"), rules.user_id(F.col("user_id")).alias("user_id"), "token")


def validated(spark, d):
    log = flags(frame(spark, d, "fx_conn"), TOKEN)
    reason = F.when(~F.col("vault_ok"), "vault_id").when(~F.col("user_ok"), "user_id")
    return log.withColumns({"user": rules.user_id(F.col("user_id")), "reason": reason})


def validate_conn(spark, d):
    return validated(spark, d).select("event_id", F.when(F.col("reason").isNull(), F.col("vault_id")).alias("vault_id"), F.when(F.col("reason").isNull(), F.col("user")).alias("user_id"), "reason")


def validation_summary(spark, d):
    """Counts for each rule and outcome, each rule, and all."""
    rows = validated(spark, d)
    outcomes = F.array(*[F.struct(F.lit(r).alias("rule"), F.when(F.col(f"{r}_ok"), "pass").otherwise("fail").alias("outcome")) for r in ("origin", "token", "vault", "user", "size")])
    return rows.select(F.explode(outcomes).alias("o")).rollup("o.rule", "o.outcome").agg(F.count(F.lit(1)).alias("n"))


def valid_token(spark, d):
    """Some requests have an authorization header: the token, the token behind a scheme, or nothing."""
    k = F.col("event_id") % 7
    header = F.when(k == 0, TOKEN).when(k == 1, "Bearer " + TOKEN).when(k == 2, "")
    return frame(spark, d, "fx_conn").select("event_id", rules.token_ok(rules.given_token(header, F.col("token")), F.lit(TOKEN)).alias("valid"))


def safe_path(spark, d):
    """Paths of documents, some climbing out, some absolute, held against a base."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    k = F.col("doc_id") % 6
    path = F.when(k == 0, F.concat_ws("/", "source", F.lit(".."), "lang")).when(k == 1, F.concat(F.lit("../../"), "source")).when(k == 2, F.concat(F.lit("/safe/directory/"), "source")).when(k == 3, F.concat(F.lit("a b/"), "source")).when(k == 4, F.concat(F.lit("./x/.//"), "lang")).otherwise(F.concat(F.lit("/safe/directoryx/"), "source"))
    return docs.select("doc_id", path.alias("path")).select("doc_id", "path", rules.safe_path(F.col("path"), "/safe/directory").alias("resolved"))


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def redaction_counts(spark, d):
    hits = {"paths": rules.HIDE_PATH, "addresses": rules.HIDE_IP, "tokens": rules.HIDE_TOKEN}
    each = [F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).alias(n) for n, p in hits.items()]
    return _docs(spark, d).select("doc_id", *each)


QUERIES = {
    "conn_log": Query(conn_log, oracle("""select event_id, kind, connection_id, msg_bytes, coalesce(nullif(case when event_id % 3 = 0 then ip when event_id % 3 = 1 then '' end, ''),
        case when event_id % 5 = 0 then concat('192.0.2.', event_id % 250) end, case when event_id % 7 <> 0 then ip end, 'unknown') as client_ip from fx_conn""", "fx_conn")),
    "op_queue_json": Query(op_queue_json, oracle("""select vault_id, user_id, type, count(*) as n, min(seq) as first_seq, max(new_path) as last_new_path
        from fx_ops where not ends_with(user_id, '7') group by all""", "fx_ops")),
    "inventory": Query(lambda spark, d: io.inventory(frame(spark, d, "fx_inventory")), oracle("select distinct vault_id, replica, path, false as is_folder from fx_inventory", "fx_inventory")),
    "document_snapshot": Query(lambda spark, d: io.document_key(frame(spark, d, "fx_versions")).select("document", F.length("local_text").alias("n_local"), "local_ms"), oracle("select concat(vault_id, '/', path) as document, length(local_text) as n_local, local_ms from fx_versions", "fx_versions")),
    "request_params": Query(request_params, oracle("""select page_id, case when regexp_full_match(v, '[A-Za-z0-9_-]{1,128}') then v end as vault_id,
        case when u = '' then 'anonymous' when regexp_full_match(u, '[A-Za-z0-9_.@-]{1,64}') then u end as user_id, nullif(trim(t), '') as token
        from (select page_id, url_decode(regexp_extract(request, '[?&]vaultId=([^&#]*)', 1)) as v, url_decode(regexp_extract(request, '[?&]userId=([^&#]*)', 1)) as u, url_decode(regexp_extract(request, '[?&]token=([^&#]*)', 1)) as t from fx_urls) q""", "fx_urls")),
    "valid_vault_id": Query(lambda spark, d: frame(spark, d, "fx_conn").select("event_id", rules.vault_id(F.col("vault_id")).alias("valid")), oracle(f"select event_id, case when {_VALID} then vault_id end as valid from fx_conn", "fx_conn")),
    "valid_user_id": Query(lambda spark, d: frame(spark, d, "fx_conn").select("event_id", rules.user_id(F.col("user_id")).alias("valid")), oracle(f"select event_id, {_USER} as valid from fx_conn", "fx_conn")),
    "valid_token": Query(valid_token, oracle(f"""with h as (select event_id, token as t, case event_id % 7 when 0 then 'secret-1' when 1 then 'Bearer secret-1' when 2 then '' end as header from fx_conn),
        g as (select event_id, coalesce(nullif(header, ''), t) as token from h) select event_id, {_TOKEN_OK} as valid from g""", "fx_conn")),
    "valid_message_size": Query(lambda spark, d: _docs(spark, d).select("doc_id", rules.size_ok(F.col("text")).alias("valid"), F.octet_length("text").alias("n_bytes")), "select doc_id, coalesce(strlen(text), 0) <= 1048576 as valid, cast(strlen(text) as integer) as n_bytes from documents"),
    "safe_path": Query(safe_path, """with p as (select doc_id, case doc_id % 6 when 0 then source || '/../' || lang when 1 then '../../' || source when 2 then '/safe/directory/' || source when 3 then 'a b/' || source when 4 then './x/.//' || lang else '/safe/directoryx/' || source end as path from documents),
        r as (select *, '/' || ltrim(list_reduce(list_prepend('', list_filter(string_split(case when starts_with(path, '/') then path else '/safe/directory/' || path end, '/'), lambda x: x not in ('', '.'))),
          lambda a, x: case when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end), '/') as full_path from p)
        select doc_id, path, case when length(path) <= 4096 and regexp_full_match(path, '[A-Za-z0-9_/.-]+') and (full_path = '/safe/directory' or starts_with(full_path, '/safe/directory/')) then full_path end as resolved from r"""),
    "valid_origin": Query(lambda spark, d: frame(spark, d, "fx_conn").select("event_id", rules.origin_ok(F.col("origin")).alias("local_ok"), rules.origin_ok(F.col("origin"), ["https://other.example"]).alias("listed_ok")), oracle(f"select event_id, {_ORIGIN} as local_ok, origin = 'https://other.example' as listed_ok from fx_conn", "fx_conn")),
    "validate_conn": Query(validate_conn, oracle(f"""with c as (select event_id, case when {_VALID} then vault_id end as v, {_USER} as u from fx_conn)
        select event_id, case when v is not null and u is not null then v end as vault_id, case when v is not null and u is not null then u end as user_id,
        case when v is null then 'vault_id' when u is null then 'user_id' end as reason from c""", "fx_conn")),
    "validation_summary": Query(validation_summary, oracle(f"""with c as (select {_ORIGIN} as origin, {_TOKEN_OK} as token, coalesce({_VALID}, false) as vault, {_USER} is not null as usr, coalesce(msg_bytes, 0) <= 1048576 as size from fx_conn),
        o as (select 'origin' as rule, origin as ok from c union all select 'token', token from c union all select 'vault', vault from c union all select 'user', usr from c union all select 'size', size from c)
        select rule, case when ok then 'pass' else 'fail' end as outcome, count(*) as n from o group by rollup(rule, case when ok then 'pass' else 'fail' end)""", "fx_conn")),
    "redact_log": Query(lambda spark, d: _docs(spark, d).select("doc_id", rules.redacted(F.col("text")).alias("line")), f"select doc_id, {_REDACT} as line from documents"),
    "redaction_counts": Query(redaction_counts, """select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '/[a-zA-Z0-9/_.-]+')) as integer) as paths,
        cast(len(regexp_extract_all(coalesce(text, ''), '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b')) as integer) as addresses,
        cast(len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_-]{20,}')) as integer) as tokens from documents"""),
    "normalise_endpoints": Query(lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", rules.endpoint(F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?:", "")).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))).alias("endpoint")), """
        with u as (select page_id, case page_id % 3 when 0 then regexp_replace(url, '^https?:', '') when 1 then regexp_replace(url, '^https?://', '') else url end as url from pages)
        select page_id, case when regexp_matches(url, '^wss?://') then url when starts_with(url, 'https://') then 'wss://' || url[9:] when starts_with(url, 'http://') then 'ws://' || url[8:]
        when url is not null then 'wss://' || regexp_replace(url, '^//', '') end as endpoint from u"""),
}
