"""The registered queries of this subpackage: thin uses of its operators on the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytebpe, clusters, codes, dedup, html, jaccard, langid, lm, packing, topk, urlfilter, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE, decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(_table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lm.train(docs.filter(langid.remainder("doc_id", 10) != 0))
    scored = lm.score(docs, model)
    return scored.select("doc_id", (langid.remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = langid.train(docs.filter(langid.remainder("doc_id", 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (langid.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op11_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bytebpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, ends="ends", decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_packing": op2_packing, "op3_warc": op3_warc, "op4_topk": op4_topk, "op5_dedup": op5_dedup, "op6_lm": op6_lm, "op7_jaccard": op7_jaccard, "op8_langid": op8_langid, "op9_urls": op9_urls, "op10_html": op10_html, "op11_bytebpe": op11_bytebpe, "op12_codes": op12_codes, "op13_clusters": op13_clusters}


def _integers(scale: int, more: str = "") -> str:
    return f"""select vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as vec
      from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0{more}"""


#: Squared distance of two lists of integers.
_FAR = "cast(list_inner_product(cast({a} as double[]), cast({a} as double[])) - 2 * list_inner_product(cast({a} as double[]), cast({b} as double[])) + list_inner_product(cast({b} as double[]), cast({b} as double[])) as bigint)"


def _codes_sql(rounds: int = 4) -> str:
    nearest = f"""select vec_id, part, min(far) as far, arg_min(entry, far * 256 + entry) as entry from (
      select p.vec_id, p.part, entry, {_FAR.format(a='p.x', b='c')} as far from p join b{{n}} on p.part = b{{n}}.part) q group by all"""
    steps = "".join(f"""a{n} as materialized ({nearest.format(n=n)}),
      b{n + 1} as materialized (select part, entry, coalesce(m, c) as c from b{n} left join (
        select part, entry, list(m order by i) as m from (select part, entry, i, cast(floor(sum(x[i]) / count(*)) as bigint) as m from a{n} join p using (vec_id, part), range(1, 17) r(i) group by all) q group by all) u using (part, entry)),
      """ for n in range(rounds))
    return f"""with v as materialized ({_integers(1024)}), p as materialized (select vec_id, part, vec[part * 16 + 1 : part * 16 + 16] as x from v, range(4) r(part)),
      b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c from p where vec_id in (select vec_id from v order by vec_id limit 256)),
      {steps}l as materialized ({nearest.format(n=rounds)}),
      s as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as digest from b{rounds}),
      e as (select vec_id, label, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(far) as bigint) as error from l join v using (vec_id) group by all)
      select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, digest as codebooks_sha256 from e, s"""


def _clusters_sql(rounds: int = 5) -> str:
    nearest = f"""select vec_id, min(far) as far, arg_min(k, far * 64 + k) as k from (select vec_id, k, {_FAR.format(a='vec', b='c')} as far from v, c{{n}}) q group by all"""
    steps = "".join(f"""a{n} as materialized ({nearest.format(n=n)}),
      c{n + 1} as materialized (select k, coalesce(m, c) as c from c{n} left join (
        select k, list(m order by i) as m from (select k, i, cast(floor(sum(vec[i]) / count(*)) as bigint) as m from a{n} join v using (vec_id), range(1, 65) r(i) group by all) q group by all) u using (k)),
      """ for n in range(rounds))
    return f"""with v as materialized ({_integers(256, " and len(embedding) = 64")}),
      c0 as materialized (select row_number() over (order by sha256('2:' || vec_id)) - 1 as k, vec as c from v qualify k < 40),
      {steps}l as materialized ({nearest.format(n=rounds)})
      select vec_id, cast(k as integer) as cluster, far as distance, cast(sum(far) over (partition by k) as bigint) as cluster_inertia, cast(sum(far) over () as bigint) as inertia,
        sha256(array_to_string(c, ',')) as centroid_sha256 from l join c{rounds} using (k)"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return {
        "op3_warc": """
            with p as (select page_id, coalesce(html, '') as body from pages),
            d as (select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest from p),
            f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
            select page_id, payload_bytes, payload_digest,
              case when first_id <> page_id then 'revisit' else 'response' end as record_type,
              case when first_id <> page_id then first_id end as refers_to
            from d left join f using (payload_digest)""",
        "op4_topk": """
            with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as vec
              from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(cast(q.vec as double[]), cast(c.vec as double[])) as bigint) as score
              from v q, v c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
            select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
        "op5_dedup": """
            with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as body from documents),
            g as (select body, min(doc_id) as keep_id, count(*) as group_size from n group by 1)
            select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from n join g using (body)""",
        "op9_urls": f"""
            with u as (select page_id, url, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']), {{'host': '', 'path': ''}}) as x from pages),
            p as (select page_id, translate(coalesce(x.host, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(x.path, '') as path from u),
            r(verdict, h, s) as (values {rules}),
            m as (select page_id, r.verdict, h || s as rule, row_number() over (partition by page_id order by length(h || s) desc) as nth
              from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s))
            select p.page_id, host, path, rule, coalesce(m.verdict, 'allow') as verdict from p left join m on p.page_id = m.page_id and nth = 1""",
        "op12_codes": _codes_sql(),
        "op13_clusters": _clusters_sql(),
    }
