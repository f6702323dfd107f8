"""Operator 5: exact deduplication by skew-safe combining.

Three combines, each grouping by digest *and* full content: within a task (Spark's partial
aggregation), across the tasks that share a salt, and across salts. The salt is the number of the
reading task, so all copies that a task holds leave it as one row, and a text that fills a third of
the table reaches the last combine as ``salts`` rows at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written


def normalised(text: Column) -> Column:
    """Null is empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def groups(rows: DataFrame, salts: int) -> DataFrame:
    """One row per distinct content of ``rows(_dd_key, _dd_text, _dd_digest)``."""
    salted = (
        rows.withColumn("_dd_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_dd_digest", "_dd_salt", "_dd_text")
        .agg(F.min("_dd_key").alias("_dd_key"), F.count(F.lit(1)).alias("_dd_n"))
    )
    return salted.groupBy("_dd_digest", "_dd_text").agg(F.min("_dd_key").alias("keep_id"), F.sum("_dd_n").alias("group_size"))


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row of ``df`` (``key`` and ``text`` only) with ``keep_id, group_size, kept, text_sha256``.

    Null texts count as empty and form a group with empty ones. Ties go to the smallest key; rows that repeat a key
    with the same text all count and carry the same verdict; null keys are never smallest unless all are null. An
    empty table gives an empty result; other columns of ``df``, whatever their names, take no part. Rows find their
    group by digest, those of a very frequent digest in many tasks; where a digest covers several contents, which the
    combines would show, by content as well.
    """
    content = normalised(F.col(text))
    rows = df.select(F.col(key).alias("_dd_key"), content.alias("_dd_text")).withColumns({"_dd_digest": digest(F.col("_dd_text")), "_dd_sha": sha256(F.col("_dd_text"))})
    found = written(groups(rows, salts).select("_dd_digest", "keep_id", "group_size"), "dedup")
    if found.groupBy("_dd_digest").count().filter("count > 1").isEmpty():  # each digest stands for one content
        several = found.filter("group_size > 1")
        joined = hot_join(rows.drop("_dd_text"), several, "_dd_digest", several.select("_dd_digest", F.col("group_size").alias("n")), "left")
    else:
        joined = rows.join(groups(rows, salts), ["_dd_digest", "_dd_text"], "left")
    keep = F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("_dd_key"))
    return joined.select(
        F.col("_dd_key").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_dd_key").eqNullSafe(keep).alias("kept"),
        F.col("_dd_sha").alias("text_sha256"),
    )


def first_rows(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One whole row of ``df`` for each content: that with the smallest key.

    The row travels inside the same three combines, so nothing is joined back; a text that differs from its normalised form
    lies next to it there, where the shuffle's compression finds it again. Nulls and ties are as in ``exact_dedup``; of rows that
    share key and content, one of a fixed order stays.
    """
    order = F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(*df.columns))
    row = df.select(F.struct(*df.columns).alias("_dd_row"), order.alias("_dd_order"), normalised(F.col(text)).alias("_dd_text"))
    salted = row.withColumns({"_dd_digest": digest(F.col("_dd_text")), "_dd_salt": F.pmod(F.spark_partition_id(), F.lit(salts))})
    least = lambda: [F.min_by("_dd_row", "_dd_order").alias("_dd_row"), F.min("_dd_order").alias("_dd_order")]
    by_salt = salted.groupBy("_dd_digest", "_dd_salt", "_dd_text").agg(*least())
    return by_salt.groupBy("_dd_digest", "_dd_text").agg(*least()).select("_dd_row.*")
