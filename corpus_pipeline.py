"""A training-data pipeline over ``documents``: language, exact copies, near copies, packing.

Each stage is ``f(spark, docs, sf_dir)``; its result is written as Parquet and read as the next one's ``docs``. All
stages read every row and whole texts. Null keys are kept apart from each other; null texts are empty texts. An empty
table passes through every stage. Extra columns of ``docs`` pass through the filtering stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm import dedup, jaccard, langid, packing
from inkmesh.llm.common import written
from inkmesh.llm.queries import WORD_BPE

#: Pooled probability below which the language stage rejects a text as no language that it knows.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and texts in which no language is likely."""
    net = langid.train(docs)
    judged = langid.identify(docs, net, pred="_cp_lang", score="_cp_score")
    return judged.filter((F.col("_cp_lang") != "und") & (F.col("_cp_score") >= LEAST_SCORE)).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of texts equal but for white space, the row with the smallest doc_id, once."""
    return dedup.first_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest doc_id.
    Rows are told apart by doc_id and text, so one that only shares its doc_id with a near copy stays."""
    found = jaccard.linked_sets(docs, "doc_id", "text", width=5, threshold=jaccard.Fraction(8, 10))
    gone = found.filter("not first").select(F.col("key").alias("_cp_id"), F.col("at").alias("_cp_at")).distinct()
    rows = docs.withColumn("_cp_is", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    same = (F.col("_cp_is") == F.col("_cp_at")) & F.col("doc_id").eqNullSafe(F.col("_cp_id"))
    return rows.join(gone, same, "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2048 tokens; one row per piece."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("language", language), ("exact", exact), ("near", near), ("packing", pack)]

#: SQL has neither the network of the first stage nor the fitted patterns of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
