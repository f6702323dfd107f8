"""The pipeline against a plain version of its filters, and every stage on odd tables."""

import re
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkmesh.llm import bpe, jaccard, langid
from ..conftest import DATA
from .test_operators import PATH, brute_components, check_packing, docs


def test_run_equals_brute_force(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    check_packing(rows, 2048)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = {k: t for k, t in texts.items() if any(c.isalpha() for c in t or "")}
    norm = {}
    for k in sorted(kept):
        norm.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[k]), k)
    exact = {k: kept[k] for k in norm.values()}
    found = brute_components(sorted(exact.items()), 5, Fraction(8, 10))
    want = {k for k, (_, c) in found.items() if c == k}
    got = {r.doc_id for r in rows}
    assert got <= want and len(want - got) <= 2  # the language stage may reject a text without any likely language


def test_stages_on_odd_tables(spark):
    df = docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns
        assert out.count() <= df.count()
        assert stage(spark, df.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, df, DATA).count() >= df.count()
    assert corpus_pipeline.exact(spark, df, DATA).filter("doc_id = 4").count() == 1


def test_near_tells_rows_of_one_id_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (2, text(1) + " z"), (2, text(2)), (3, text(2) + " z"), (None, text(3)), (None, text(3) + " z"), (4, text(4)), (None, text(4) + " z"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near(spark, df, DATA).collect()}
    assert {(1, text(1)), (2, text(2)), (4, text(4)), (5, "")} <= left and len(left) == 5
    assert {t for k, t in left if k is None} < {text(3), text(3) + " z"}


@pytest.mark.parametrize("later", [lambda df: langid.identify(df, None).agg(F.max("score")), lambda df: jaccard.near_duplicates(df).agg(F.max("n_shingles"))])
def test_later_stages_free_what_packing_left_in_the_workers(spark, later):
    df = spark.range(0, 64, 1, 32).selectExpr("id as doc_id", "concat('some words ', id) as text")  # each worker gets a task of each job

    def loaded(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.WordBpe._loaded)])], ["n"])

    left = lambda: df.mapInArrow(loaded, "n long").agg(F.max("n")).first()[0]
    bpe.encode(df, PATH).agg(F.sum("n_tokens")).collect()
    assert left() == 1
    later(df).collect()
    assert left() == 0
