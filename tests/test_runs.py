"""Running sums in runs of equal size: any number of runs, keys of any size, null keys."""

import pytest
from pyspark.sql import functions as F

from inkmesh.operators import sessions
from inkmesh.operators.runs import running


@pytest.mark.parametrize("width", [1, 3, 50])
def test_equal_plain_sums(spark, width):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        key = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.concat(F.lit("k"), F.col("id") % 5))
        rows = spark.range(400).select(key.alias("ip"), (F.col("id") % 97).alias("ms"), F.col("id").alias("event_id"), F.when(F.xxhash64("id") % 5 < 1, "connect").otherwise("disconnect").alias("kind"))
        plain = sorted(rows.collect(), key=lambda r: (r.ms, r.event_id))
        for own in (None, "ip"):
            open_, want = {}, []
            for r in plain:
                k = r.ip if own else "all"
                open_[k] = max(0, open_.get(k, 0) + (1 if r.kind == "connect" else -1))
                want.append((*([r.ip] if own else []), r.ms, r.event_id, open_[k]))
            assert sorted(map(repr, map(tuple, sessions.connection_gauge(rows, own, split=True).collect()))) == sorted(map(repr, want))
        assert sessions.connection_gauge(rows.limit(0), None).count() == 0
        sums = running(rows.withColumn("x", F.when(F.col("event_id") % 3 > 0, F.col("event_id"))), [], ["event_id"], "x")
        assert sums.agg(F.max("total")).first()[0] == sum(k for k in range(400) if k % 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
