"""Running sums over keys of any size: rows in runs of equal size instead of one task for each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def running(df: DataFrame, keys: list[str], order: list[str], change: str) -> DataFrame:
    """``df`` with ``total``, the running sum of ``change`` over a key's rows in ``order``, and ``low``, the lowest such sum so far.

    Rows are ranged by key and order, so that runs are equal in size whatever the keys' sizes, and written, which fixes the runs.
    Inside a run, sums are windows by key; a key's runs, as many as partitions at most, carry sum and lowest point on. ``keys`` may
    be empty. Nulls in ``change`` count as 0; rows that tie in ``order`` come in any order.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(width, *keys, *order).withColumn("_run", F.spark_partition_id()), "runs")
    by = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("_sum", F.sum(F.coalesce(change, F.lit(0))).over(by)).withColumn("_low", F.min("_sum").over(by))
    runs = inside.groupBy(*keys, "_run").agg(F.sum(F.coalesce(change, F.lit(0))).alias("_all"), F.min("_sum").alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    start = runs.withColumn("_start", F.coalesce(F.sum("_all").over(before), F.lit(0))).withColumn("_floor", F.min(F.col("_start") + F.col("_least")).over(before))
    named = start.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)], F.col("_run").alias("_of"), "_start", "_floor")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)], F.col("_run") == F.col("_of"))
    found = inside.join(named, same)
    total, low = F.col("_start") + F.col("_sum"), F.least("_floor", F.col("_start") + F.col("_low"))
    return found.select(*df.columns, total.alias("total"), low.alias("low"))
