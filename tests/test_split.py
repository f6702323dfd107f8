"""A hot key cut into spans gives the rows of the fold."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmesh.functions.folds import Throttle
from inkmesh.operators import admission, split


def spans_of(ms, window):
    numbers = ms // (split.SPAN * window)
    return [ms[numbers == n] for n in dict.fromkeys(numbers.tolist())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=120), st.integers(0, 4), st.integers(1, 30), st.sampled_from([None, 0, 7, 40]), st.sampled_from([1, 2, 64]))
def test_summaries_hand_over_what_the_fold_reaches(gaps, most, window, after_reset, span):
    before, split.SPAN = split.SPAN, span
    try:
        ms = np.cumsum(np.array(gaps, np.int64)) + 1000
        whole, scanned = Throttle(), Throttle()
        for own in spans_of(ms, window):
            found = split.chains(own, most, window, after_reset)
            row = {"n": len(own)} | {f"{c}s": v.tobytes() for c, v in found.items()}
            assert split._hand_over(scanned, row, most, after_reset) == (whole.count, whole.reset, whole.violations)
            for t in own.tolist():
                whole.step(t, most, window, after_reset)
            assert (scanned.count, scanned.reset, scanned.violations) == (whole.count, whole.reset, whole.violations)
    finally:
        split.SPAN = before


@pytest.mark.parametrize("after_reset", [None, 5_000])
def test_hot_keys_equal_the_fold(spark, after_reset):
    rng = np.random.default_rng(4)
    rows = [("hot", int(t), k) for k, t in enumerate(np.sort(rng.integers(0, 4_000_000, 4000)))] + [("cold", 10, 1), (None, 5, 2), (None, 6, 3)]
    df = spark.createDataFrame(rows, "ip string, ms long, event_id long").repartition(4)
    cut = admission.rate_limit(df, "ip", 2, 2000, after_reset, hot=1)
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, admission.rate_limit(df, "ip", 2, 2000, after_reset).collect()))
    assert admission.rate_limit(df.limit(0), "ip", 2, 2000, after_reset, hot=1).count() == 0


def test_one_key_of_a_million_rows_uses_all_tasks(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("one").alias("ip"), (F.col("id") * 37 + F.col("id") * 7919 % 900).alias("ms"), F.col("id").alias("event_id"))
    cut = admission.rate_limit(df, "ip", 20, 1000, hot=100_000)
    sums = cut.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed"), F.sum("violations"), F.sum("reset_ms"), F.sum(F.col("event_id") * F.coalesce("remaining", F.lit(-1)))).collect()
    assert len([r for r in sums if r.n > n // 20]) >= 4
    ids = np.arange(n)
    ms = ids * 37 + ids * 7919 % 900
    order, t, want = np.lexsort((ids, ms)), Throttle(), [n, 0, 0, 0, 0]
    for now, event in zip(ms[order].tolist(), order.tolist()):
        allowed, remaining, _ = t.step(now, 20, 1000)
        want = [n, want[1] + allowed, want[2] + t.violations, want[3] + t.reset, want[4] + event * (-1 if remaining is None else remaining)]
    assert [sum(r[k] for r in sums) for k in range(1, 6)] == want
