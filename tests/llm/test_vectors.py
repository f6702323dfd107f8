"""Codes and clusters of vectors against plain Python integers; their queries run against SQL with the others."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmesh.llm import clusters, codes, vectors

LAST = 2**63 - 1
SCHEMA = "vec_id long, embedding array<double>, label string"


def whole(rows, scale):
    bound = lambda x: max(-(2**63), min(LAST, math.floor(scale * x)))
    return [(i, [bound(x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def near(x, book):
    return min((far(x, c), k) for k, c in enumerate(book))


def means(points, at, book):
    own = defaultdict(list)
    for x, k in zip(points, at):
        own[k].append(x)
    return [[sum(c) // len(own[k]) for c in zip(*own[k])] if own[k] else c0 for k, c0 in enumerate(book)]


def brute_codes(rows, entries, rounds, parts=4):
    rows = whole(rows, 1024)
    wide = -(-max(len(v) for _, v, _ in rows) // parts)
    rows = [(i, v + [0] * (wide * parts - len(v)), label) for i, v, label in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    found, books = [], []
    for p in range(parts):
        cut = lambda v: v[p * wide : (p + 1) * wide]  # noqa: B023, E731
        book, points = [cut(v) for _, v, _ in first], [cut(v) for _, v, _ in rows]
        for _ in range(rounds):
            book = means(points, [near(x, book)[1] for x in points], book)
        found.append([near(x, book) for x in points])
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(f[n][0] for f in found) for n in range(len(rows))]
    totals = Counter()
    for (_, _, label), e in zip(rows, errors):
        totals[label] += min(LAST, e)
    return Counter((i, "".join(f"{f[n][1]:02x}" for f in found), min(LAST, errors[n]), min(LAST, totals[label]), digest) for n, (i, _, label) in enumerate(rows))


def brute_clusters(rows, width, k, rounds):
    rows = [r for r in whole(rows, 256) if len(r[1]) == width]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v, _ in rows if i is not None)
    book = [v for _, v in named[:k]]
    points = [v for _, v, _ in rows]
    for _ in range(rounds):
        book = means(points, [near(x, book)[1] for x in points], book)
    found = [near(x, book) for x in points]
    of = Counter()
    for d, c in found:
        of[c] += min(LAST, d)
    return Counter((i, c, min(LAST, d), min(LAST, of[c]), min(LAST, sum(min(LAST, x) for x in of.values())), hashlib.sha256(",".join(map(str, book[c])).encode()).hexdigest()) for (i, _, _), (d, c) in zip(rows, found))


def odd(large=False):
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in rng.integers(-4, 5, 8) / 7], f"l{i % 3}") for i in range(90)]
    rows += [(5, rows[5][1], None), (5, rows[5][1], "l2"), (None, [0.5] * 8, None), (200, None, "l0"), (201, [1.0, None] * 4, "l0"), (202, [float("nan")] * 8, "l1"), (203, [float("-inf")] * 8, "l1"), (204, [], "l1"), (205, [0.25] * 3, "only"), (206, rows[7][1], "l0")]
    return rows + [(300, [1e6] + [0.0] * 7, "big"), (301, [-1e16] * 8, "big"), (302, [1e300] * 8, "big"), (303, [3e12, 1.0] * 4, "big"), (304, [1e300] * 8, "big")] if large else rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("id", "vec", "code", "error", "n", "sums", "part", "entry", "cluster", "distance", "_label")}).repartition(3)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("entries", [7, 256])
def test_codes(spark, monkeypatch, large, entries):
    monkeypatch.setattr(codes, "BLOCK", 10)
    rows = odd(large)
    out = codes.compress(frame(spark, rows), "vec_id", "embedding", "label", entries=entries, rounds=2)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == brute_codes(rows, entries, 2)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("k", [5, 500])
def test_clusters(spark, large, k):
    rows = odd(large)
    out = clusters.cluster(frame(spark, rows), "vec_id", "embedding", width=8, k=k, rounds=3)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == brute_clusters(rows, 8, k, 3)


def test_without_vectors(spark):
    for rows in ([], [(1, None, "a"), (None, [float("nan")], None)], [(None, [], "a")]):
        df = spark.createDataFrame(rows, SCHEMA)
        out = codes.compress(df, "vec_id", "embedding", "label")
        assert out.count() == sum(v == [] for _, v, _ in rows) and out.columns[1:3] == ["code", "error"]
        assert clusters.cluster(df, "vec_id", "embedding").count() == 0


def test_keys_of_another_type(spark):
    df = spark.createDataFrame([("b", [1.0, 2.0], 1.5), ("a", [3.0, 4.0], 1.5)], "k string, v array<float>, l double")
    assert {r.k for r in codes.compress(df, "k", "v", "l", parts=2).collect()} == {"a", "b"}
    assert {r.k for r in clusters.cluster(df, "k", "v", width=2).collect()} == {"a", "b"}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.sampled_from([3, 2**20, 2**31, 2**62]), st.integers(0, 2**32))
def test_products_move_with_centroids(n, k, size, seed):
    rng = np.random.default_rng(seed)
    m = rng.integers(-size, size, (n, 5))
    old = rng.integers(-size, size, (k, 5))
    new = np.where(rng.random((k, 5)) < 0.5, old, rng.integers(-size, size, (k, 5)))
    exact = lambda c: m.astype(object) @ c.astype(object).T
    got = clusters.moved(m, vectors.roomy(exact(old), 5 * size * size), old, new)
    assert (got == exact(new)).all()
    norms = (m.astype(object) ** 2).sum(1)
    at, d = clusters.nearest(vectors.unpacked(*vectors.packed(norms), (n,)), vectors.unpacked(*vectors.packed(got), (n, k)), new)
    assert [(int(x), int(c)) for x, c in zip(d, at)] == [near(v, new.tolist()) for v in m.tolist()]


@given(st.lists(st.integers(-(2**80), 2**80), max_size=9))
def test_packing_keeps_values(values):
    a = np.array(values, object)
    assert vectors.unpacked(*vectors.packed(a), (len(values),)).tolist() == values if values else vectors.packed(a)[1] == b""
