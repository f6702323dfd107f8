"""Operator 13: clustering vectors around centroids with a distance matrix that is kept up to date.

Every vector keeps its exact integer products with all centroids. When centroids move, only the components that changed are
multiplied again and added to the products; squared norms and products then give all distances, and the nearest centroid is
their argmin. A round writes the products and each chunk's sums for the next centroids in one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .vectors import CHUNKS, LAST, chunked, each, exact_sum, grouped, integers, items, largest, packed, roomy, saturated, unpacked

_STATE = "kind string, vecs binary, norm_kind string, norms binary, dot_kind string, dots binary"
_SUMS = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38)))]))


def _state(m: np.ndarray, norms: np.ndarray, dots: np.ndarray) -> dict[str, object]:
    names = _STATE.replace(",", "").split()[::2]
    return dict(zip(names, (x for a in (m, norms, dots) for x in packed(a))))


def moved(m: np.ndarray, dots: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Products with the new centroids: those with the old ones, and what the changed components add."""
    change = new.astype(object) - old.astype(object)
    most = m.shape[1] * (largest(m) + 1) * max(largest(old), largest(new), largest(change))
    dots, by = roomy(dots, 2 * most).copy(), change if most > LAST else change.astype(np.int64)
    rows = m.astype(float) if most < 2**53 else roomy(m, most)
    for c in range(len(new)):
        at = np.flatnonzero(by[c] != 0)
        if len(at):
            dots[:, c] += (rows[:, at] @ by[c, at].astype(rows.dtype)).astype(dots.dtype)
    return dots


def nearest(norms: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the smaller number of equally near, and its squared distance."""
    wide = centroids.astype(object)
    own = (wide * wide).sum(1)
    room = largest(norms) + 2 * largest(dots) + max(own, default=0)
    far = roomy(norms, room)[:, None] - 2 * roomy(dots, room) + (own if room > LAST else own.astype(np.int64))
    at = far.argmin(1)
    return at, far[np.arange(len(at)), at]


def _opened(chunk: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape = lambda kind, raw: (chunk["n"], -1)
    return tuple(unpacked(chunk[k], chunk[v], shape(k, v)) for k, v in (("kind", "vecs"), ("norm_kind", "norms"), ("dot_kind", "dots")))


def _advance(chunks: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The chunks with products for the new centroids, and their vectors' sums by nearest centroid."""
    kind = dict(chunks.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in each(batches):
            m, norms, dots = _opened(chunk)
            dots = moved(m, dots, old, new)
            at, _ = nearest(norms[:, 0], dots, new)
            sums = [{"cluster": c, "n": n, "sums": list(map(Decimal, s))} for c, n, s in zip(*(x.tolist() for x in grouped(at, m)))]
            made = _state(m, norms, dots)
            yield pa.RecordBatch.from_arrays([row.column("n"), row.column("id"), *(pa.array([v]) for v in made.values()), pa.array([sums], _SUMS)], ["n", "id", *made, "sums"])

    return chunks.mapInArrow(run, f"n int, id {kind}, {_STATE}, sums array<struct<cluster: int, n: long, sums: array<decimal(38,0)>>>")


def cluster(df: DataFrame, key: str, vector: str, width: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:") -> DataFrame:
    """One row for each vector: the key, ``cluster``, ``distance`` (squared), ``cluster_inertia`` and ``inertia`` (distances summed over the
    cluster and over all), ``centroid_sha256``.

    Vectors have exactly ``width`` components, none null or non-finite; other rows are left out. Components are
    ``floor(scale * x)``, at most (and least) what 64 bits hold; products and sums are exact whatever their size, and distances
    beyond 64 bits count as the largest such integer. The first centroids are the ``k`` vectors with the smallest SHA-256 of
    ``salt`` and the key, ties by vector, or all where there are fewer; rows with a null key start none, but get a cluster.
    Repeated rows each count. Without a vector, or without one that can start, there are no rows. Only centroids and their sums,
    ``k`` rows at most, pass through the driver.
    """
    spark = df.sparkSession
    rows = integers(df, key, vector, scale, width)
    kind = dict(rows.dtypes)["id"]
    named = rows.filter("id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "vec")
    new = np.array([r.vec for r in named.orderBy("h", "vec").limit(k).collect()], np.int64).reshape(-1, width)
    if not len(new):
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    old, n = np.zeros_like(new), len(new)

    def first(m: np.ndarray) -> dict[str, object]:
        wide = roomy(m, width * (largest(m) + 1) ** 2)
        return _state(m, (wide * wide).sum(1), np.zeros((len(m), n), np.int64))

    chunks = written(chunked(rows, width, first, _STATE), "clusters")
    for _ in range(rounds):
        after = written(_advance(chunks, old, new), "clusters", CHUNKS)
        discard(chunks)
        chunks, old, new = after, new, new.copy()
        each_sum = after.select(F.explode("sums").alias("s")).select("s.*")
        for r in each_sum.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(width)]).alias("sums")).collect():
            new[r.cluster] = [int(s) // r.n for s in r.sums]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in each(batches):
            m, norms, dots = _opened(chunk)
            at, far = nearest(norms[:, 0], moved(m, dots, old, new), new)
            yield pa.RecordBatch.from_arrays([items(row, "id"), pa.array(at.astype(np.int32)), pa.array(saturated(far))], ["id", "cluster", "distance"])

    found = written(chunks.drop("sums").mapInArrow(last, f"id {kind}, cluster int, distance long"), "clustered", CHUNKS)
    discard(chunks)
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(exact_sum("distance").alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, new[c].tolist())).encode()).hexdigest()
    of = lambda value: F.element_at(F.create_map(*[x for c in inertia for x in (F.lit(c), value(c))]), F.col("cluster"))
    total = F.lit(min(LAST, sum(inertia.values()))).cast("long")
    return found.select(F.col("id").alias(key), "cluster", "distance", of(lambda c: F.lit(inertia[c]).cast("long")).alias("cluster_inertia"), total.alias("inertia"), of(lambda c: F.lit(digest(c))).alias("centroid_sha256"))
