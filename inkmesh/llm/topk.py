"""Operator 4: exact top-k inner products by norm-bucketed retrieval.

Candidates are ranged by length, longest first, and cut into buckets of similar length; queries come
in blocks. A query meets a bucket with the score it must still reach, which the bucket's longest
vector turns into a local cosine threshold. If that is low, all vectors that are long enough are
taken (length pruning); if it is high, only those whose value in the query's largest coordinate can
belong to such a cosine (coordinate pruning). Products of the survivors are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKET = 1024
#: Local cosine threshold from which coordinates prune better than lengths.
STEEP = 0.8
SLACK = 1e-9


def integers(df: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """``id, vec, norm`` of vectors without nulls and non-finite components; empty vectors have length 0."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    vec = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    rows = df.filter(whole & F.col(key).isNotNull()).select(F.col(key).alias("id"), vec.alias("vec"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v)))


def matrix(vectors: list | np.ndarray, width: int | None = None) -> np.ndarray:
    """Rows padded with 0 to one width."""
    width = width if width is not None else max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


#: Scores beyond 64-bit integers count as the last of them.
LAST = 2**63 - 1


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers: in floats while all steps are exact there, else in Python integers if need be."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.array([[min(LAST, max(-LAST, int(x))) for x in row] for row in exact], np.int64).reshape(len(q), len(c))


class Best:
    """The k best scores of one block of queries so far; ``need`` is what a new one must reach."""

    def __init__(self, ids: np.ndarray, need: np.ndarray, k: int):
        self.ids, self.need, self.k = ids, need.astype(float).copy(), k
        self.score: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]
        self.vec: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]

    def offer(self, i: int, scores: np.ndarray, vecs: np.ndarray) -> None:
        ok = (scores >= self.need[i]) & (vecs != self.ids[i])
        if not ok.any():
            return
        s, v = np.concatenate([self.score[i], scores[ok]]), np.concatenate([self.vec[i], vecs[ok]])
        order = np.lexsort((v, -s))[: self.k]
        self.score[i], self.vec[i] = s[order], v[order]
        if len(order) == self.k:
            self.need[i] = max(self.need[i], float(self.score[i][-1]))


def search(q: np.ndarray, q_norm: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_norm: np.ndarray, best: Best) -> None:
    """Offers one block of queries the candidates that can still count; ``c`` in falling order of length."""
    direction = q / np.where(q_norm > 0, q_norm, 1)[:, None]
    main = np.abs(direction).argmax(1) if q.shape[1] else np.zeros(len(q), int)
    for a in range(0, len(c), BUCKET):
        b, norm, ids = c[a : a + BUCKET], c_norm[a : a + BUCKET], c_ids[a : a + BUCKET]
        reach = q_norm * norm[0] * (1 + SLACK)
        active = np.flatnonzero(reach >= best.need)
        if not len(active):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach[active] > 0, best.need[active] / reach[active], -1.0)
        steep = active[local >= STEEP]
        plain = active[local < STEEP]
        if len(plain):  # by length
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where((q_norm[plain] > 0) & (best.need[plain] > 0), best.need[plain] / q_norm[plain] * (1 - SLACK), 0)
            n = int(np.searchsorted(-norm, -shortest.min(), "right"))
            scores = products(q[plain], b[:n])
            for i in np.flatnonzero((scores >= best.need[plain][:, None]).any(1)):
                best.offer(int(plain[i]), scores[i], ids[:n])
        if len(steep):  # by coordinate
            unit = b / np.where(norm > 0, norm, 1)[:, None]
            order: dict[int, np.ndarray] = {}
            for i, t in zip(steep.tolist(), local[local >= STEEP].tolist()):
                f = int(main[i])
                if f not in order:
                    order[f] = np.argsort(unit[:, f], kind="stable")
                x = direction[i, f]
                t = min(1.0, t)
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-7
                values = unit[order[f], f]
                own = order[f][np.searchsorted(values, t * x - spread, "left") if x >= 0 else 0 : len(values) if x >= 0 else np.searchsorted(values, t * x + spread, "right")]
                if len(own):
                    best.offer(i, products(q[i : i + 1], b[own])[0], ids[own])


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, scale: int = 1024, block: int = 8192, head: int = 1024, part_rows: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest integer products, ties to the smaller id.

    Components are ``floor(scale * x)``; components and scores beyond 64-bit integers count as the largest (or smallest) of
    them. Vectors that are null or hold null or non-finite components, and null ids,
    take no part. A query does not meet rows of its own id; other repeated rows are candidates of their own. Of
    repeated query ids, the largest vector asks. Shorter vectors count as padded with 0. Without candidates or
    queries the result is empty. Queries go to ranges of candidates in blocks, so a task holds one range
    (``part_rows`` on average) and one block. First thresholds come from the ``head`` longest vectors (a fixed number, broadcast).
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = integers(df, key, vector, scale)
    n_rows, n_queries, asks = rows.count(), 0, None
    asks = rows.withColumnRenamed("id", key).filter(is_query).groupBy(F.col(key).alias("query_id")).agg(F.max("vec").alias("vec"), F.max_by("norm", "vec").alias("norm"))
    n_queries = asks.count()
    blocks, parts = max(1, -(-n_queries // block)), max(1, -(-n_rows // part_rows))
    longest = rows.orderBy(F.desc("norm"), "id").limit(head).collect()
    top = spark.sparkContext.broadcast((np.array([r.id for r in longest], np.int64), matrix([r.vec for r in longest])))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = top.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, vecs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            width = max(c.shape[1], *(len(v) for v in vecs))
            wide = np.pad(c, ((0, 0), (0, width - c.shape[1])))
            need = np.full(len(own), -np.inf)
            for a in range(0, len(own), 512):
                s = products(matrix(vecs[a : a + 512], width), wide).astype(float)
                s[own[a : a + 512, None] == ids[None, :]] = -np.inf
                if s.shape[1] >= k:
                    need[a : a + 512] = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(need)], ["query_id", "vec", "norm", "need"])

    asks = asks.mapInArrow(seed, f"query_id {kind}, vec array<long>, norm double, need double").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    asks = written(asks, "queries")
    ranged = written(rows.repartitionByRange(parts, F.desc("norm"), F.asc("id")).withColumn("part", F.spark_partition_id()), "vectors")
    reach = ranged.groupBy("part").agg(F.max("norm").alias("longest"))
    wants = asks.groupBy("block").agg(F.min(F.when(F.col("norm") > 0, F.col("need") / F.col("norm")).otherwise(F.lit(float("-inf")))).alias("least"))
    pairs = wants.select("block", "least", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).join(reach, "part").filter(F.col("longest") * (1 + SLACK) >= F.col("least")).select("part", "block")
    pairs = written(pairs, "pairs")
    left = ranged.join(pairs, "part").select("part", "block", "id", "vec", "norm")
    right = asks.join(pairs, "block").select("part", "block", "query_id", "vec", "norm", "need")

    def meet(_, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(c) or not len(q):
            return empty
        c = c.sort_values(["norm", "id"], ascending=[False, True], kind="stable")
        width = max(max(map(len, c.vec)), max(map(len, q.vec)))
        best = Best(q.query_id.to_numpy(), q.need.to_numpy(), k)
        search(matrix(list(q.vec), width), q.norm.to_numpy(), matrix(list(c.vec), width), c.id.to_numpy(), c.norm.to_numpy(), best)
        n = [len(s) for s in best.score]
        if not sum(n):
            return empty
        return pd.DataFrame({"query_id": np.repeat(best.ids, n), "vec_id": np.concatenate(best.vec), "score": np.array([int(s) for x in best.score for s in x], np.int64)})

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(meet, f"query_id {kind}, vec_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
