"""Integer vectors in chunks: what the operators on codes and clusters share.

A chunk is one row that holds some thousand vectors: their keys as a list, their components as one binary of the narrowest
integers that fit. Tables of chunks are written to the shared folder and read again in each round, so a round moves few bytes
and any task can be run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a chunk, and chunks of an Arrow batch.
CHUNK, CHUNKS = 4096, 16
LAST = 2**63 - 1


def integers(df: DataFrame, key: str, vector: str, scale: int, width: int | None = None, label: str | None = None) -> DataFrame:
    """``id, vec`` and, if asked, ``label`` of the rows whose vectors are not null and have finite components only, ``width`` of them
    if that is given. Components are ``floor(scale * x)``, at most (and least) what 64 bits hold."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    if width is not None:
        whole = whole & (F.size(vector) == width)
    vec = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return df.filter(whole).select(F.col(key).alias("id"), vec.alias("vec"), *([F.col(label).alias("label")] if label else []))


def packed(a: np.ndarray) -> tuple[str, bytes]:
    """An integer array as bytes of its narrowest kind; values beyond 64 bits as text."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    for kind in ("<i2", "<i4", "<i8"):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return kind, a.astype(kind).tobytes()
    return "text", ",".join(map(str, a.ravel().tolist())).encode()


def unpacked(kind: str, raw: bytes, shape: tuple[int, ...]) -> np.ndarray:
    """What ``packed`` made, as 64-bit integers, or Python integers if they need more."""
    if kind == "text":
        return np.array([int(x) for x in raw.decode().split(",")], object).reshape(shape)
    return np.frombuffer(raw, kind).astype(np.int64).reshape(shape)


def roomy(a: np.ndarray, most: int) -> np.ndarray:
    """``a`` in a kind in which values up to ``most`` are exact."""
    return a.astype(np.int64) if most <= LAST else a.astype(object)


def largest(a: np.ndarray) -> int:
    return max((abs(int(f(a))) for f in (np.min, np.max)), default=0) if a.size else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` components; shorter vectors are padded with 0."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def chunked(rows: DataFrame, width: int, make: Callable[[np.ndarray], dict[str, object]], fields: str) -> DataFrame:
    """One row for each ``CHUNK`` rows at most of a task's batch: ``n``, the columns but ``vec`` as lists, and the ``fields`` that
    ``make`` gives for the matrix of the vectors."""
    kinds = {c: t for c, t in rows.dtypes if c != "vec"}
    out = ", ".join(["n int", *[f"{c} array<{t}>" for c, t in kinds.items()], fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                n = part.num_rows
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([part.column(c)])) for c in kinds]
                made = make(matrix(part.column("vec"), width))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *lists, *(pa.array([v]) if not isinstance(v, pa.Array) else v for v in made.values())], ["n", *kinds, *made])

    return rows.mapInArrow(run, out)


def grouped(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups that occur, their numbers of rows, and the exact sums of their rows."""
    if not len(group):
        return group, np.zeros(0, np.int64), rows[:0]
    order = np.argsort(group, kind="stable")
    at = np.flatnonzero(np.diff(group[order], prepend=-1))
    rows = roomy(rows, largest(rows) * len(rows))
    return group[order][at], np.diff(np.append(at, len(group))), np.add.reduceat(rows[order], at)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, object], pa.RecordBatch]]:
    """The chunks of a task: the plain values of each, and the row itself for its lists."""
    for batch in batches:
        lists = [c for c in batch.schema.names if pa.types.is_list(batch.schema.field(c).type)]
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            yield {c: row.column(c)[0].as_py() for c in row.schema.names if c not in lists}, row


def items(row: pa.RecordBatch, column: str) -> pa.Array:
    return row.column(column)[0].values


def saturated(x: np.ndarray) -> np.ndarray:
    """64-bit integers; larger values count as the largest."""
    return np.minimum(x, LAST).astype(np.int64)


def exact_sum(column: str):
    """A sum of 64-bit integers that counts as the largest of them where it is larger."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(LAST).cast("decimal(38,0)")).cast("long")
