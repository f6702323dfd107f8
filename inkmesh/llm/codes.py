"""Operator 12: compressing vectors to codes of their parts' nearest codebook entries.

Each chunk of vectors is written once with a dictionary of the distinct integers of each dimension. In a round, the squared
differences of every distinct integer to the dimension's values in all entries are tabulated; a part's distances to all entries
are then gathers of table rows by dictionary codes, and adds. Sums for new entries leave a task once for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, broadcast_limit, discard, written
from .vectors import CHUNKS, LAST, chunked, each, exact_sum, grouped, integers, items, largest, packed, saturated, unpacked

#: Rows whose distances are summed at once: they stay in a processor's cache.
BLOCK = 512


def dictionaries(m: np.ndarray) -> dict[str, object]:
    """A chunk's columns: the distinct integers of each dimension, one after the other, and each vector's places in them."""
    found = [np.unique(m[:, d], return_inverse=True) for d in range(m.shape[1])]
    kind, values = packed(np.concatenate([v for v, _ in found]) if found else np.zeros(0, np.int64))
    codes = np.array([c for _, c in found], "<u2").tobytes()
    return {"kind": kind, "values": values, "sizes": np.array([len(v) for v, _ in found], "<i4").tobytes(), "codes": codes}


def opened(chunk: dict) -> tuple[list[np.ndarray], np.ndarray]:
    """Dictionaries by dimension, and codes by dimension and vector."""
    sizes = np.frombuffer(chunk["sizes"], "<i4")
    values = np.split(unpacked(chunk["kind"], chunk["values"], (int(sizes.sum()),)), np.cumsum(sizes)[:-1])
    return values, np.frombuffer(chunk["codes"], "<u2").reshape(len(sizes), -1)


def nearest(values: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry of ``book``, the smaller one of equally near, and its squared distance."""
    most = sum((largest(v) + largest(book[:, d])) ** 2 for d, v in enumerate(values))
    kind = np.int32 if most < 2**31 else np.int64 if most <= LAST else object
    tables = [np.subtract.outer(v.astype(kind), book[:, d].astype(kind)) ** 2 for d, v in enumerate(values)]
    at, far = np.zeros(codes.shape[1], np.int64), np.zeros(codes.shape[1], object if kind is object else np.int64)
    for a in range(0, codes.shape[1], BLOCK):
        own = codes[:, a : a + BLOCK]
        total = tables[0][own[0]]
        for table, code in zip(tables[1:], own[1:]):
            total += table[code]
        at[a : a + BLOCK] = best = total.argmin(1)
        far[a : a + BLOCK] = total[np.arange(len(best)), best]
    return at, far


def _parts(values: list[np.ndarray], codes: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    wide = len(values) // len(books)
    for p, book in enumerate(books):
        own = slice(p * wide, (p + 1) * wide)
        yield p, own, *nearest(values[own], codes[own], book)


def refined(chunks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: the books with each entry that has parts replaced by the floor of their mean."""
    wide = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        for chunk, _ in each(batches):
            values, codes = opened(chunk)
            for p, own, at, _ in _parts(values, codes, books):
                rows = np.array([v[c] for v, c in zip(values[own], codes[own])]).T
                for e, n, s in zip(*(x.tolist() for x in grouped(at, rows))):
                    have = totals.setdefault((p, e), [0, [0] * wide])
                    totals[p, e] = [have[0] + n, [a + b for a, b in zip(have[1], s)]]
        if totals:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38)))
            made = ([p for p, _ in totals], [e for _, e in totals], [n for n, _ in totals.values()], [list(map(Decimal, s)) for _, s in totals.values()])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, kinds)], ["part", "entry", "n", "sums"])

    with batch_rows(chunks.sparkSession, CHUNKS):
        sums = chunks.mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(wide)]).alias("sums")).collect()
    books = [b.copy() for b in books]
    for r in found:  # one row for each entry at most
        books[r.part][r.entry] = [int(s) // r.n for s in r.sums]
    return books


def compress(df: DataFrame, key: str, vector: str, label: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """One row for each vector: the key, ``code`` (two hexadecimal digits for each part), ``error`` (its squared distance), ``label_error``
    (the errors' sum over equal labels, nulls together) and ``codebooks_sha256``.

    Components are ``floor(scale * x)``, at most (and least) what 64 bits hold; distances and sums are exact whatever their size,
    and errors beyond 64 bits count as the largest such integer. Rows whose vector is null or has null or non-finite components
    are left out. Shorter vectors count as padded with 0, up to the longest and a multiple of ``parts``; empty ones are all 0.
    Codebooks start with the parts of the ``entries`` (256 at most) rows with the smallest keys, ties by vector, or of all rows
    where there are fewer. Rows with a null key get codes, and start an entry only where too few others are there; repeated rows
    each count. A table without vectors gives no rows. Only codebooks, whose size is fixed, pass through the driver.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits")
    spark = df.sparkSession
    rows = integers(df, key, vector, scale, label=label)
    kinds = dict(rows.dtypes)
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], f"`{key}` {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    wide = max(1, -(-longest // parts))
    first = [r.vec + [0] * (wide * parts - len(r.vec)) for r in rows.select("id", "vec").orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()]
    books = [np.array([v[p * wide : (p + 1) * wide] for v in first], np.int64) for p in range(parts)]
    chunks = written(chunked(rows, wide * parts, dictionaries, "kind string, values binary, sizes binary, codes binary"), "codes")
    for _ in range(rounds):
        books = refined(chunks, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row in each(batches):
            found = [(at, far) for _, _, at, far in _parts(*opened(chunk), books)]
            total = sum(far.astype(object) if largest(far) > LAST // parts else far for _, far in found)
            code = ["".join(map("{:02x}".format, c)) for c in zip(*(at.tolist() for at, _ in found))]
            yield pa.RecordBatch.from_arrays([items(row, "id"), items(row, "label"), pa.array(code), pa.array(saturated(total))], ["id", "label", "code", "error"])

    coded = written(chunks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "coded", CHUNKS)
    discard(chunks)
    totals = written(coded.groupBy(F.col("label").alias("_label")).agg(exact_sum("error").alias("label_error")), "labels")
    size = totals.agg(F.sum(F.coalesce(F.octet_length(F.col("_label").cast("string")), F.lit(0)) + 16)).first()[0]
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    joined = coded.join(F.broadcast(totals) if size <= broadcast_limit(spark) else totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
