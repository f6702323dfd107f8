"""Operator 2: packing token pieces into sequences by patterns and non-negative least squares.

The histogram of lengths has at most ``capacity`` bins whatever the corpus holds, so the plan is
made on the driver from it alone: patterns of few lengths that fill a sequence (exactly, or as well as a
first length allows) are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares (accelerated projected gradient), rounded, trimmed where they overdraw a length, and the residual lengths are packed best-fit decreasing, many equal pieces at a time. Should best-fit
alone need fewer sequences, its plan is taken. Pieces then find their place by the running number they have
among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WordBpe, _extended, _kept
from .common import slices, written

Batches = Iterator[pa.RecordBatch]
#: Lengths of a pattern at most, and patterns enumerated, about: with more, second lengths are taken at even steps.
PARTS, PATTERNS = 8, 20_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Token pieces: ``key, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A document is its ids and a closing id 0, so null and empty texts have one piece of length 1. Longer ones
    than ``capacity`` are cut; only the last piece is shorter. Rows of equal key are separate documents.
    """
    run, schema = _cutter(docs, tokenizer, capacity, text, key, with_ids)
    return docs.select(key, text).mapInArrow(run, schema)


def _cutter(docs: DataFrame, tokenizer: str, capacity: int, text: str, key: str, with_ids: bool = False) -> tuple[Callable[[Batches], Batches], T.StructType]:
    """What makes pieces of batches of ``key`` and ``text``, and the pieces' schema."""
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    names, step = [f.name for f in schema.fields], 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer)
        for whole in batches:
            for batch in slices(whole, text):
                row, nth, start, length, crc, ids = [], [], [], [], [], []
                for k, out in enumerate(bpe.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())):
                    out += b"\0\0\0\0"
                    for n, at in enumerate(range(0, len(out), step)):
                        cut = out[at : at + step]
                        row.append(k), nth.append(n), start.append(at >> 2), length.append(len(cut) >> 2), crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(cut)
                cols = [batch.column(batch.schema.get_field_index(key)).take(pa.array(row, pa.int64())), pa.array(nth, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names)

    return run, schema


def patterns(support: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to ``PARTS`` lengths from ``support`` (0: none), in falling order, that fill ``capacity`` exactly or with the
    least rest that the first length allows.

    A first length meets second ones down to half of what it leaves, and some smaller ones that share the rest evenly; each
    further one is the largest that fits and is not larger than the one before.
    """
    if not len(support):
        return np.zeros((0, PARTS), np.int64)
    below = np.zeros(capacity + 1, np.int64)  # the largest length up to each number
    below[support] = support
    below = np.maximum.accumulate(below)
    first, second = [], []
    step = max(1, len(support) ** 2 // (6 * PATTERNS))
    for a in support.tolist():
        rest = capacity - a
        top = int(np.searchsorted(support, min(a, rest), "right"))
        half = support[int(np.searchsorted(support, (rest + 1) // 2)) : top : step]
        even = np.unique(below[[min(a, rest // k) for k in range(1, PARTS)]])
        b = np.union1d(half, even[even > 0])
        first.append(np.full(len(b), a)), second.append(b)
    parts = [np.concatenate(first), np.concatenate(second)]
    rest = capacity - parts[0] - parts[1]
    while len(parts) < PARTS:
        parts.append(below[np.minimum(parts[-1], rest)])
        rest = rest - parts[-1]
    least = np.full(capacity + 1, capacity)
    np.minimum.at(least, parts[0], rest)
    ok = (rest == 0) | (rest == least[parts[0]]) & (rest * 50 <= capacity)
    return np.unique(np.stack(parts, 1)[ok], axis=0)[::-1]


def fit(pats: np.ndarray, hist: np.ndarray, steps: int = 200) -> np.ndarray:
    """x >= 0 that nearly minimises ||A x - hist||, where A counts each length in each pattern."""
    size = (pats > 0).sum(1)
    flat, own, start = pats[pats > 0], np.repeat(np.arange(len(pats)), size), np.cumsum(size) - size

    def use(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, x[own], len(hist))

    def back(r: np.ndarray) -> np.ndarray:
        return np.add.reduceat(r[flat], start)

    v = np.ones(len(pats))
    for _ in range(12):
        v = back(use(v))
        v /= np.linalg.norm(v)
    bound = 1.05 * float(v @ back(use(v)))
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(use(y) - hist) / bound)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (old - 1) / t * (new - x), new
    return x


def plan(hist: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Slots ``length, first rank, sequence of that rank, offset, ranks`` sorted by length and rank, and the number of sequences:
    by patterns and best-fit, or by best-fit alone if that needs fewer."""
    fitted, alone = (_plan(hist, capacity, with_patterns) for with_patterns in (True, False))
    return fitted if fitted[1] <= alone[1] else alone


def _plan(hist: np.ndarray, capacity: int, with_patterns: bool) -> tuple[np.ndarray, int]:
    left = hist.astype(np.int64).copy()
    left[0] = 0
    used, slots, sequences = np.zeros(len(hist), np.int64), [], 0

    def place(parts: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n in parts:
            slots.append((n, used[n], sequences, offset, times))
            used[n] += times
            offset += n
        sequences += times

    if left[capacity]:
        place([capacity], int(left[capacity]))
        left[capacity] = 0
    pats = patterns(np.flatnonzero(left) if with_patterns else np.zeros(0, np.int64), capacity)
    if len(pats):
        times = np.floor(fit(pats, left.astype(float)) + 0.5).astype(np.int64)
        for k in np.flatnonzero(times):
            parts = [int(n) for n in pats[k] if n]
            need = np.bincount(parts, minlength=len(hist))
            own = np.flatnonzero(need)
            n = int(min(times[k], (left[own] // need[own]).min()))
            if n:
                place(parts, n)
                left[own] -= n * need[own]
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by free space
    for n in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[n])
        while todo:
            space = min((s for s in bins if s >= n), default=None)
            if space is None:
                k = capacity // n
                full, rest = divmod(todo, k)
                for parts, times in (((n,) * k, full), ((n,) * rest, min(rest, 1))):
                    if times:
                        bins.setdefault(capacity - sum(parts), []).append((parts, times))
                todo = 0
                continue
            parts, times = bins[space].pop()
            if not bins[space]:
                del bins[space]
            k = min(space // n, max(1, todo // times))
            n_bins = min(times, todo // k)
            if n_bins < times:
                bins.setdefault(space, []).append((parts, times - n_bins))
            bins.setdefault(space - k * n, []).append((parts + (n,) * k, n_bins))
            todo -= k * n_bins
    for group in bins.values():
        for parts, times in group:
            place(list(parts), times)
    out = np.array(slots, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))], sequences


def pack(df: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: rows of one sequence lie gapless from 0 and sum to ``capacity`` at most.

    Lengths are 1 to ``capacity``; a null or other length raises in the task that meets it. An empty table gives an
    empty one. Ties (equal lengths) are told apart by the partition and place they were read from. Columns called
    ``sequence_id`` or ``offset`` are replaced; the working columns are dropped again. The driver gets one row per
    distinct length, ``capacity`` at most, and sends back a plan whose size depends on those lengths only. Patterns hold
    ``PARTS`` lengths at most; where there would be more than about ``PATTERNS``, their second lengths are taken at even steps,
    which may cost sequences but places every piece: best-fit alone takes over where it needs fewer.
    """
    return _pack(df, iter, df, capacity, length)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``pack(pieces(docs))``, but a task cuts and numbers in one pass: with two passes, each core of an executor keeps two Python
    workers, and as tasks draw them in turn, each of them comes to hold the vocabulary and a cache."""
    run, _ = _cutter(docs, tokenizer, capacity, text, key)
    return _pack(docs.select(key, text), run, pieces(docs, tokenizer, capacity, text, key), capacity, "length")


def _pack(source: DataFrame, make: Callable[[Batches], Batches], df: DataFrame, capacity: int, length: str) -> DataFrame:
    """``pack`` of what ``make`` gives for the batches of ``source``, which has the columns of ``df``."""
    spark = source.sparkSession
    work = ("_pk_part", "_pk_nth")
    numbered = _extended(df, [T.StructField(work[0], T.LongType()), T.StructField(work[1], T.LongType())])
    names = [f.name for f in numbered.fields]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in make(batches):
            n = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False)
            if len(n) and not (np.all(n >= 1) and np.all(n <= capacity)):
                raise ValueError(f"lengths must be 1 to {capacity}")
            n = n.astype(np.int64)
            order = np.argsort(n, kind="stable")
            first = np.searchsorted(n[order], n[order], "left")
            nth = np.empty(len(n), np.int64)
            nth[order] = np.arange(len(n)) - first
            nth += seen[n]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(_kept(batch, numbered, 2) + [pa.array(np.full(len(n), part)), pa.array(nth)], names)

    rows = written(source.mapInArrow(number, numbered), "pieces")
    counts = rows.groupBy(F.col(length).alias("_pk_len"), F.col(work[0]).alias("_pk_of")).agg(F.count("*").alias("_pk_n"))
    before = Window.partitionBy("_pk_len").orderBy("_pk_of").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_pk_len", "_pk_of", F.coalesce(F.sum("_pk_n").over(before), F.lit(0)).alias("_pk_base"))
    hist = np.zeros(capacity + 1, np.int64)
    for n, total in counts.groupBy("_pk_len").agg(F.sum("_pk_n")).collect():
        hist[n] = total
    slots = spark.sparkContext.broadcast(plan(hist, capacity)[0])
    schema = _extended(df, [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out_names = [f.name for f in schema.fields]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        big = np.int64(1) << np.int64(48)
        keys = s[:, 0] * big + s[:, 1]
        for batch in batches:
            col = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = col(work[1]) + col("_pk_base")
            k = np.searchsorted(keys, col(length) * big + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(_kept(batch, schema, 2) + [pa.array(s[k, 2] + rank - s[k, 1]), pa.array(s[k, 3])], out_names)

    joined = rows.join(bases, (F.col(length) == F.col("_pk_len")) & (F.col(work[0]) == F.col("_pk_of")))
    return joined.mapInArrow(assign, schema)
