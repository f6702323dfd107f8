"""Throttling a key that is too large for one task: A1 cut into spans of time that are folded side by side.

The requests of a key fall into spans of many windows. A span's outcome depends only on what it is handed: how many requests the
open window has counted, when it ends, and the violations. The first request after that end anchors the span's own windows, so
for each request that may be that one, the chain of windows it starts is followed to the span's end; chains that meet are
followed once. Violations along a chain are a map ``v -> max(v + a, b)``, and such maps compose. One row a span then hands each
span its start, in order, and all spans are folded with the ordinary step function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folds import Throttle
from .folding import keyed_fold

#: Windows in a span.
SPAN = 64
_LOW = -(1 << 62)


def chains(ms: np.ndarray, most: int, window: int, after_reset: int | None) -> dict[str, np.ndarray]:
    """For each request that may be the first to anchor a window of the span (those of its first window, and the first one after):
    its place and time, and where its chain of windows ends: the end and count of the last window, and what violations become
    after the first window's start. ``ms`` is in order."""
    n = len(ms)
    first = int(np.searchsorted(ms, ms[0] - ms[0] % (SPAN * window) + window))
    after = np.searchsorted(ms, ms + window)
    ends: dict[int, tuple[int, int, int, int]] = {}
    starts = np.flatnonzero(np.diff(ms[: first + 1], prepend=ms[0] - 1))
    for start in starts[::-1].tolist():
        path, i = [], start
        while i not in ends:
            path.append(i)
            if after[i] >= n:
                break
            i = int(after[i])
        for k in reversed(path):
            rejects, nxt = max(0, int(after[k]) - k - most), int(after[k])
            if nxt >= n:
                ends[k] = (int(ms[k]) + window, min(most, n - k), rejects, rejects)
                continue
            end, count, a, b = ends[nxt]
            forgotten = after_reset is not None and int(ms[nxt]) - int(ms[k]) - window > after_reset
            a0, b0 = (_LOW, 0) if forgotten else (rejects - 1, max(0, rejects - 1))  # violations when the next window has started
            ends[k] = (end, count, max(a0 + a, _LOW), max(b0 + a, b))
    found = [(k, int(ms[k]), *ends[k]) for k in starts.tolist()]
    return dict(zip(("place", "at", "end", "count", "a", "b"), np.array(found, np.int64).reshape(-1, 6).T))


def _summaries(spans: DataFrame, key: str, most: int, window: int, after_reset: int | None) -> DataFrame:
    """One row for each span of a key: its number of requests, and its chains as binary columns."""
    names = ("place", "at", "end", "count", "a", "b")
    schema = pa.schema([(key, pa.string()), ("span", pa.int64()), ("n", pa.int64()), *[(f"{c}s", pa.binary()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []

        def made() -> pa.RecordBatch:
            ms = np.concatenate(parts)
            found = chains(ms, most, window, after_reset)
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*own, len(ms), *(found[c].tobytes() for c in names)), schema)], schema=schema)

        for batch in batches:
            keys, numbers, ms = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *[i for i in range(1, len(keys)) if numbers[i] != numbers[i - 1] or keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if own is not None and own != (keys[a], int(numbers[a])):
                    yield made()
                    parts = []
                own = (keys[a], int(numbers[a]))
                parts.append(ms[a:b])
        if own is not None:
            yield made()

    rows = spans.select(F.col(key).cast("string"), "span", "ms").repartition(key, "span").sortWithinPartitions(key, "span", "ms")
    return rows.mapInArrow(run, f"`{key}` string, span long, n long, " + ", ".join(f"{c}s binary" for c in names))


def _hand_over(s: Throttle, r: dict, most: int, after_reset: int | None) -> tuple[int, int | None, int]:
    """What a span is handed; ``s`` becomes what it hands on."""
    handed = (s.count, s.reset, s.violations)
    at = {c: np.frombuffer(r[f"{c}s"], np.int64) for c in ("place", "at", "end", "count", "a", "b")}
    entry = 0 if s.reset is None else int(np.searchsorted(at["at"], s.reset))
    before = int(at["place"][entry]) if entry < len(at["at"]) else r["n"]  # requests in the window that is still open
    allowed = min(before, max(0, most - s.count))
    s.count, s.violations = s.count + allowed, s.violations + before - allowed
    if entry < len(at["at"]):
        gone = s.reset is None or after_reset is not None and int(at["at"][entry]) - s.reset > after_reset
        started = 0 if gone else max(0, s.violations - 1)
        s.count, s.reset, s.violations = int(at["count"][entry]), int(at["end"][entry]), max(started + int(at["a"][entry]), int(at["b"][entry]))
    return handed


def split_rate_limit(df: DataFrame, key: str, most: int, window: int, after_reset: int | None, out: str) -> DataFrame:
    """The rows of ``admission.rate_limit`` for requests of few keys with very many rows each. Requests travel by key and span, twice;
    the rows that go through one task for each key are one a span. Requests of one span are one task's work."""
    spans = df.select(F.col(key).cast("string").alias(key), "ms", "event_id").filter("ms is not null").withColumn("span", F.floor(F.col("ms") / (SPAN * window)).cast("long"))
    fields = ["span", "n", *[f"{c}s" for c in ("place", "at", "end", "count", "a", "b")]]
    hand = lambda s, r: (r[key], r["span"], *_hand_over(s, r, most, after_reset))
    handed = keyed_fold(_summaries(spans, key, most, window, after_reset), [key], ["span"], Throttle, hand, fields, f"{key} string, span long, count_in long, reset_in long, violations_in long")
    h = handed.select(F.col(key).alias("_key"), F.col("span").alias("_span"), "count_in", "reset_in", "violations_in")
    rows = spans.join(h, F.col(key).eqNullSafe(F.col("_key")) & (F.col("span") == F.col("_span")))

    def step(s: list, r: dict) -> tuple:
        if not s:
            s.append(Throttle(r["count_in"], r["reset_in"], r["violations_in"]))
        allowed, remaining, wait = s[0].step(r["ms"], most, window, after_reset)
        return (r[key], r["ms"], r["event_id"], allowed, remaining, wait, s[0].violations, s[0].reset)

    return keyed_fold(rows, [key, "span"], ["ms", "event_id"], list, step, ["ms", "event_id", "count_in", "reset_in", "violations_in"], out)
