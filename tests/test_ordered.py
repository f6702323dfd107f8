"""The ordered fold without a cluster: a handle of dictionaries, batches in any order, watermarks that follow."""

import math

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmesh.functions.folds import Throttle
from inkmesh.streaming import ordered
from inkmesh.streaming.ordered import OrderedFold, bucket_of


class Value:
    def __init__(self):
        self.kept = None

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value

    def clear(self):
        self.kept = None


class Chunks(dict):
    calls = 0
    size = 0

    def getValue(self, key):  # noqa: N802
        self.calls, self.size = self.calls + 1, self.size + len(self[key][0])
        return self[key]

    def updateValue(self, key, value):  # noqa: N802
        assert key not in self  # a chunk is never rewritten
        self.calls, self.size = self.calls + 1, self.size + len(value[0])
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self[key]


class Handle:
    def __init__(self):
        self.timers, self.head, self.chunks = set(), Value(), Chunks()

    def getValueState(self, *_):  # noqa: N802
        return self.head

    def getMapState(self, *_):  # noqa: N802
        return self.chunks

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class Times:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.mark


class Run:
    """One key's life: batches, then the timers that the watermark has reached."""

    def __init__(self, after_reset=None, most=2, window=50):
        step = lambda s, r: [(r["k"], r["ms"], r["event_id"], *s.step(r["ms"], most, window, after_reset), s.violations)]
        lapse = lambda s, key, mark: s.forget(mark + 1, after_reset) and []
        wake = lambda s: None if s.reset is None else ordered.ALWAYS if after_reset is None else s.reset + after_reset
        self.handle, self.mark, self.rows, self.late = Handle(), 0, [], 0
        self.fold = OrderedFold(["k"], ["ms", "event_id"], {"ms": "bigint", "event_id": "bigint"}, Throttle, step, ["k", "ms", "event_id", "allowed", "remaining", "wait", "violations", "late"], lambda *a: lapse(*a) or [], wake)
        self.fold.init(self.handle)

    def _take(self, frames):
        for f in frames:
            for r in f.itertuples(index=False):
                self.late += r.late or 0
                self.rows += [] if r.late else [tuple(r)[:-1]]

    def batch(self, rows, mark):
        if rows:
            self._take(self.fold.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["ms", "event_id"])]), Times(self.mark)))
        self.mark = max(self.mark, mark)
        assert len(self.handle.timers) <= 1
        for at in [t for t in self.handle.timers if t <= self.mark]:
            self._take(self.fold.handleExpiredTimer(("a",), Times(self.mark), None))
            self.handle.timers.discard(at)


def folded(rows, after_reset=None, most=2, window=50):
    s = Throttle()
    return [("a", ms, i, *s.step(ms, most, window, after_reset), s.violations) for ms, i in sorted(rows)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 9000), max_size=12), max_size=12), st.integers(0, 3000), st.sampled_from([None, 0, 400]), st.sampled_from([0, 3, 512]))
def test_equals_the_fold_of_the_rows_in_time(batches, delay, after_reset, few):
    before, ordered.FEW = ordered.FEW, few
    try:
        run, kept, seen, n = Run(after_reset), [], 0, 0
        for times in batches:
            rows = [(ms, n + k) for k, ms in enumerate(times)]
            n += len(rows)
            kept += [r for r in rows if r[0] > run.mark]
            seen = max([seen, *times])
            run.batch(rows, seen - delay)
        run.batch([], 10**6)
    finally:
        ordered.FEW = before
    assert [tuple(None if v != v else v for v in r) for r in run.rows] == folded(kept, after_reset)
    assert run.late == n - len(kept)
    assert not run.handle.chunks
    if after_reset is not None:
        assert run.handle.head.kept is None and not run.handle.timers  # nothing is remembered of a key that fell silent


def test_buckets_hold_their_rows_and_narrow_towards_the_watermark():
    for mark in (0, 10**12):
        for far in [0, 1, 1023, 5000, 10**6, 10**9, 10**12]:
            start, end = bucket_of(mark + far, mark)
            assert start <= mark + far < end and end - start <= max(ordered.QUANTUM, far)


def test_a_key_with_very_many_waiting_rows_takes_linear_time():
    def cost(n):
        run, seen = Run(), 0
        for k in range(0, n, 100):  # an hour's lateness, rows of the last hour in no order
            times = [10**9 + 36_000 * k // 100 + (i * 7919) % 3_600_000 for i in range(100)]
            seen = max([seen, *times])
            run.batch([(ms, k + i) for i, ms in enumerate(times)], seen - 3_600_000)
        assert len(run.handle.chunks) > 0 and run.late == 0
        return run.handle.chunks.size

    small, large = cost(40_000), cost(120_000)
    assert large / 120_000 < 1.5 * small / 40_000
    assert math.isinf(ordered.ALWAYS)


def test_whole_numbers_stay_whole_where_some_are_null():
    values = ordered.plain(pd.Series([1.0, None, 3.0]), "bigint")
    assert values == [1, None, 3] and isinstance(values[0], int)
    assert ordered.plain(pd.Series(["a", None]), "string") == ["a", None]
    assert ordered.plain(pd.Series([True, None], dtype=object), "boolean") == [True, None]
