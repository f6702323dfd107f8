"""Sequential operators on streams that equal their batch forms whatever the order of arrival.

Rows of a key wait until the watermark has passed them and then go, in order, through the same step function as in batch.
They wait in buckets of time, narrow ones near the watermark and wider ones further off, so that a timer reads and rewrites
the buckets that it reaches and no others; a row moves to a narrower bucket a few times at most. A key has one timer: for its
earliest waiting row, or for the time at which its state may end. Rows behind the watermark are counted, not folded.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Narrowest bucket in milliseconds, and what ``wake`` answers for a state that no time ends.
QUANTUM, ALWAYS = 1024, math.inf
#: So many rows need no buckets: they wait together, and what is not due then waits on.
FEW = 512


def bucket_of(ms: int, mark: int) -> tuple[int, int]:
    """Start and end of the bucket of a row: a quarter to half as wide as the row is far from the watermark."""
    width = QUANTUM << max(0, (max(0, ms - mark) // QUANTUM).bit_length() - 2)
    return ms - ms % width, ms - ms % width + width


def plain(column: pd.Series, kind: str) -> list:
    """The values of a column as Python has them; whole numbers stay whole where some are null."""
    if not column.hasnans and column.dtype != object:
        return column.tolist()
    whole = kind in ("bigint", "int") and column.dtype != object
    return [None if v is None or v != v else int(v) if whole else v for v in column.tolist()]


class OrderedFold(StatefulProcessor):
    """``head``: the fold's state, the buckets (start: earliest row, end, number of chunks), the timer. ``waiting``: chunks of rows."""

    def __init__(self, keys: list[str], order: list[str], fields: dict[str, str], fresh: Callable[[], object], step: Callable[[object, dict], list[tuple]], columns: list[str], lapse: Callable[[object, dict, int], list[tuple]] | None, wake: Callable[[object], float | None] | None):
        self.keys, self.fields, self.columns = keys, fields, columns
        self.fresh, self.step, self.lapse, self.wake = fresh, step, lapse, wake
        names = list(fields)
        self.at, self.by = names.index("ms"), [names.index(o) for o in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "data binary")
        self.waiting = handle.getMapState("waiting", "start long, nth int", "data binary")

    def _put(self, buckets: dict, rows: list[tuple], mark: int) -> None:
        by_start: dict[int, tuple[int, list[tuple]]] = {}
        if 0 < len(rows) <= FEW:
            times = [r[self.at] for r in rows]
            by_start[min(times)] = (max(times) + 1, rows)
        else:
            for r in rows:
                start, end = bucket_of(r[self.at], mark)
                by_start.setdefault(start, (end, []))[1].append(r)
        for start, (end, own) in by_start.items():
            first, last, n = buckets.get(start, (math.inf, end, 0))
            self.waiting.updateValue((start, n), (pickle.dumps(own),))
            buckets[start] = (min(first, min(r[self.at] for r in own)), max(last, end), n + 1)

    def _take(self, buckets: dict, mark: int) -> Iterator[list[tuple]]:
        """The rows of the buckets that the watermark has reached, those that overlap in time together, earliest first."""
        rows, reach = [], None
        for start in sorted(s for s, (first, _, _) in buckets.items() if first <= mark):
            if reach is not None and start >= reach:
                yield rows
                rows = []
            _, end, n = buckets.pop(start)
            for k in range(n):
                rows += pickle.loads(self.waiting.getValue((start, k))[0])
                self.waiting.removeKey((start, k))
            reach = max(reach or end, end)
        if rows:
            yield rows

    def _keep(self, state: object | None, buckets: dict, timer: float | None) -> None:
        """Writes the head, with one timer for what comes first, or drops it."""
        ends = None if state is None else self.wake(state) if self.wake else ALWAYS
        state = None if ends is None else state
        want = min([first for first, _, _ in buckets.values()] + ([ends] if ends is not None else []), default=ALWAYS)
        if timer is not None and want < timer:
            self.handle.deleteTimer(timer)
            timer = None
        if timer is None and want < ALWAYS:
            timer = int(want)
            self.handle.registerTimer(timer)
        if state is None and not buckets:
            self.head.clear()
        else:
            self.head.update((pickle.dumps((state, buckets, timer)),))

    def _opened(self) -> tuple:
        kept = self.head.get()
        return (None, {}, None) if kept is None else pickle.loads(kept[0])

    def _frames(self, made: list[tuple]) -> Iterator[pd.DataFrame]:
        if made:  # a frame costs as much as some hundred rows
            yield pd.DataFrame(made, columns=self.columns, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, late = timerValues.getCurrentWatermarkInMs(), 0
        state, buckets, timer = self._opened()
        for batch in rows:
            every = list(zip(*(plain(batch[c], kind) for c, kind in self.fields.items())))
            new = [r for r in every if r[self.at] > mark]
            late += len(every) - len(new)
            self._put(buckets, new, mark)
        self._keep(state, buckets, timer)
        given = dict(zip(self.keys, key))
        yield from self._frames([(*map(given.get, self.columns[:-1]), late)] if late else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        state, buckets, _ = self._opened()
        named, rest = dict(zip(self.keys, key)), []
        for rows in self._take(buckets, mark):
            due = sorted((r for r in rows if r[self.at] <= mark), key=lambda r: [r[k] for k in self.by])
            rest += [r for r in rows if r[self.at] > mark]
            state = self.fresh() if state is None else state
            yield from self._frames([(*x, None) for r in due for x in self.step(state, named | dict(zip(self.fields, r)))])
        self._put(buckets, rest, mark)
        if self.lapse and state is not None:
            yield from self._frames([(*x, None) for x in self.lapse(state, named, mark)])
        self._keep(state, buckets, None)

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], object], step: Callable[[object, dict], tuple | None], fields: list[str], out: str, delay: str = "1 hour", lapse: Callable[[object, dict, int], list[tuple]] | None = None, wake: Callable[[object], float | None] | None = None, late: bool = False, many: bool = False) -> DataFrame:
    """The stream form of ``operators.folding.keyed_fold``; ``stream`` has ``ms``, and rows without it are left out.

    ``wake(state)`` names the time at which a key is looked at again without a row: None if nothing is remembered, so that its
    state goes, or ``ALWAYS`` if no time ends it. ``lapse(state, key, watermark)`` then gives the rows that the passing of time
    makes. With ``late``, a column of that name has, on rows of their own, how many rows of a key came behind the watermark;
    else those rows are left out. With ``many``, ``step`` gives a list of rows.
    """
    kinds = dict(stream.dtypes)
    rows = stream.filter("ms is not null").withColumn("_at", F.timestamp_millis("ms")).withWatermark("_at", delay).select(*keys, *[f for f in fields if f not in keys])
    columns = [x.strip().split()[0] for x in out.split(",")]
    processor = OrderedFold(keys, order, {f: kinds[f] for f in fields}, fresh, step if many else lambda s, r: [] if (x := step(s, r)) is None else [x], [*columns, "late"], lapse, wake)
    made = rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"{out}, late long", outputMode="Append", timeMode="EventTime")
    return made if late else made.filter("late is null").drop("late")
