"""Operator 6: n-gram language model in a memory-mapped Elias-Fano trie.

Level 1 holds the distinct tokens as sorted hashes; a token's number is its place there. Level k
holds, for each (k-1)-gram that occurs as a context, its following tokens: contexts and pointers are
monotone sequences, and following tokens become one by adding ``context rank * V``, so all three are
Elias-Fano coded and a lookup is a successor search relative to its context. Each n-gram carries a
quantised discounted probability and, as a context, a quantised back-off weight (interpolated absolute
discounting; the first level is the smoothed unigram distribution).

Counting and building are Spark jobs. Tasks combine n-grams before the shuffle and send them as
packed columns by shard; a shard's contexts are split by the following token, so a very frequent
word spreads over shards. Shards are files in the shared folder, which scoring tasks memory-map.
"""

from __future__ import annotations

import io
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, release, remove, scratch, slices, text_bytes, words

#: The token that ends each text.
END = np.uint64(0)
#: Tokens gathered in a task before they are combined and sent.
GATHER = 3 << 19
#: Sub-shards of one context, and steps of the quantised logarithms: 65535 steps are 46.8 nats, and the least value that
#: 64-bit counts give, 0.25 / 2^63, is 45.1.
SPLIT, STEP = 16, 1 / 1400
DISCOUNT = 0.75
#: Bytes of text for each shard of a level.
SHARD = 12 << 20
_BIT = np.array([[next((b for b in range(8) if bin(i & ((2 << b) - 1)).count("1") == r + 1), 8) for r in range(8)] for i in range(256)], np.uint8)


class EliasFano:
    """A sorted sequence of unsigned 64-bit integers: low bits plain, high bits as gaps in a bit vector.

    ``bits`` and ``packed`` are 64-bit words; ``ones`` counts the set bits before each word. Sorted questions are
    answered fastest, as they walk through memory.
    """

    def __init__(self, n: int, low: int, bits: np.ndarray, packed: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.bits, self.packed, self.ones = n, low, bits, packed, ones
        self.zeros = None

    @staticmethod
    def write(out, values: np.ndarray) -> None:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, int(top // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(low)).astype(np.int64) if n else np.zeros(0, np.int64)
        words = (n + (int(high[-1]) if n else 0)) // 64 + 1
        place = high + np.arange(n)
        bits = np.zeros(words, np.uint64)
        np.bitwise_or.at(bits, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        packed = np.zeros(n * low // 64 + 2, np.uint64)
        if low:
            bit = np.arange(n, dtype=np.int64) * low
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            value = values & np.uint64((1 << low) - 1)
            np.bitwise_or.at(packed, word, value << shift)
            over = np.flatnonzero(shift > np.uint64(64 - low))
            np.bitwise_or.at(packed, word[over] + 1, value[over] >> (np.uint64(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)]).astype("<u4" if n < 2**32 else "<u8")
        out.write(struct.pack("<QQQQ", n, low, bits.nbytes, packed.nbytes))
        out.write(bits.tobytes() + packed.tobytes() + np.pad(ones.view(np.uint8), (0, -ones.nbytes % 8)).tobytes())

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple["EliasFano", int]:
        n, low, a, b = struct.unpack("<QQQQ", data[at : at + 32].tobytes())
        at += 32
        bits, packed = data[at : at + a].view(np.uint64), data[at + a : at + a + b].view(np.uint64)
        at += a + b
        kind = np.dtype("<u4" if n < 2**32 else "<u8")
        size = (a // 8 + 1) * kind.itemsize
        return cls(n, low, bits, packed, data[at : at + size].view(kind)), at + size + -size % 8

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.packed[word] >> shift
        # the part in the next word; a shift by 64 is taken in two steps
        out |= self.packed[word + 1] << np.uint64(1) << (np.uint64(63) - shift)
        return out & np.uint64((1 << self.low) - 1)

    def _select(self, counts: np.ndarray, k: np.ndarray, invert: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero, of the upper bits."""
        word = np.searchsorted(counts, k.astype(counts.dtype), "right") - 1
        rest = (k - counts[word].astype(np.int64)).astype(np.uint8)
        own = self.bits[word]
        if invert:
            own = ~own
        place = word << 6
        for width in (32, 16, 8):
            half = np.bitwise_count(own & np.uint64((1 << width) - 1))
            up = rest >= half
            rest = rest - half * up
            own = own >> (up.astype(np.uint64) * np.uint64(width))
            place = place + up * width
        return place + _BIT[(own & np.uint64(255)).astype(np.uint8), np.minimum(rest, 7)]

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(self.ones, i, False) - i).astype(np.uint64)
        return high << np.uint64(self.low) | self._lows(i)

    def find(self, x: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, by successor search in places ``start`` to ``stop`` (all by default); -1 if absent."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        high = (x >> np.uint64(self.low)).astype(np.int64)
        top = len(self.bits) * 64 - self.n  # zeros there are
        own = np.flatnonzero(high < top)
        if not len(own):
            return out
        high, want = high[own], x[own] & np.uint64((1 << self.low) - 1)
        # the values with these high bits lie between two zeros; the first is often the last one's neighbour
        first = np.where(high > 0, self._select(self.zeros, np.maximum(high - 1, 0), True) + 1 - high, 0)
        end = self._run_end(first + high) - high
        if start is not None:
            first, end = np.maximum(first, start[own]), np.minimum(end, stop[own])
        lo, hi = first, np.minimum(end, self.n)
        live = np.flatnonzero(lo < hi)
        lo, hi, want, own = lo[live], hi[live], want[live], own[live]
        last = hi - 1
        while True:  # the smallest place whose low bits are not less, or the last
            live = np.flatnonzero(lo < last)
            if not len(live):
                break
            mid = (lo[live] + last[live]) >> 1
            less = self._lows(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            last[live] = np.where(less, last[live], mid)
        ok = self._lows(lo) == want
        out[own[ok]] = lo[ok]
        return out

    def _run_end(self, place: np.ndarray) -> np.ndarray:
        """The first zero of the upper bits at or after each place."""
        word = place >> 6
        rest = ~self.bits[word] >> (place & 63).astype(np.uint64)
        at = place + np.bitwise_count((rest & (np.uint64(0) - rest)) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        if len(far):  # the run fills the word
            k = (word[far] + 1) * 64 - self.ones[word[far] + 1].astype(np.int64)
            at[far] = self._select(self.zeros, k, True)
        return at


def _put(name: str, data: bytes) -> None:
    """Writes a file of the shared folder under a name of its own, then moves it into place."""
    store, path = fs.FileSystem.from_uri(name)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(draft, compression=None) as out:
        out.write(data)
    try:
        store.move(draft, path)
    except OSError:  # another attempt of this task has put the same bytes there
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise
        store.delete_file(draft)


_maps: dict[str, np.ndarray] = {}


def _map(name: str) -> np.ndarray:
    """A memory map of a file of the shared folder; one that is not a mounted file is copied to an unlinked local file."""
    if name not in _maps:
        if len(_maps) > 4096:
            _maps.clear()
        store, path = fs.FileSystem.from_uri(name)
        if isinstance(store, fs.LocalFileSystem):
            _maps[name] = np.memmap(path, np.uint8, "r").view(np.ndarray)
        else:
            with tempfile.TemporaryFile() as own:
                with store.open_input_stream(path) as source:
                    while part := source.read(8 << 20):
                        own.write(part)
                own.flush()
                _maps[name] = np.memmap(own, np.uint8, "r").view(np.ndarray)
    return _maps[name]


def quantise(p: np.ndarray) -> np.ndarray:
    """Natural logarithms of probabilities in steps of ``STEP`` as unsigned 16-bit integers; none is cut to the range."""
    with np.errstate(divide="ignore", invalid="ignore"):
        code = np.round(-np.log(p) / STEP)
    if not ((code >= 0) & (code <= 65535)).all():
        raise ValueError("a probability is not between exp(-46.8) and 1")
    return code.astype("<u2")


_RESTORED = np.exp(-STEP * np.arange(65536))


def restore(code: np.ndarray) -> np.ndarray:
    return _RESTORED[code]


class Level:
    """One shard of a level: contexts, pointers, following tokens, and their probabilities."""

    def __init__(self, name: str, vocabulary: int):
        data, at = _map(name), 0
        self.v = np.uint64(vocabulary)
        self.contexts, at = EliasFano.read(data, at)
        self.pointers, at = EliasFano.read(data, at)
        self.follow, at = EliasFano.read(data, at)
        self.prob = data[at : at + 2 * self.follow.n].view("<u2")

    @staticmethod
    def build(ctx: np.ndarray, token: np.ndarray, prob: np.ndarray, vocabulary: int) -> bytes:
        """From n-grams sorted by context and token."""
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
        rank = np.cumsum(np.bincount(first, minlength=len(ctx))) - 1 if len(ctx) else np.zeros(0, np.int64)
        out = io.BytesIO()
        EliasFano.write(out, ctx[first])
        EliasFano.write(out, np.append(first, len(ctx)))
        EliasFano.write(out, rank.astype(np.uint64) * np.uint64(vocabulary) + token.astype(np.uint64))
        out.write(quantise(prob).tobytes())
        return out.getvalue()

    def find(self, ctx: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Places of the n-grams, which are sorted by context and token; -1 if absent."""
        out = np.full(len(ctx), -1, np.int64)
        if not len(ctx):
            return out
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        times = np.diff(np.append(first, len(ctx)))
        c = self.contexts.find(ctx[first].astype(np.uint64))
        seen = np.maximum(c, 0)
        a = np.where(c >= 0, self.pointers.get(seen).astype(np.int64), 0) if self.contexts.n else np.zeros(len(c), np.int64)
        b = np.where(c >= 0, self.pointers.get(seen + 1).astype(np.int64), 0) if self.contexts.n else a
        own = np.flatnonzero(np.repeat(c, times) >= 0)
        wide = lambda x: np.repeat(x, times)[own]
        out[own] = self.follow.find(wide(seen).astype(np.uint64) * self.v + token[own].astype(np.uint64), wide(a), wide(b))
        return out


class Model:
    """The trie as a task sees it: names and sizes only; files are mapped on use."""

    def __init__(self, folder: str, shards: int, order: int):
        self.folder, self.shards, self.order = folder, shards, order
        self.base: list[np.ndarray] = []  # number of the first n-gram of each shard, by level
        self.sizes: list[int] = []  # n-grams by level
        self.tokens = self.types = 0
        self._open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def name(self, level: int, shard: int, what: str = "grams") -> str:
        return f"{self.folder_of(level, what)}/{shard:07d}"

    def folder_of(self, level: int, what: str) -> str:
        return f"{self.folder}/level-{level}-{what}"

    def _level(self, level: int, shard: int):
        if (level, shard) not in self._open:
            if level == 1:
                data = _map(self.name(1, shard))
                ef, at = EliasFano.read(data, 0)
                self._open[1, shard] = (ef, data[at : at + 8 * ef.n].view("<i8"))
            else:
                self._open[level, shard] = Level(self.name(level, shard), self.types)
        return self._open[level, shard]

    def shards_of(self, level: int, ids: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """The shards that hold the n-grams with these numbers (in order), each with its part of them and their places there."""
        base = self.base[level - 1]
        cuts = np.searchsorted(ids, np.append(base, np.iinfo(np.int64).max))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            part = slice(int(cuts[s]), int(cuts[s + 1]))
            yield s, part, ids[part] - base[s]

    def counts(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Training counts of the (known) n-grams of ``level`` with these numbers, which are in order."""
        out = np.empty(len(ids), np.int64)
        for s, part, at in self.shards_of(level, ids):
            if level == 1:
                n = self._level(1, s)[1]
            else:
                data = _map(self.name(level, s, "counts"))
                n = data[8:].view(f"<u{int(data[:8].view('<u8')[0])}")
            out[part] = n[at]
        return out

    def split(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Places of each shard's rows, in order; small integers sort by radix."""
        small = shard.astype(np.uint16 if self.shards <= 1 << 16 else np.uint32)
        order = np.argsort(small, kind="stable")
        cuts = np.searchsorted(small[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            if cuts[s + 1] > cuts[s]:
                yield s, order[cuts[s] : cuts[s + 1]]

    def number(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and training count of each token."""
        back, each = pd.factorize(hashed)
        order = np.argsort(each)
        ids, counts = np.full(len(each), -1, np.int64), np.zeros(len(each), np.int64)
        for s, k in self.split(shard_of_token(each[order], self.shards)):
            own = order[k]
            ef, n = self._level(1, s)
            at = ef.find(each[own])
            ok = at >= 0
            ids[own[ok]], counts[own[ok]] = self.base[0][s] + at[ok], n[at[ok]]
        return ids[back], counts[back]

    def descend(self, level: int, ctx: np.ndarray, token: np.ndarray, weights: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each n-gram of ``level`` (-1: unseen or unknown parts), its discounted probability (0 then), and
        the context's weight of the shorter one (1 for contexts never seen). Distinct questions are asked once, in order."""
        out, prob, weight = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx)), np.ones(len(ctx))
        known = np.flatnonzero(ctx >= 0)
        if not len(known):
            return out, prob, weight
        c, t = ctx[known].astype(np.uint64), (token[known] + 1).astype(np.uint64)  # 0 is an unknown token
        order = np.lexsort((t, c)) if (int(c.max()) + 1) * (self.types + 1) >= 2**64 else np.argsort(c * np.uint64(self.types + 1) + t)
        c, t = c[order], t[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])])
        back = np.cumsum(new) - 1
        c, t = c[new], t[new]
        g, p = np.full(len(c), -1, np.int64), np.zeros(len(c))
        asked = np.flatnonzero(t > 0)
        for s, k in self.split(shard_of_gram(c[asked], t[asked] - np.uint64(1), self.shards)):
            own = asked[k]
            lev = self._level(level, s)
            at = lev.find(c[own], t[own] - np.uint64(1))
            ok = np.flatnonzero(at >= 0)
            g[own[ok]] = self.base[level - 1][s] + at[ok]
            p[own[ok]] = restore(lev.prob[at[ok]])
        out[known[order]], prob[known[order]] = g[back], p[back]
        if weights:
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            w = self.backoff(level, c[first].astype(np.int64))
            weight[known[order]] = np.repeat(w, np.diff(np.append(first, len(c))))[back]
        return out, prob, weight

    def backoff(self, level: int, ctx: np.ndarray) -> np.ndarray:
        """Weights of distinct contexts in order, each kept under the number that the context has as an n-gram."""
        out = np.ones(len(ctx))
        for s, part, at in self.shards_of(level - 1, ctx):
            out[part] = restore(_map(self.name(level, s, "weights")).view("<u2")[at])
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.tokens + 0.1 * (self.types + 1))

    def probabilities(self, ids: np.ndarray, counts: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Probability of each token after those before it in its row."""
        p, ctx = self.unigram(counts), None
        chains = [ids]
        for k in range(2, self.order + 1):
            last = chains[-1]  # (k-1)-gram ending at each place
            ctx = np.full(len(ids), -1, np.int64)
            ctx[1:] = np.where(row[1:] == row[:-1], last[:-1], -1)
            gram, prob, weight = self.descend(k, ctx, ids)
            p = prob + weight * p
            chains.append(gram)
        return p


def shard_of_token(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(h) % np.uint64(shards)).astype(np.int64)


def shard_of_gram(ctx: np.ndarray, token: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(mix64(ctx.astype(np.uint64)) + (mix64(token.astype(np.uint64)) & np.uint64(SPLIT - 1))) % np.uint64(shards)).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, an end after each, and each one's row."""
    h, row = words(data, offsets)
    n = np.bincount(row, minlength=len(offsets) - 1)
    out = np.full(len(h) + len(n), END, np.uint64)
    own = np.repeat(np.arange(len(n)), n + 1)
    out[np.arange(len(h)) + row] = h
    return out, own


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed by byte of the value; the first is sorted and kept as differences."""
    n = len(columns[0])
    first = np.diff(columns[0].astype("<u8"), prepend=np.uint64(0))
    raw = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T).tobytes() for c in (first, *columns[1:]))
    return struct.pack("<QQ", n, len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = struct.unpack_from("<QQ", blob)
    raw = np.frombuffer(pa.decompress(blob[16:], size, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k in ("<u8", *kinds):
        width = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(k).ravel())
        at += n * width
    out[0] = np.cumsum(out[0])
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and rows of many texts at a time, ``GATHER`` tokens or little more; row numbers do not repeat."""
    parts, size, base = [], 0, 0
    for whole in batches:
        for batch in slices(whole, "text"):
            h, row = tokens(*text_bytes(batch.column(batch.schema.get_field_index("text"))))
            parts.append((h, row + base))
            size, base = size + len(h), base + batch.num_rows
            if size >= GATHER:
                yield tuple(np.concatenate(x) for x in zip(*parts))
                parts, size = [], 0
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts))


_BLOBS = "shard int, blob binary"


def _rows(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], ["shard", "blob"])


def _merged(parts: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[list[np.ndarray]]:
    for batch in parts:
        for blob in batch.column("blob").to_pylist():
            yield _unpacked(blob, *kinds)


def _unigrams(texts: DataFrame, model: Model) -> None:
    shards = model.shards

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _ in _batches(batches):
            back, each = pd.factorize(h)
            n = np.bincount(back, minlength=len(each))
            order = np.argsort(each)
            each, n = each[order], n[order]
            yield _rows([(s, _packed(each[own], n[own].astype("<u4"))) for s, own in model.split(shard_of_token(each, shards))])

    def build(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = zip(*_merged(parts, "<u4"))
        h, n = _sums(np.concatenate(h), np.concatenate(n).astype(np.int64))
        out = io.BytesIO()
        EliasFano.write(out, h)
        out.write(n.astype("<i8").tobytes())
        s = key[0].as_py()
        _put(model.name(1, s), out.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(h)]), pa.array([int(n.sum())])], ["shard", "types", "tokens"])

    made = texts.mapInArrow(count, _BLOBS).groupBy("shard").applyInArrow(build, "shard int, types long, tokens long").collect()
    types = np.zeros(shards, np.int64)
    for r in made:
        types[r.shard] = r.types
        model.tokens += r.tokens
    model.base.append(np.cumsum(types) - types)
    model.types = int(types.sum())
    model.sizes.append(model.types)
    _fill(model, 1, {r.shard for r in made}, texts)


def _fill(model: Model, level: int, made: set[int], df: DataFrame) -> None:
    """Empty files for shards that got no rows."""
    for s in sorted(set(range(model.shards)) - made):
        out = io.BytesIO()
        if level == 1:
            EliasFano.write(out, np.zeros(0, np.uint64))
        else:
            out.write(Level.build(*(np.zeros(0, np.uint64),) * 2, np.zeros(0), model.types))
        _driver_put(model.name(level, s), out.getvalue())


def _driver_put(name: str, data: bytes) -> None:
    store, path = fs.FileSystem.from_uri(name)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def _grams(texts: DataFrame, model: Model, level: int) -> None:
    """Counts n-grams of one level and builds its files in the tasks that add them up.

    A context is followed as often as it occurs, as every text ends with a token of its own, so its total is the count that
    the level below has of it.
    """
    shards, kind = model.shards, "<u4" if model.types < 2**32 else "<u8"
    sizes_below = np.diff(np.append(model.base[level - 2], model.sizes[level - 2]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, row in _batches(batches):
            ids, _ = model.number(h)
            last = ids
            for k in range(2, level):
                ctx = np.full(len(ids), -1, np.int64)
                ctx[1:] = np.where(row[1:] == row[:-1], last[:-1], -1)
                last, _, _ = model.descend(k, ctx, ids, weights=False)
            own = np.flatnonzero(row[1:] == row[:-1])
            ctx, token = last[own], ids[own + 1]
            ok = (ctx >= 0) & (token >= 0)
            c, t, n = _gram_sums(ctx[ok].astype(np.uint64), token[ok].astype(np.uint64), np.ones(int(ok.sum()), np.int64), model.types)
            yield _rows([(s, _packed(c[k], t[k].astype(kind), n[k].astype("<u4"))) for s, k in model.split(shard_of_gram(c, t, shards))])

    def build(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = key[0].as_py()
        c, t, n = (np.concatenate(x) for x in zip(*_merged(parts, kind, "<u4")))
        c, t, n = _gram_sums(c, t.astype(np.uint64), n.astype(np.int64), model.types)
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        kinds = np.diff(np.append(first, len(c)))
        total = np.repeat(model.counts(level - 1, c[first].astype(np.int64)), kinds)
        _put(model.name(level, s), Level.build(c, t, (n - DISCOUNT) / total, model.types))
        if level < model.order:
            _put(model.name(level, s, "counts"), _narrow(n))
        each = c[first].astype(np.int64)
        yield _rows([(w, _packed(each[k], kinds[k].astype("<u4"))) for w, k, _ in model.shards_of(level - 1, each)] + [(-1 - s, struct.pack("<Q", len(c)))])

    def weigh(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = key[0].as_py()
        if s < 0:  # a shard's size
            sizes = [struct.unpack("<Q", blob)[0] for batch in parts for blob in batch.column("blob").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([sizes[0]])], ["shard", "grams"])
            return
        each, kinds = _sums(*(np.concatenate(x) for x in zip(*_merged(parts, "<u4"))))
        each = each.astype(np.int64)
        weight = np.zeros(sizes_below[s], "<u2")  # n-grams that end a text are no contexts
        weight[each - model.base[level - 2][s]] = quantise(np.minimum(1.0, DISCOUNT * kinds / model.counts(level - 1, each)))
        _put(model.name(level, s, "weights"), weight.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([0])], ["shard", "grams"])

    built = texts.mapInArrow(count, _BLOBS).groupBy("shard").applyInArrow(build, _BLOBS).groupBy("shard").applyInArrow(weigh, "shard int, grams long").collect()
    sizes = np.zeros(shards, np.int64)
    for r in built:
        if r.shard < 0:
            sizes[-1 - r.shard] = r.grams
    model.base.append(np.cumsum(sizes) - sizes)
    model.sizes.append(int(sizes.sum()))
    _fill(model, level, {-1 - r.shard for r in built if r.shard < 0}, texts)
    for s in sorted(set(np.flatnonzero(sizes_below).tolist()) - {r.shard for r in built}):
        _driver_put(model.name(level, s, "weights"), np.zeros(sizes_below[s], "<u2").tobytes())


def _narrow(n: np.ndarray) -> bytes:
    """Counts as 32-bit integers if they fit, behind the size of one."""
    kind = np.dtype("<u4" if not len(n) or int(n.max()) < 2**32 else "<u8")
    return struct.pack("<Q", kind.itemsize) + n.astype(kind).tobytes()


def _gram_sums(ctx: np.ndarray, token: np.ndarray, n: np.ndarray, types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, token) in order, and the sums of ``n``."""
    if not len(ctx):
        return ctx, token, n
    if (int(ctx.max()) + 1) * types < 2**64:  # one key sorts faster than two
        key, n = _sums(ctx * np.uint64(types) + token, n)
        return key // np.uint64(types), key % np.uint64(types), n
    order = np.lexsort((token, ctx))
    ctx, token, n = ctx[order], token[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (ctx[1:] != ctx[:-1]) | (token[1:] != token[:-1])]))
    return ctx[first], token[first], np.add.reduceat(n, first)


def train(texts: DataFrame, text: str = "text", order: int = 3, shards: int | None = None) -> Model:
    """A model of all whole ``texts``; null texts count as empty (one end token). No texts give a model without types,
    for which every token is unknown. Shards follow the size of the texts, so that one has some ``SHARD / 6`` tokens at most
    before equal n-grams are added up, whatever the corpus."""
    spark = texts.sparkSession
    rows = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    if shards is None:
        shards = max(4, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD))
    model = Model(scratch(spark, "trie"), shards, order)
    _unigrams(rows, model)
    for level in range(2, order + 1):
        release(spark)
        _grams(rows, model, level)
        if level > 2:
            remove(model.folder_of(level - 1, "counts"))
    release(spark)
    return model


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of each whole text, in one narrow stage.

    Null and empty texts have the end token only; repeated rows give repeated results; an empty table an empty one.
    Other columns are not read. ``base_score`` is exact; ``score`` has the quantised probabilities of the trie, each within
    0.036 % of its value whatever the size of the corpus.
    """
    schema = T.StructType([df.schema[key], *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])
    names = [f.name for f in schema.fields]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for whole in batches:
            for batch in slices(whole, "text", 6 << 20):
                h, row = tokens(*text_bytes(batch.column(1)))
                ids, counts = m.number(h)
                p = m.probabilities(ids, counts, row)
                rows = batch.num_rows
                sums = [np.bincount(row, np.log10(x), rows) for x in (m.unigram(counts), p)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, minlength=rows)), pa.array(np.bincount(row, counts > 0, rows).astype(np.int64)), pa.array(np.full(rows, m.tokens)), *map(pa.array, sums)], names)

    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)
