"""Operator 11: byte-level BPE encoding and decoding by a public rank file, split without regular expressions.

Texts are one array of code points. A table gives each its class (letter, number, space, other white space,
other), an apostrophe's class says which contraction would follow. Each class is a transition function of an
eight-state automaton; the functions' compositions are a small closed set, so an associative scan over their
numbers, by table lookups on whole arrays, gives the state before each code point and with it the places where
pieces begin. The pieces are slices of the UTF-8 bytes, merged once each and cached; their offsets stay with the
ids, so that a text, or any run of tokens of it, is laid back at its place.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import SHORT, WordBpe, _extended, _kept
from .common import held, slices, text_bytes

#: Bytes of pieces and ids that a worker's cache holds, and of the longest piece that goes there.
CACHE_BYTES, CACHED = 96 << 20, 256
#: Bytes of texts (or ids) that are handled at once.
SLICE = 4 << 20

LETTER, NUMBER, SPACE, WHITE, OTHER, SHORTENED, CONTRACTED = range(7)
#: States: nothing before, in a run of each class, and one or two code points before a contraction ends.
START, IN_LETTERS, IN_NUMBERS, AFTER_SPACE, AFTER_WHITE, IN_OTHERS, LAST, MORE = range(8)

#: Unicode's White_Space.
_WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: Letters and numbers of Unicode 16, which the library knows and older Python versions do not.
_LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
_NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def _classes() -> np.ndarray:
    """The class of every code point."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, kind in ((_LETTERS_16, LETTER), (_NUMBERS_16, NUMBER), (_WHITE, WHITE)):
        for a, b in ranges:
            table[a : b + 1] = kind
    table[0x20] = SPACE
    return table


def _step(state: int, kind: int) -> int:
    if state in (MORE, LAST):
        return LAST if state == MORE else START
    if kind in (SHORTENED, CONTRACTED) and state not in (IN_OTHERS, AFTER_SPACE):
        return LAST if kind == SHORTENED else MORE
    return (IN_LETTERS, IN_NUMBERS, AFTER_SPACE, AFTER_WHITE, IN_OTHERS, IN_OTHERS, IN_OTHERS)[kind]


def _begins(state: int, kind: int) -> bool:
    """Whether a piece begins here. White space before a solid code point begins one besides."""
    if state in (MORE, LAST):
        return False
    joined = {LETTER: (IN_LETTERS, AFTER_SPACE), NUMBER: (IN_NUMBERS, AFTER_SPACE), SPACE: (AFTER_SPACE, AFTER_WHITE), WHITE: (AFTER_SPACE, AFTER_WHITE)}
    return state not in joined.get(kind, (IN_OTHERS, AFTER_SPACE))


class Splitter:
    """The automaton's closed set of transition functions, and the scan over it."""

    def __init__(self):
        self.kinds = _classes()
        steps = [tuple(_step(s, k) for s in range(8)) for k in range(7)]
        resets = [(f[START],) * 8 for f in steps]  # of a text's first code point
        numbers = {f: n for n, f in enumerate(dict.fromkeys([tuple(range(8)), *steps, *resets]))}
        todo = list(numbers)
        while todo:  # the closure under composition
            f = todo.pop()
            for g in (*steps, *resets):
                h = tuple(g[x] for x in f)
                if h not in numbers:
                    numbers[h] = len(numbers)
                    todo.append(h)
        every = list(numbers)
        self.size = len(every)
        self.then = np.array([[numbers[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16).ravel()
        self.maps = np.array(every, np.uint8)
        self.of_kind = np.array([numbers[f] for f in steps], np.uint16)
        self.of_first = np.array([numbers[f] for f in resets], np.uint16)
        self.begins = np.array([[_begins(s, k) for k in range(7)] for s in range(8)])

    def scan(self, functions: np.ndarray, width: int = 256) -> np.ndarray:
        """The composition of each prefix: within rows of ``width`` first, all rows at once, then over the rows' totals."""
        n = len(functions)
        if n <= width:
            return np.fromiter(accumulate(functions.tolist(), lambda f, g: int(self.then[f * self.size + g])), np.uint16, n)
        rows = -(-n // width)
        grid = np.zeros(rows * width, np.uint16)  # 0 is the identity
        grid[:n] = functions
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        for j in range(1, width):
            grid[j] = self.then[grid[j - 1].astype(np.intp) * self.size + grid[j]]
        before = np.zeros(rows, np.intp)
        before[1:] = self.scan(grid[-1], width)[:-1]
        return self.then[before * self.size + grid].T.ravel()[:n]

    def split(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Places in ``points`` where pieces begin; a text begins at each of ``firsts`` (ascending, without repeats)."""
        kinds = self.kinds[points]
        white = (kinds == SPACE) | (kinds == WHITE)
        ahead = np.zeros((2, len(points)), points.dtype)  # the next two code points of the same text, else 0
        ends = np.append(firsts[1:], len(points)) - 1
        for k, row in enumerate(ahead):
            row[:-1] = (points, ahead[0])[k][1:]
            row[ends] = 0
        solid_next = np.zeros(len(points), bool)
        solid_next[:-1] = ~white[1:]
        solid_next[ends] = False
        at = np.flatnonzero(points == ord("'"))
        one, two = ahead[0][at], ahead[1][at]
        kinds[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORTENED
        kinds[at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = CONTRACTED
        functions = self.of_kind[kinds]
        functions[firsts] = self.of_first[kinds[firsts]]
        before = np.zeros(len(points), np.uint8)
        before[1:] = self.maps[self.scan(functions)[:-1], START]
        before[firsts] = START
        return np.flatnonzero(self.begins[before, kinds] | white & solid_next)


class ByteBpe(WordBpe):
    """Encoder and decoder for one file of ranks; one per Python worker and path (see ``load``)."""

    _loaded: dict[str, "ByteBpe"] = held("bytes")
    _splitter: Splitter | None = None

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.ranks = {token: int(rank).to_bytes(4, "little") for token, rank in ranks.items()}
        self.inner = self.last = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        names = [b""] * size
        for token, rank in ranks.items():
            names[rank] = token
        self.merged = np.arange(size, dtype=np.int32)  # a pair's rank is the id of what it makes
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self.length = np.array([len(t) for t in names], np.int64)
        self.place = np.cumsum(self.length) - self.length
        pairs = [(ranks[t[:k]] << 20 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._index(*(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)))
        self.chunks, self.held = {}, 0
        if ByteBpe._splitter is None:
            ByteBpe._splitter = Splitter()

    def _index(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Ranks by pair in an open hash table that whole arrays can probe; all keys still without a slot try at once."""
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, 2**31 - 1, np.int32)
        open_, slots, self.probes = np.arange(len(keys)), self._slot(keys), 1
        while len(open_):
            free = self.slot_key[slots] < 0
            self.slot_key[slots[free]] = keys[open_[free]]  # of several at one slot, one gets it
            mine = self.slot_key[slots] == keys[open_]
            self.slot_rank[slots[mine]] = ranks[open_[mine]]
            open_, slots = open_[~mine], (slots[~mine] + 1) % len(self.slot_key)
            self.probes += 1
        self.rank_of = dict(zip(keys.tolist(), ranks.tolist()))

    def _learn(self, fresh: set[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that are not whole tokens, merged in one matrix for each length."""
        made, by_length = {}, {}
        for piece in fresh:
            if (whole := self.ranks.get(piece)) is not None:  # a piece that is a token is not merged
                made[piece] = whole
            else:
                by_length.setdefault(min(len(piece), SHORT + 1), []).append(piece)
        for n, pieces in by_length.items():
            made.update(zip(pieces, map(self._merge_long, pieces) if n > SHORT else self._merge_short(pieces)))
        return made

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        known, distinct = self.chunks, set(pieces)
        fresh = {p for p in distinct if p not in known}
        made = self._learn(fresh) if fresh else {}
        size = sum(len(p) + len(x) + 160 for p, x in made.items() if len(p) <= CACHED)  # with what Python itself takes
        if self.held + size > CACHE_BYTES:  # the cache starts anew
            known, self.chunks, self.held = {p: known[p] for p in distinct - fresh}, {}, 0
        known.update(made)
        found = list(map(known.__getitem__, pieces))
        if known is self.chunks:
            self.held += size
            for p in fresh:
                if len(p) > CACHED:
                    del known[p]
        return found

    def encode(self, texts: pa.Array) -> list[tuple[bytes, bytes]]:  # type: ignore[override]
        """Ids of each text, and the byte offsets in it at which its tokens end, as little-endian unsigned 32-bit integers."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return [(b"", b"")] * len(texts)
        raw = data.tobytes()
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts = lead[self._splitter.split(points, np.searchsorted(lead, cuts))]
        found = self._ids([raw[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(raw)])])
        bounds = np.searchsorted(starts, offsets)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            ids = b"".join(found[a:b])
            out.append((ids, np.cumsum(self.length[np.frombuffer(ids, "<u4")]).astype("<u4").tobytes()))
        return out

    def decode(self, ids: bytes, ends: bytes | None = None) -> bytes:  # type: ignore[override]
        """The bytes of a run of tokens. ``ends``, their offsets as ``encode`` gave them, must agree with the ids."""
        own = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(own):
            return b""
        size = self.length[own]
        to = np.cumsum(size)
        if ends is not None:
            given = np.frombuffer(ends, "<u4").astype(np.int64)
            if len(given) != len(own) or not np.array_equal(given - given[0], to - to[0]):
                raise ValueError("offsets that belong to other ids")
        return self.blob[np.repeat(self.place[own] - (to - size), size) + np.arange(to[-1])].tobytes()


def encode(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", ends: str | None = None, decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``; with ``ends``, also the byte offsets at which the
    tokens end (binary, alike); with ``decoded``, the bytes that ids and offsets decode to. One narrow stage, no shuffle.

    Nulls count as empty texts: no ids, 0 tokens, decoded empty. Texts are taken whole, up to 2 GB; a piece of any length is
    merged (beyond ``SHORT`` bytes by a heap). Repeated rows give repeated results; an empty table gives an empty table.
    Other columns pass unchanged, except that one with the name of an added column is replaced.
    """
    binary = [T.StructField(c, T.BinaryType()) for c in (ends, decoded) if c]
    add = [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType()), *binary]
    schema = _extended(df, add)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(ranks)
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                out = bpe.encode(batch.column(batch.schema.get_field_index(text)))
                new = [pa.array([x for x, _ in out], pa.binary()), pa.array([len(x) >> 2 for x, _ in out], pa.int64())]
                if ends:
                    new.append(pa.array([x for _, x in out], pa.binary()))
                if decoded:
                    new.append(pa.array([bpe.decode(*x) for x in out], pa.binary()))
                yield pa.RecordBatch.from_arrays(_kept(batch, schema, len(new)) + new, names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str, ids: str = "ids", ends: str | None = None, decoded: str = "decoded") -> DataFrame:
    """Adds the bytes of a column of ids as ``encode`` makes it, checked against the offsets of ``ends`` if that is given; null
    ids give null. An unknown id, or offsets of other ids, raise."""
    schema = _extended(df, [T.StructField(decoded, T.BinaryType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(ranks)
        for whole in batches:
            for batch in slices(whole, ids, SLICE):
                column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
                out = [None if x is None else bpe.decode(x, e) for x, e in zip(column(ids), column(ends) if ends else [None] * batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*_kept(batch, schema, 1), pa.array(out, pa.binary())], names)

    return df.mapInArrow(run, schema)
