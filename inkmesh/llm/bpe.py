"""Operator 1: BPE encoding and decoding with a public word-end vocabulary.

A text is split as the vocabulary's file says (NFC, white space, lower case, pattern), and each
distinct word is merged by a *contiguous rank array*: one row holds the word's parts, a second the
ranks of adjacent pairs; the minimum is found by a scan, its boundary deleted and the two
neighbouring ranks looked up again. Words of equal length share one matrix, so that a scan is one
numpy call for thousands of words. Words beyond ``SHORT`` bytes, for which scanning would be
quadratic, take a heap over linked parts with the same order of merges.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held, slices

#: Longest word, in bytes, merged by scanning.
SHORT = 64
#: Cached words per Python worker; at more, the cache starts anew.
CACHE = 800_000
NONE = np.int32(2**31 - 1)
#: White space in Python's str.split() that Unicode's White_Space lacks.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPLIT = regex.compile(r"\p{White_Space}+")


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file; one per Python worker and path (see ``load``)."""

    _loaded: dict[str, "WordBpe"] = held("words")

    @classmethod
    def load(cls, path: str) -> "WordBpe":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._index(left << 20 | right)
        self.chunks: dict[str, bytes] = {}

    def _index(self, keys: np.ndarray) -> None:
        """Ranks by pair in an open hash table that whole arrays can probe."""
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slots = self._slot(keys)
        self.probes = 1
        taken: dict[int, int] = {}
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist())):
            if key in taken:
                continue
            n = 1
            while self.slot_key[slot] >= 0:
                slot, n = (slot + 1) % len(self.slot_key), n + 1
            self.slot_key[slot], self.slot_rank[slot], taken[key] = key, rank, rank
            self.probes = max(self.probes, n)
        self.rank_of = taken

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        slots = self._slot(keys)
        found = self.slot_key[slots]
        out = np.where(found == keys, self.slot_rank[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots.flat[open_] = (slots.flat[open_] + 1) % len(self.slot_key)
            found = self.slot_key[slots.flat[open_]]
            hit = found == keys.flat[open_]
            out.flat[open_[hit]] = self.slot_rank[slots.flat[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _merge_short(self, raw: list[bytes]) -> list[bytes]:
        """Words of one length, one row each."""
        n = len(raw[0])
        data = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, n)
        ids = self.inner[data]
        ids[:, -1] = self.last[data[:, -1]]
        rows, out = np.arange(len(raw)), [b""] * len(raw)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:]) if n > 1 else np.zeros((len(raw), 0), np.int32)
        while len(rows):
            width = ids.shape[1]
            low = ranks.min(1) if width > 1 else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                flat = ids[done].astype("<u4").tobytes()
                for k, r in enumerate(rows[done].tolist()):
                    out[r] = flat[4 * width * k : 4 * width * (k + 1)]
                keep = ~done
                rows, ids, ranks, low = rows[keep], ids[keep], ranks[keep], low[keep]
                if not len(rows):
                    break
            at, every = ranks.argmin(1), np.arange(len(rows))
            ids[every, at] = self.merged[low]
            cols = np.arange(width - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, cols[:-1] + (cols[:-1] >= at[:, None]), 1)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self._ranks(ids[has, at[has] - 1], ids[has, at[has]])
            has = np.flatnonzero(at < width - 2)
            ranks[has, at[has]] = self._ranks(ids[has, at[has]], ids[has, at[has] + 1])
        return out

    def _merge_long(self, raw: bytes) -> bytes:
        data = np.frombuffer(raw, np.uint8)
        ids = self.inner[data].tolist()
        ids[-1] = int(self.last[data[-1]])
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        rank = lambda i: self.rank_of.get(ids[i] << 20 | ids[after[i]]) if after[i] >= 0 else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _learn(self, fresh: list[str]) -> None:
        """Puts chunks (texts without white space) into the cache."""
        known = self.chunks
        mixed = [(c, (c[:-1], c[-1]) if c[-1] in ",." and c[:-1].isalpha() and c.isascii() else self.pieces.findall(c)) for c in fresh if not c.isalpha()]
        plain = {c for c in fresh if c.isalpha()}
        plain.update(p for _, parts in mixed for p in parts if p not in known)
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for w in plain:
            raw = w.encode("utf-8", "surrogatepass")
            own = by_length.get(n := min(len(raw), SHORT + 1))
            if own is None:
                own = by_length[n] = ([], [])
            own[0].append(w)
            own[1].append(raw)
        for n, (names, raws) in by_length.items():
            known.update(zip(names, map(self._merge_long, raws) if n > SHORT else self._merge_short(raws)))
        for c, parts in mixed:
            known[c] = b"".join([known[p] for p in parts])

    @staticmethod
    def _split(text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case by character: no final sigma
        text = text.lower()
        return text.split() if not _SEPARATORS.search(text) else [c for c in _SPLIT.split(text) if c]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        split, marks = [], {i.to_bytes(4, "little") for i in self.special.values()}
        for text in texts:
            if self.special_re and text and "<|" in text and self.special_re.search(text):
                parts = [self.special[p].to_bytes(4, "little") if p in self.special else self._split(p) for p in self.special_re.split(text)]
            else:
                parts = [self._split(text or "")]
            split.append(parts)
        fresh: set[str] = set()
        for parts in split:
            for p in parts:
                if p not in marks if isinstance(p, bytes) else True:
                    fresh.update(p)
        known = self.chunks
        if len(known) + len(fresh) > CACHE:
            known.clear()
        missing = [c for c in fresh if c not in known]
        if missing:
            self._learn(missing)
        at = self.chunks.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(at, p)) for p in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        """The tokens' own strings joined by one space: the vocabulary names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _extended(df: DataFrame, add: list[T.StructField], drop: tuple[str, ...] = ()) -> T.StructType:
    taken = {f.name.lower() for f in add}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in taken and f.name not in drop] + add)


def _kept(batch: pa.RecordBatch, schema: T.StructType, n_new: int) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields[: len(schema.fields) - n_new]]


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``; with ``decoded``, also the text
    that those ids decode to. One narrow stage, no shuffle.

    Nulls count as empty texts: no ids, 0 tokens, decoded empty. Texts of any length are taken whole; repeated
    rows give repeated results; an empty table gives an empty table. Other columns pass unchanged, except that
    one with the name of an added column is replaced.
    """
    add = [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    schema = _extended(df, add)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer)
        for whole in batches:
            for batch in slices(whole, text):
                out = bpe.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
                new = [pa.array(out, pa.binary()), pa.array([len(x) >> 2 for x in out], pa.int64())]
                if decoded:
                    new.append(pa.array([bpe.decode(x) for x in out], pa.string()))
                yield pa.RecordBatch.from_arrays(_kept(batch, schema, len(new)) + new, names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids as ``encode`` makes it; null ids give a null text."""
    schema = _extended(df, [T.StructField(text, T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(tokenizer)
        for whole in batches:
            for batch in slices(whole, ids):
                out = [None if x is None else bpe.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*_kept(batch, schema, 1), pa.array(out, pa.string())], names)

    return df.mapInArrow(run, schema)
