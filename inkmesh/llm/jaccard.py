"""Operator 7: near duplicates by word shingles with a grouped prefix join.

1. Every document becomes its set of shingle hashes. Sets are ordered by (frequency class, chance of the words to meet, hash);
   both come from counting sketches of fixed size over all documents, so shingles that very many documents share, or
   might share by chance, come last. Any global order is exact; this one keeps prefixes selective.
2. Two sets of Jaccard similarity t share a shingle among the first n - ceil(t n) + 1 of each.
   Documents with equal sets are one class; classes with identical prefix and size are one *group*, and
   only groups enter the index.
3. Lists are kept by shingle and size band; one bucket is a list of groups that meet. Group pairs of a bucket are filtered by
   size and by the place of their shingle, the rest expanded to members, and those filtered by a lower bound of their
   difference (parities of their shingles in cells). Of the pairs left, rounds verify those on whole sets that could join
   parts not yet linked, closest first, and last all that remain, so no link between different parts is lost. Large
   buckets are dealt into blocks: first every block by itself, then one member for each part, so that a hot group of
   copies is one part before blocks meet pairwise. A group of m copies costs about m verifications.
4. Verified links are contracted to components by repeated minima over the link table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, discard, give_back, hot_join, hot_keys, mix64, release, runtime_filter, slices, small, text_bytes, words, written

CELLS, SKETCH, BLOCK = 256, 1 << 18, 256
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def windows(hashed: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with ``count`` words each: every shingle's hash, its row and the place of its first word."""
    first = np.cumsum(count) - count
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    own = np.repeat(np.arange(len(count)), size)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(own))
    short = np.flatnonzero(count[own] < width)
    total = np.zeros(len(own), np.uint64)
    for k in range(width):
        term = hashed[np.minimum(at + k, max(0, len(hashed) - 1))] if len(hashed) else total
        term = mix64(term + _PLACE[0] * np.array([k + 1], np.uint64))
        term[short[k >= count[own[short]]]] = (_PLACE[1:] * np.array([k + 1], np.uint64))[0]
        total = total * np.uint64(0x100000001B3) + term
    return mix64(total), own, at


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows and each one's row; once a row and sorted within rows."""
    hashed, row = words(data, offsets)
    total, own, _ = windows(hashed, np.bincount(row, minlength=len(offsets) - 1), width)
    size = np.bincount(own, minlength=len(offsets) - 1)
    for s, n in zip((np.cumsum(size) - size).tolist(), size.tolist()):
        total[s : s + n].sort()
    keep = np.ones(len(own), bool)
    keep[1:] = (total[1:] != total[:-1]) | (own[1:] != own[:-1])
    return total[keep], own[keep]


def ranked_shingles(data: np.ndarray, offsets: np.ndarray, width: int, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingles`` and each one's place in the global order."""
    hashed, row = words(data, offsets)
    total, own, at = windows(hashed, np.bincount(row, minlength=len(offsets) - 1), width)
    size = np.bincount(own, minlength=len(offsets) - 1)
    common = np.full(len(own), order.base, np.int32)
    for k in range(width):
        common += order.words[(hashed[np.minimum(at + k, max(0, len(hashed) - 1))] >> np.uint64(46)).astype(np.int64)] if len(hashed) else 0
    for s, n in zip((np.cumsum(size) - size).tolist(), size.tolist()):
        turn = np.argsort(total[s : s + n])
        total[s : s + n], common[s : s + n] = total[s : s + n][turn], common[s : s + n][turn]
    keep = np.ones(len(own), bool)
    keep[1:] = (total[1:] != total[:-1]) | (own[1:] != own[:-1])
    h = total[keep]
    rank = order.shingles[(h >> np.uint64(46)).astype(np.int64)].astype(np.uint64) << np.uint64(8) | np.clip(common[keep], 0, 255).astype(np.uint64)
    return h, own[keep], rank << np.uint64(50) | h >> np.uint64(14)


class Order(NamedTuple):
    """The global order of shingles: by the class of a shingle's cell, then by how often its words would meet by chance (quarters
    of a power of two), then by hash. ``words`` and ``base`` add up to that. Any order is exact; rare ones first keeps prefixes selective."""

    shingles: np.ndarray
    words: np.ndarray
    base: int


def frequencies(docs: DataFrame, text: str, width: int) -> Order:
    """The order by two counting sketches of ``SKETCH`` cells, of shingles and of words, over all documents. A shingle's class is 0
    up to 4 times the mean load, one more at each doubling. Fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        total = np.zeros(2 * SKETCH, np.int64)
        for whole in batches:
            for batch in slices(whole, text):
                hashed, row = words(*text_bytes(batch.column(0)))
                h, _, _ = windows(hashed, np.bincount(row, minlength=batch.num_rows), width)
                for half, x in enumerate((h, hashed)):
                    total[half * SKETCH : (half + 1) * SKETCH] += np.bincount((x >> np.uint64(46)).astype(np.int64), minlength=SKETCH)
        used = np.flatnonzero(total)
        part = used >> 12
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(used)]):
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([used[a:b].astype("<i4").tobytes()]), pa.array([total[used[a:b]].astype("<i8").tobytes()])], ["part", "cell", "n"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 12, np.int64)
        for batch in parts:
            for c, n in zip(batch.column("cell").to_pylist(), batch.column("n").to_pylist()):
                total[np.frombuffer(c, "<i4") & 4095] += np.frombuffer(n, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["part", "n"])

    total = np.zeros(2 * SKETCH, np.int64)
    counted = docs.select(text).mapInArrow(count, "part int, cell binary, n binary").groupBy("part").applyInArrow(add, "part int, n binary")
    with batch_rows(docs.sparkSession, 1024):
        counted = counted.collect()
    for part, n in counted:
        total[part << 12 : (part + 1) << 12] = np.frombuffer(bytes(n), np.int64)
    load, word = total[:SKETCH] / max(1.0, 4 * total[:SKETCH].mean()), np.maximum(total[SKETCH:], 1)
    kinds = np.where(load > 1, np.ceil(np.log2(np.maximum(load, 1))), 0).astype(np.uint8)
    return Order(kinds, np.rint(4 * np.log2(word / word.sum())).astype(np.int32), int(4 * (np.log2(word.sum()) + 40)))


def signature(h: np.ndarray, mixed: np.ndarray) -> str:
    """Names a set by its size and 128 bits of its hashes."""
    return f"{len(h)}-{int(mixed.sum()):x}-{int(np.bitwise_xor.reduce(h)):x}"


def prefix_size(n: np.ndarray, t: Fraction) -> np.ndarray:
    return n - -(-n * t.numerator // t.denominator) + 1


def features(docs: DataFrame, width: int, t: Fraction, order: Order) -> DataFrame:
    """``key, at, n, sig, shape, cells, prefix``: set size, hash of the set, hash of size and prefix, parities by cell, and the
    prefix: the first shingles in the global order, each as its place there with 50 bits of its hash. Written once; every
    later step reads it."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    kind = docs.schema["key"].dataType.simpleString()
    docs = docs.select("key", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for whole in batches:
            for batch in slices(whole, "text"):
                h, row, placed = ranked_shingles(*text_bytes(batch.column(1)), width, shared.value)
                n = np.bincount(row, minlength=batch.num_rows)
                mixed = mix64(h)
                sig, prefix, shape = [], [], []
                for a, k, p in zip((np.cumsum(n) - n).tolist(), n.tolist(), prefix_size(n, t).tolist()):
                    if not k:
                        sig.append("0"), shape.append("0"), prefix.append(placed[:0])
                        continue
                    sig.append(signature(h[a : a + k], mixed[a : a + k]))
                    own = np.sort(placed[a : a + k])[:p]
                    shape.append(f"{k}-{int(mix64(own).sum()):x}-{int(np.bitwise_xor.reduce(own)):x}")
                    prefix.append(own)
                ends = np.cumsum([0, *map(len, prefix)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n.astype(np.int64)), pa.array(sig), pa.array(shape), cell_parities(h, n, t), lists], ["key", "at", "n", "sig", "shape", "cells", "prefix"])

    return written(docs.mapInArrow(run, f"key {kind}, at long, n long, sig string, shape string, cells binary, prefix array<long>"), "shingles", 1024)


def cell_parities(h: np.ndarray, n: np.ndarray, t: Fraction) -> pa.Array:
    """Bits of each row's set: whether a cell, named by the low bits of a hash, holds an odd number of shingles. A set has ``CELLS``
    cells or, if larger, the power of two above three times the shingles in which sets of its size that link may differ:
    unrelated sets differ in half of the cells."""
    a, b = t.numerator, t.denominator
    out = []
    for at, k, apart in zip((np.cumsum(n) - n).tolist(), n.tolist(), (2 * n * (b - a) // (a + b)).tolist()):
        cells = max(CELLS, 1 << (3 * apart).bit_length())
        count = np.bincount((h[at : at + k] & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        out.append(np.packbits((count & 1).astype(np.uint8)).tobytes())
    return pa.array(out, pa.binary())


def folded(cells: np.ndarray, width: int) -> np.ndarray:
    """The same parities in fewer cells; sizes are in bytes of eight cells."""
    while len(cells) > width:
        half = len(cells) // 2
        cells = cells[:half] ^ cells[half:]
    return cells


def size_band(n: Column, t: Fraction) -> Column:
    """Sizes whose ratio is ``t`` or more lie in one band or in neighbouring ones (bands are a little wider than that ratio)."""
    return F.floor(F.log(n) / (1.0001 * math.log(t.denominator / t.numerator))).cast("int") if t < 1 else n.cast("int")


def group_buckets(classes: DataFrame, t: Fraction) -> DataFrame:
    """``bucket, key, gid, pos`` of classes: those of one group (bucket ``-1 - gid``), and those of groups that share a prefix
    shingle and whose sizes allow links. ``pos`` is the shingle's place in the prefix.

    Shingles of two or more groups have lists of them; equal lists are one. A list is cut by size band, each group under its
    own band and the next, so that groups that may link meet and a very frequent shingle is many buckets. A band with no group
    of its own repeats the one before and is left out, and so are two groups whose sizes or places allow no link.
    """
    groups = classes.groupBy("shape").agg(F.min("key").alias("gid"), F.count(F.lit(1)).alias("members"))
    groups = written(groups.filter("members > 1").select("shape", "gid"), "groups")
    several = written(hot_join(classes.select("key", "shape"), groups, "shape").select("key", "gid"), "several")
    leaders = classes.select(F.col("key").alias("gid"), "n", "prefix").join(small(several.filter("key <> gid").select(F.col("key").alias("gid"))), "gid", "left_anti")
    entries = written(leaders.select("gid", "n", F.posexplode("prefix").alias("pos", "item")), "entries")
    shared = entries.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("gid")).alias("x"), F.bit_xor(F.xxhash64("gid", F.lit(7))).alias("y")).filter("c > 1")
    lists = written(shared.groupBy("c", "x", "y").agg(F.min("item").alias("item")).select("item", F.col("c").alias("n")), "lists")
    with runtime_filter(classes.sparkSession):  # most shingles of prefixes are of one group alone
        found = written(hot_join(entries, lists.filter("n > 1").select("item"), "item", lists), "found")
    discard(entries)
    own, place = size_band(F.col("n"), t), F.shiftleft("n", 31).bitwiseOR(F.col("pos").cast("long"))
    found = found.select("item", "gid", "pos", own.alias("own"), place.alias("place"), F.explode(F.array(own, own + 1)).alias("band"))
    met = found.groupBy("item", "band").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("top"), F.min("place").alias("p"), F.max("place").alias("q"))
    (m, i), (n, j) = ((F.shiftright(c, 31), F.col(c).bitwiseAND(F.lit((1 << 31) - 1))) for c in "pq")  # sizes and places of two groups
    fits = (m * t.denominator >= n * t.numerator) & ((F.least(i, j) + F.least(m - i, n - j)) * (t.numerator + t.denominator) >= (m + n) * t.numerator)
    met = met.filter((F.col("n") > 1) & (F.col("top") == F.col("band")) & ((F.col("n") > 2) | fits)).select("item", "band", "n")
    met = written(met.withColumn("bucket", F.monotonically_increasing_id()), "met")  # numbers are fixed by writing
    hits = written(hot_join(found.drop("own", "place"), met.drop("n"), ["item", "band"], met).select("bucket", "gid", "pos"), "hits")
    alone = hits.join(small(several.select("gid").distinct()), "gid", "left_anti").select("bucket", F.col("gid").alias("key"), "gid", "pos")
    full = hot_join(several, hits, "gid").select("bucket", "key", "gid", "pos")
    own = several.select((-1 - F.col("gid")).alias("bucket"), "key", "gid", F.lit(0).alias("pos"))
    return written(alone.unionByName(full).unionByName(own), "buckets")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, sig, text`` of the classes ``keys(key, sig, at)``, each from a document found by ``at`` (or from several: those whose
    set is another are told apart by ``sig`` when it is used). Repeated rows come once. Where keys are too many to broadcast,
    Spark's own runtime filter (of a fixed size) keeps most other texts out of the shuffle; it wants a predicate on ``keys``."""
    keys = keys.filter("key >= 0")
    found = docs.select("at", "text").join(small(keys), "at").select("at", "key", "sig", "text")
    repeated = docs.select("at").join(small(keys.select("at").distinct()), "at", "left_semi").groupBy("at").count().filter("count > 1").select("at")
    with runtime_filter(docs.sparkSession):
        repeated = written(repeated, "repeated")
        if not repeated.isEmpty():
            repeated = small(repeated)
            found = found.join(repeated, "at", "left_anti").unionByName(found.join(repeated, "at", "left_semi").dropDuplicates(["key", "text"]))
        return written(found.drop("at"), "texts")


def admitted(cells: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, t: Fraction, room: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that sizes and cells admit, and in how many cells they differ.

    Sets that differ in d shingles differ in d cells at most, so ``shared <= (n_i + n_j - apart) / 2``; a pair
    stays if ``t * union <= shared`` is still possible.
    """
    a, b = t.numerator, t.denominator
    fits = np.flatnonzero((n[i] * b >= n[j] * a) & (n[j] * b >= n[i] * a))
    i, j = i[fits], j[fits]
    apart = np.empty(len(i), np.int64)
    own = np.array([len(c) for c in cells], np.int64)
    width = np.minimum(own[i], own[j])
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        used, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        table = np.stack([folded(np.frombuffer(cells[k], np.uint8), w) for k in used.tolist()])
        x, y = back[: len(at)], back[len(at) :]
        step = max(1, room // w)
        for k in range(0, len(at), step):
            apart[at[k : k + step]] = np.bitwise_count(table[x[k : k + step]] ^ table[y[k : k + step]]).sum(1, dtype=np.int32)
    ok = np.flatnonzero((a + b) * (n[i] + n[j] - apart) >= 2 * a * (n[i] + n[j]))
    return i[ok], j[ok], apart[ok]


def forest(size: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Indexes of pairs that join all parts which the pairs join, one less than parts, closest pairs first: each part takes
    its closest pair, parts merge, and again."""
    label, out = part.copy(), []
    rank = np.empty(len(i), np.int64)
    rank[np.lexsort((np.arange(len(i)), apart))] = np.arange(len(i))
    live = np.arange(len(i))
    while True:
        live = live[label[i[live]] != label[j[live]]]
        if not len(live):
            return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        best = np.full(size, len(i), np.int64)
        np.minimum.at(best, label[i[live]], rank[live])
        np.minimum.at(best, label[j[live]], rank[live])
        taken = live[(rank[live] == best[label[i[live]]]) | (rank[live] == best[label[j[live]]])]
        out.append(taken)
        a, b = label[i[taken]], label[j[taken]]
        up = np.arange(size)
        while True:  # the smallest label that the taken pairs reach
            low = np.minimum(up[a], up[b])
            before = up.copy()
            np.minimum.at(up, up[a], low)
            np.minimum.at(up, up[b], low)
            up = up[up]
            if (up == before).all():
                break
        label = up[label]


def pairs_within(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places, each with itself too, inside runs that begin at ``first``."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(size).tolist():
        own = first[size == s][:, None]
        x, y = np.triu_indices(s)
        i.append((own + x).ravel()), j.append((own + y).ravel())
    return np.concatenate(i), np.concatenate(j)


def chunks(weight: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` in weight, one item at least."""
    if len(weight):
        part = (np.cumsum(weight, dtype=np.int64) - weight) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(weight)]
        yield from zip(cuts, cuts[1:])


class Rows:
    """Whole blocks of buckets, sorted by block, group and key; members are told by their places."""

    def __init__(self, table: pa.Table):
        col = lambda c: table.column(c).to_numpy()
        self.key, self.side, self.n = col("key"), col("side"), col("n")
        self.cells = table.column("cells").to_pylist()
        name = np.stack([col("bucket"), col("lo"), col("hi")], 1)
        new = np.concatenate([[True], (name[1:] != name[:-1]).any(1)]) if len(name) else np.zeros(0, bool)
        self.block = np.cumsum(new) - 1
        #: parts, numbered in each block
        self.part = np.unique(np.stack([self.block, np.unique(col("part"), return_inverse=True)[1]], 1), axis=0, return_inverse=True)[1].ravel()
        gid, pos = col("gid"), col("pos")
        lead = np.flatnonzero(new | np.concatenate([[True], gid[1:] != gid[:-1]]) if len(new) else new)
        self.first, self.members, self.group_n, self.pos = lead, np.diff(np.append(lead, len(gid))), self.n[lead], np.minimum.reduceat(pos.astype(np.int64), lead) if len(lead) else pos.astype(np.int64)
        begin = np.flatnonzero(new[lead])
        self.run, self.groups = begin, np.diff(np.append(begin, len(lead)))

    def pairs(self, t: Fraction, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Admitted pairs of members of different parts, some ``most`` looked at at a time: group pairs are formed and filtered
        by size and position, the rest expanded to members, and those filtered by their cells."""
        a, b = t.numerator, t.denominator
        for lo, hi in chunks(self.groups * (self.groups + 1) // 2, most):
            g, h = pairs_within(self.run[lo:hi], self.groups[lo:hi])
            ng, nh, pg, ph = self.group_n[g], self.group_n[h], self.pos[g], self.pos[h]
            # what both can share: places up to the common shingle, and what is left after it
            shared = np.minimum(pg, ph) + 1 + np.minimum(ng - pg, nh - ph) - 1
            lone = self.groups[np.searchsorted(self.run, g, "right") - 1] == 1  # a group's own bucket: members meet each other
            fits = (ng * b >= nh * a) & (nh * b >= ng * a) & ((a + b) * shared >= a * (ng + nh))
            keep = np.flatnonzero(np.where(g == h, lone & (self.members[g] > 1), fits))
            g, h = g[keep], h[keep]
            weight = self.members[g] * self.members[h]
            for x, y in chunks(weight, most):
                yield self._members(g[x:y], h[x:y], weight[x:y], t)

    def _members(self, g: np.ndarray, h: np.ndarray, weight: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.repeat(np.arange(len(g)), weight)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(weight) - weight, weight)
        each = self.members[h][own]
        i, j = self.first[g][own] + nth // each, self.first[h][own] + nth % each
        ok = ((i < j) | (g != h)[own]) & (self.part[i] != self.part[j]) & ((self.side[i] < 0) | (self.side[i] != self.side[j]))
        return admitted(self.cells, self.n, i[ok], j[ok], t)


def proposals(i: np.ndarray, j: np.ndarray, apart: np.ndarray, part: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the pairs to verify: all if ``most`` is 0, a forest over the parts if it is 1, else up to ``most`` for each
    member and other part."""
    if most == 0:
        return np.arange(len(i))
    if most == 1:
        return forest(len(part), i, j, apart, part)
    who, other, of = np.concatenate([i, j]), np.concatenate([part[j], part[i]]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((apart[of], other, who))
    start = np.ones(len(order), bool)
    start[1:] = (who[order][1:] != who[order][:-1]) | (other[order][1:] != other[order][:-1])
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return np.unique(of[order[nth < most]])


def whole_blocks(batches: Iterator[pa.RecordBatch], least: int = 1024) -> Iterator[pa.Table]:
    """Tables of complete blocks from rows sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            if sum(x.num_rows for x in held) < least:
                continue
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        cut = rows.num_rows
        if batch is not None:  # the last block may go on
            name = np.stack([rows.column(c).to_numpy() for c in ("bucket", "lo", "hi")], 1)
            other = np.flatnonzero((name != name[-1]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0
        held = rows.slice(cut).combine_chunks().to_batches()
        if cut:
            yield from _pieces(rows.slice(0, cut), least)


def _pieces(rows: pa.Table, least: int) -> Iterator[pa.Table]:
    """Tables of some ``least`` rows that end where blocks end."""
    name = np.stack([rows.column(c).to_numpy() for c in ("bucket", "lo", "hi")], 1)
    ends = np.append(np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1, len(name))
    at = 0
    while at < len(name):
        end = int(ends[min(np.searchsorted(ends, at + least), len(ends) - 1)])
        yield rows.slice(at, end - at).combine_chunks()
        at = end


def blocks(rows: DataFrame, counts: DataFrame, giants: DataFrame | None = None) -> DataFrame:
    """``rows(bucket, key, gid, pos, part)`` with the block pair ``lo, hi`` and ``side``: -1, or 0 and 1 for the blocks of a pair.

    A bucket of up to ``BLOCK`` rows, by the written ``counts(bucket, n)``, is one block, number -1. Larger ones are dealt into
    blocks by a hash, each by itself. With ``giants(bucket, part, n)``, blocks meet pairwise, but those of one part alone do
    not: the parts that ``giants`` lists with over ``BLOCK`` rows get blocks of their own.
    """
    plain = rows.withColumns({"lo": F.lit(-1).cast("long"), "hi": F.lit(-1).cast("long"), "side": F.lit(-1)})
    cut = counts.filter(F.col("n") > BLOCK)
    if cut.isEmpty():
        return plain
    deal = lambda by, n: F.pmod(F.xxhash64(by, F.lit(11)), F.ceil(n / BLOCK))
    if giants is None:
        sized = hot_join(rows, small(cut), "bucket", cut, "left")
        return sized.withColumn("lo", F.coalesce(deal("key", F.col("n")), F.lit(-1))).withColumns({"hi": F.col("lo"), "side": F.lit(-1)}).drop("n")
    names = small(cut.select("bucket"))
    plain, large = plain.join(names, "bucket", "left_anti"), hot_join(rows.join(names, "bucket", "left_semi"), cut, "bucket", cut)
    giants = small(written(giants.filter(F.col("n") > BLOCK).select("bucket", "part", F.col("n").alias("own")), "giants"))
    block = F.when(F.col("own").isNull(), deal("part", F.col("n"))).otherwise(F.xxhash64("part", deal("key", F.col("own"))))
    large = written(large.join(giants, ["bucket", "part"], "left").withColumn("block", block).drop("n", "own"), "dealt")
    of = written(large.groupBy("bucket", "block").agg(F.min("part").alias("low"), F.max("part").alias("high")), "dealt-blocks")
    p, q = (of.select("bucket", *[F.col(c).alias(c + k) for c in ("block", "low", "high")]) for k in "01")
    mixed = (F.col("low0") < F.col("high0")) | (F.col("low1") < F.col("high1")) | (F.col("low0") != F.col("low1"))
    met = p.join(q, "bucket").filter((F.col("block0") <= F.col("block1")) & mixed).select("bucket", F.col("block0").alias("lo"), F.col("block1").alias("hi"))
    one = met.select("bucket", F.col("lo").alias("block"), "lo", "hi", F.when(F.col("lo") == F.col("hi"), -1).otherwise(0).alias("side"))
    two = met.filter("lo < hi").select("bucket", F.col("hi").alias("block"), "lo", "hi", F.lit(1).alias("side"))
    return plain.unionByName(large.join(one.unionByName(two), ["bucket", "block"]).drop("block"))


def verified(asked: DataFrame, texts: DataFrame, width: int, t: Fraction) -> DataFrame:
    """``a, b, ok`` of the distinct pairs ``asked(a, b)``, compared on whole sets. Texts travel, as they pack better than sets; a
    key with very many pairs is spread."""
    a, b = t.numerator, t.denominator

    def sets(text: pa.Array, sig: pa.Array) -> list[np.ndarray | None]:
        h, row = shingles(*text_bytes(text), width)
        n = np.bincount(row, minlength=len(text))
        mixed, out = mix64(h), []
        for at, m, s in zip((np.cumsum(n) - n).tolist(), n.tolist(), sig.to_pylist()):
            mine = h[at : at + m]
            out.append(mine if m and signature(mine, mixed[at : at + m]) == s else None)  # None: another text with this hash
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for whole in batches:
            for batch in slices(whole, "y", 1 << 19):
                ok, keep = [], []
                for k, (p, q) in enumerate(zip(sets(batch.column(3), batch.column(2)), sets(batch.column(5), batch.column(4)))):
                    if p is not None and q is not None:
                        both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                        keep.append(k), ok.append(both * b >= a * (len(p) + len(q) - both))
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    one, two = (texts.select(F.col("key").alias(k), F.col("sig").alias(f"{v}_sig"), F.col("text").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    met = hot_join(hot_join(small(asked), one, "a"), two, "b", hot_keys(asked, "b")).select("a", "b", "x_sig", "x", "y_sig", "y")
    with runtime_filter(asked.sparkSession):  # later rounds ask few of the texts
        return written(met.mapInArrow(verify, "a long, b long, ok boolean"), "tested", 128)


def links(docs: DataFrame, buckets: DataFrame, classes: DataFrame, width: int, t: Fraction) -> DataFrame:
    """``key, component``: parts that the links between classes make, for every class with a link.

    Rounds verify a few pairs each, closest first, and only between parts not yet linked: each class with the closest of its
    block; then, where buckets are large, one member for each part; then forests over whole buckets; then more pairs for
    each member; and last every admitted pair that is left, so that no link between different parts is missed. Blocks with
    few admitted pairs have all of them verified at once; only buckets with other blocks go on to the next round.
    """
    told = classes.select("key", "n", "cells")

    def by_block(dealt: DataFrame) -> DataFrame:
        full = dealt.join(told, "key").select("bucket", "lo", "hi", "side", "key", "gid", "pos", "part", "n", "cells")
        return full.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "gid", "key")

    def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for table in whole_blocks(batches):
            rows = Rows(table)
            none = np.iinfo(np.int64).max
            best = np.full(len(rows.key), none)
            for i, j, apart in rows.pairs(t):  # distance and place in one number
                np.minimum.at(best, i, apart << 20 | j)
                np.minimum.at(best, j, apart << 20 | i)
            has = best < none
            mate = np.where(has, rows.key[np.where(has, best & ((1 << 20) - 1), 0)], -1)
            keep = np.flatnonzero(has | (table.column("lo").to_numpy() >= 0))  # in other blocks of the bucket a pair may wait
            kept = table.select(["bucket", "key", "gid", "pos"]).take(pa.array(keep)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in kept.columns), pa.array(mate[keep]), pa.array(np.where(has, best >> 20, -1)[keep])], ["bucket", "key", "gid", "pos", "mate", "apart"])

    counts = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "large")
    every = by_block(blocks(buckets.withColumn("part", F.col("key")), counts)).mapInArrow(mates, "bucket long, key long, gid long, pos int, mate long, apart long")
    every = written(every, "mates", 1024)  # members that some pair admits, with the closest, and all of large buckets
    release(docs.sparkSession)
    wanted = written(classes.select("key", "n", "sig", "at", "cells").join(every.select("key").distinct(), "key"), "wanted")
    texts, told = texts_of(docs, wanted.select("key", "sig", "at")), wanted.select("key", "n", "cells")
    closest = every.filter("mate >= 0").groupBy("key").agg(F.min(F.struct("apart", "mate")).alias("m")).select("key", F.col("m.mate").alias("mate"))
    asked = written(closest.select(F.least("key", "mate").alias("a"), F.greatest("key", "mate").alias("b")).distinct(), "asked")
    tested = verified(asked, texts, width, t)
    refused, label = tested.filter("not ok").select("a", "b"), components(tested.filter("ok").select("a", "b"))
    def proposed(dealt: DataFrame, most: int) -> DataFrame:
        """Pairs not yet refused, and a row ``a = -1, b = bucket`` for each bucket with a block that has more to propose."""

        def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()
            for table in whole_blocks(batches):
                own = Rows(table)
                held, size = [], 0
                for pairs in own.pairs(t) if most else ():
                    held.append(pairs)
                    size += len(pairs[0])
                few = size <= 4 * len(own.key)
                for i, j, apart in [tuple(np.concatenate(x) for x in zip(*held))] if held else own.pairs(t) if not most else ():
                    pick = proposals(i, j, apart, own.part, 0 if few else most)
                    x, y = own.key[i[pick]], own.key[j[pick]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
                    if not few:
                        more = np.unique(table.column("bucket").to_numpy()[i])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(more), -1)), pa.array(more)], ["a", "b"])

        return written(by_block(dealt).mapInArrow(propose, "a long, b long").distinct().join(refused, ["a", "b"], "left_anti"), "asked", 1024)

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list]:
        """``rows`` with their parts, rows by bucket and part, buckets of several parts, and the largest of those."""
        named = written(rows.join(small(label), "key", "left").select("bucket", "key", "gid", "pos", F.coalesce("component", "key").alias("part")), "named")
        by_part = named.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
        split = written(by_part.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1"), "split")
        return named.join(small(split.select("bucket")), "bucket", "left_semi"), by_part, split, split.agg(F.max("n"), F.max("parts")).first()

    def settle(asked: DataFrame) -> bool:
        """Verifies the pairs; whether some are links."""
        nonlocal refused, label
        if asked.isEmpty():
            return False
        tested = verified(asked, texts, width, t)
        refused = refused.unionByName(tested.filter("not ok").select("a", "b"))
        gained = tested.filter("ok").select("a", "b")
        if gained.isEmpty():
            return False
        label = components(gained, label)
        return True

    rows = every.select("bucket", "key", "gid", "pos")
    if not counts.isEmpty():
        large, step, fresh = written(rows.join(small(counts.select("bucket")), "bucket", "left_semi"), "large-rows"), 0, True
        while True:  # one member stands for each part, another one each time
            named, _, split, (_, parts) = parted(large)
            if parts is None or step and (parts <= BLOCK or not fresh):
                break
            step += 1
            pick = named.groupBy("bucket", "part").agg(F.min(F.struct(F.xxhash64("key", F.lit(step)).alias("by"), "key", "gid", "pos")).alias("m"))
            asked = proposed(blocks(pick.select("bucket", "m.key", "m.gid", "m.pos", "part"), split.select("bucket", F.col("parts").alias("n"))), 1)
            fresh = settle(asked.filter("a >= 0"))
    for most in (1, 1, 8, 0):
        named, by_part, split, (_, parts) = parted(rows)
        if parts is None:
            break
        asked = proposed(blocks(named, split.select("bucket", "n"), by_part), most)
        settle(asked.filter("a >= 0"))
        release(docs.sparkSession)
        more = asked.filter("a < 0").select(F.col("b").alias("bucket"))
        if most == 0 or more.isEmpty():
            break
        rows = named.drop("part").join(small(more), "bucket", "left_semi")  # other buckets have nothing left to verify
    return label


def components(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``key, component`` for every key in ``edges(a, b)`` and, if given, the components ``before``: the smallest key of its
    connected part.

    Rounds of hooking to the smallest neighbour and shortening (keys to their root's root) over written tables;
    the number of rounds grows with the logarithm of the longest path.
    """
    if before is not None:
        edges = edges.unionByName(before.select(F.col("component").alias("a"), F.col("key").alias("b")))
    pairs = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    label = written(pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "key"), "labels")
    while True:
        mine = small(label.select(F.col("key").alias("a"), F.col("l").alias("la")))
        yours = small(label.select(F.col("key").alias("b"), F.col("l").alias("lb")))
        cross = pairs.join(mine, "a").join(yours, "b").filter("la <> lb")
        hooks = written(cross.groupBy(F.col("la").alias("root")).agg(F.min("lb").alias("to")).filter("to < root"), "hooks")
        if hooks.isEmpty():
            return label.withColumnRenamed("l", "component")
        jumped = label.join(small(hooks).withColumnsRenamed({"root": "l"}), "l", "left").select("key", F.coalesce("to", "l").alias("l"))
        up = written(jumped, "jumped")
        over = small(up.select(F.col("key").alias("l"), F.col("l").alias("top")))
        label = written(up.join(over, "l", "left").select("key", F.least(F.col("l"), F.coalesce("top", "l")).alias("l")), "labels")


def linked_sets(df: DataFrame, key: str, text: str, width: int, threshold: Fraction) -> DataFrame:
    """``key, at, n, component, least`` and ``first`` for every row: its part of the links, that part's smallest key, and
    whether the row has the set and key that stand for the part.

    The work is on distinct sets under numbers of their own, so rows that share a key or have none are compared as others
    are. ``at`` is a hash of key and text, by which a set's document is found again. Empty sets have a null component.
    """
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("at", F.xxhash64("key", "text"))
    feats = features(docs, width, threshold, frequencies(docs, "text", width))
    of_sets = feats.filter("n > 0").groupBy("sig").agg(F.min("key").alias("least"), F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("shape", "n", "cells", "prefix")])
    of_sets = written(of_sets.withColumn("key", F.monotonically_increasing_id()), "classes")  # numbers are fixed by writing
    light = written(feats.select("key", "at", "n", "sig"), "rows")
    discard(feats)
    release(df.sparkSession)
    feats, classes = light, of_sets.drop("least")
    whole = links(docs, group_buckets(classes, threshold), classes, width, threshold)
    of = of_sets.join(whole, "key", "left").select("sig", F.coalesce("component", "key").alias("component"), F.col("least").alias("own"))
    best = of.groupBy("component").agg(F.min("own").alias("least"), F.min(F.struct(F.col("own").isNull(), "own", "sig")).alias("best"))
    of = of.join(best, "component").select("sig", "component", "least", (F.col("best.sig") == F.col("sig")).alias("first"))
    named = feats.select("key", "at", "n", "sig").join(of, "sig", "left")
    return named.select("key", "at", "n", "component", "least", (F.coalesce("first", F.lit(True)) & (F.col("component").isNull() | F.col("key").eqNullSafe(F.col("least")))).alias("first"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """``key, n_shingles, component_id`` for every row: set size and the smallest key reachable by links.

    Sets hold the distinct ``width``-word shingles of the whole lower-cased text; a text with fewer words is one shingle.
    Null and blank texts have empty sets and link with nothing. Repeated rows and equal texts are one class;
    texts that share a key are compared each by itself, and those without one too, though their component is shown as null
    (``linked_sets`` has it). An empty table gives
    an empty result; other columns are not read.
    """
    named = linked_sets(df, key, text, width, threshold)
    return named.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("least")).otherwise(F.col("key")).alias("component_id"))
