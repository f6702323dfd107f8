"""Operator 9: URL rules by a Bloom filter cascade.

Every key that the corpus can ask for is known: the suffixes of its hosts joined with the path
prefixes of the rules' lengths. Level 0 encodes the listed keys; level 1 those other keys of the
universe that level 0 lets through; level 2 the listed keys that level 1 lets through, and so on
until nothing passes wrongly. The level at which a key first fails then tells exactly whether it
is listed, for every key of the universe, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _extended, _kept
from .common import mix64, written


#: Levels after which a cascade gives up: each halves what passes wrongly.
LEVELS = 96


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # unsigned 64-bit words
    size: int
    hashes: int


def positions(level: int, size: int, hashes: int, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
    a = mix64(h1.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    b = mix64(h2.astype(np.uint64) ^ a) | np.uint64(1)
    for k in range(hashes):
        yield (a + np.uint64(k) * b) % np.uint64(size)


def passes(level: int, f: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h1), bool)
    for p in positions(level, f.size, f.hashes, h1, h2):
        ok &= (f.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    out, todo = np.zeros(len(h1), bool), np.arange(len(h1))
    for k, f in enumerate(levels):
        ok = passes(k, f, h1[todo], h2[todo])
        out[todo[~ok]] = k % 2 == 1
        todo = todo[ok]
    out[todo] = len(levels) % 2 == 1
    return out


def hashes(key: Column) -> tuple[Column, Column]:
    """Two hashes from different seeds: keys that share one do not therefore share the other."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _level(keys: DataFrame, number: int, n: int, rate: float, max_bits: int) -> Level:
    """A filter over ``keys(h1, h2)``, set by the executors; the driver gets its words, ``max_bits / 64`` at most."""
    size = max(64, -(-math.ceil(-n * math.log(rate) / math.log(2) ** 2) // 64) * 64)
    if size > max_bits:
        raise OverflowError(f"{n} keys need {size} bits; the bound is {max_bits}")
    count = max(1, round(-math.log2(rate)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for p in positions(number, size, count, batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        own = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(words[own].view(np.int64))], ["word", "bits"])

    words = np.zeros(size // 64, np.uint64)
    found = keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Level(words, size, count)


def cascade(universe: DataFrame, keys: DataFrame, rate: float = 0.01, max_bits: int = 1 << 27) -> list[Level]:
    """Levels that separate ``keys(key)`` from the rest of ``universe(key)``. Null keys are left out; repeats count once.

    ``OverflowError`` says that a level would exceed ``max_bits``, or that ``LEVELS`` levels leave keys that only their text tells
    apart; ``judge`` then joins instead. ``rate`` is the first level's; later levels take one half, as their sets are small.
    """
    every = universe.filter(F.col("key").isNotNull()).select("key").distinct()
    wanted = keys.filter(F.col("key").isNotNull()).select("key").distinct().withColumn("in", F.lit(True))
    h1, h2 = hashes(F.col("key"))
    both = written(every.join(wanted, "key", "left").select("key", h1.alias("h1"), h2.alias("h2"), F.coalesce("in", F.lit(False)).alias("in")), "universe")
    inside, outside, levels = both.filter("in"), both.filter(~F.col("in")), []
    while n := inside.count():
        number = len(levels)
        if number == LEVELS:
            raise OverflowError(f"{n} keys share both hashes with others")
        level = _level(inside, number, n, rate if number == 0 else 0.5, max_bits)
        levels.append(level)
        shared = universe.sparkSession.sparkContext.broadcast(level)

        def leak(batches: Iterator[pa.RecordBatch], number=number, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes(number, shared.value, batch.column(1).to_numpy(), batch.column(2).to_numpy())))

        through = written(outside.select("key", "h1", "h2").mapInArrow(leak, "key string, h1 long, h2 long"), "leak")
        inside, outside = through, inside
    return levels


def mark(df: DataFrame, keys: str, levels: list[Level], out: str) -> DataFrame:
    """Adds ``out``: for each element of the array column ``keys``, whether it is listed (null elements are not)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(levels)
    a, b = "_uf_1", "_uf_2"
    hashed = df.withColumn(a, F.transform(keys, lambda k: hashes(k)[0])).withColumn(b, F.transform(keys, lambda k: hashes(k)[1]))
    schema = _extended(df, [T.StructField(out, T.ArrayType(T.BooleanType()))])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, own = (batch.column(batch.schema.get_field_index(c)) for c in (a, b, keys))
            flags = listed(shared.value, first.flatten().to_numpy(zero_copy_only=False), second.flatten().to_numpy(zero_copy_only=False))
            flags &= own.flatten().is_valid().to_numpy(zero_copy_only=False)
            offsets = first.offsets.to_numpy()
            made = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flags), mask=first.is_null() if first.null_count else None)
            yield pa.RecordBatch.from_arrays(_kept(batch, schema, 1) + [made], names)

    return hashed.mapInArrow(run, schema)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for urls without ``://``."""
    part = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", max_bits: int = 1 << 27) -> DataFrame:
    """Adds ``host, path, rule, verdict``. ``rules``: (allow or block, host, path); the longest that fits wins.

    A rule fits its host, all subdomains, and paths that start with its path. Urls that no rule fits have a null rule
    and the verdict ``default``: the filter lists nothing of them. Null urls and urls without ``://`` have empty host
    and path. Columns with the added names are replaced; repeated rows give repeated results.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    taken = {"host", "path", "rule", "verdict"}
    rows = pages.select(*[c for c in pages.columns if c.lower() not in taken], host.alias("host"), path.alias("path"))
    if not rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    lengths = sorted({len(p) for _, _, p in rules})
    labels = F.split("host", r"\.")
    counts = sorted({h.count(".") + 1 for _, h, _ in rules})  # no other suffix can be a rule's host
    longest = F.filter(F.array(*[F.lit(n) for n in counts]), lambda n: n <= F.size(labels))
    suffixes = F.transform(longest, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.filter(F.array(*[F.when(F.length("path") >= n, F.concat(s, F.substring("path", 1, n))) for n in lengths]), lambda k: k.isNotNull())))
    rows = rows.withColumn("_uf_keys", candidates)
    universe = rows.select(F.explode("_uf_keys").alias("key"))
    verdicts = {}
    for verdict in ("allow", "block"):
        own = [(h.lower() + p,) for v, h, p in rules if v == verdict]
        keys = spark.createDataFrame(own, "key string")
        try:
            rows = mark(rows, "_uf_keys", cascade(universe, keys, max_bits=max_bits), f"_uf_{verdict}")
        except OverflowError:  # more listed keys than a filter may hold: the array is matched against a joined list
            hit = universe.distinct().join(keys.distinct(), "key").select(F.col("key").alias("_uf_hit"))
            rows = rows.withColumn("_uf_row", F.monotonically_increasing_id())
            found = written(rows, "urls")
            own_hits = found.select("_uf_row", F.explode("_uf_keys").alias("_uf_hit")).join(hit, "_uf_hit").groupBy("_uf_row").agg(F.collect_set("_uf_hit").alias("_uf_hits"))
            rows = found.join(own_hits, "_uf_row", "left").withColumn(f"_uf_{verdict}", F.transform("_uf_keys", lambda k: F.coalesce(F.array_contains("_uf_hits", k), F.lit(False)))).drop("_uf_row", "_uf_hits")
        verdicts[verdict] = f"_uf_{verdict}"
    fits = F.filter(F.arrays_zip("_uf_keys", *verdicts.values()), lambda x: x[verdicts["allow"]] | x[verdicts["block"]])
    best = F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["_uf_keys"]).alias("n"), x["_uf_keys"].alias("rule"), F.when(x[verdicts["allow"]], "allow").otherwise("block").alias("verdict"))))
    rows = rows.withColumn("_uf_best", best)
    return rows.select(*[c for c in rows.columns if not c.startswith("_uf_")], F.col("_uf_best.rule").alias("rule"), F.coalesce("_uf_best.verdict", F.lit(default)).alias("verdict"))
