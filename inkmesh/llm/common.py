"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Freed memory goes back to the system at once: workers of Python live long and share an executor's bound.
pa.set_memory_pool(pa.system_memory_pool())

_own: dict[str, str] = {}

#: What the encoders' tasks keep in a Python worker for each other, by kind and path.
_held: dict[str, dict] = {}


def held(kind: str) -> dict:
    """The table in which tasks of this Python worker keep what is dear to make, until ``give_back``."""
    return _held.setdefault(kind, {})


def give_back() -> None:
    """Frees what encoders' tasks left in this Python worker, for the tasks of other operators: workers outlive queries, and
    vocabularies and caches of a query that is over would count with all that come after it."""
    if any(_held.values()):
        for kind in _held.values():
            kind.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share.

    Only where the session names no such folder (tests on one machine) one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _own[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


@contextmanager
def batch_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for jobs run inside, where rows can be long: batches are whole in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows is not None:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def runtime_filter(spark: SparkSession) -> Iterator[None]:
    """Lets Spark filter the larger side of a shuffled join by a Bloom filter of the smaller one's keys in jobs run inside; as it comes,
    Spark does so only where the larger side's scan has 10 GB and the smaller one at most 10 MB."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {prefix + "enabled": "true", prefix + "applicationSideScanSizeThreshold": "0", prefix + "creationSideThreshold": "256MB"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts the lineage; ``rows`` as in ``batch_rows``."""
    path = scratch(df.sparkSession, tag)
    with batch_rows(df.sparkSession, rows):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables from the shared folder; nothing lazy may still read them."""
    for df in tables:
        remove(_paths[df])


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that nothing refers to; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(name: str) -> None:
    """Removes a folder of the shared folder."""
    store, path = fs.FileSystem.from_uri(name)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def broadcast_limit(spark: SparkSession, most: int = 4 << 20) -> int:
    """Bytes a broadcast may have: the session's own bound for joins, ``most`` at the highest."""
    return min(most, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def small(df: DataFrame) -> DataFrame:
    """Marks a written table for broadcast if its values fit ``broadcast_limit``; a larger one is left to a shuffled join."""
    fixed = {"bigint": 8, "int": 4, "boolean": 1}
    size = F.lit(sum(fixed.get(t, 0) for _, t in df.dtypes)).cast("long")
    for c, t in df.dtypes:
        if t not in fixed:
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= broadcast_limit(df.sparkSession) else df


#: Rows of one key in a join above which they are spread over several tasks.
HOT = 1 << 14


def hot_keys(rows: DataFrame, on: str | list[str]) -> DataFrame:
    """The keys with more than ``HOT`` rows, and their number ``n``; counted with partial sums."""
    return rows.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)


def hot_join(left: DataFrame, right: DataFrame, on: str | list[str], hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` (inner or left) where ``left`` may have very many rows of a key and ``right`` few.

    A hot key's rows of ``left`` are dealt over one task for each ``HOT`` rows, to each of which the key's rows of ``right``
    go. ``hot`` has the keys and ``n`` if they are known.
    """
    keys = [on] if isinstance(on, str) else on
    counted = (hot_keys(left, keys) if hot is None else hot).filter(F.col("n") > HOT)
    cuts = written(counted.select(*keys, F.ceil(F.col("n") / HOT).cast("int").alias("_cuts")), "hot")
    if cuts.isEmpty():
        return left.join(right, keys, how)
    cuts = small(cuts)
    by = [c for c, t in left.dtypes if c not in keys and t in ("bigint", "int", "string")]
    dealt = left.join(cuts, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_cuts", F.lit(1))).cast("int")).drop("_cuts")
    copied = right.join(cuts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1))).drop("_cuts")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one array, and row offsets into it (nulls are empty)."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: ASCII white space, and A-Z to a-z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


#: What a byte adds to its word's hash: its lower case plus 1; white space adds nothing.
_VALUE = np.where(SPACE, 0, LOWER.astype(np.uint64) + 1).astype(np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_weights = mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _weight_table(n: int) -> np.ndarray:
    """Weights of the places in a word; those of very long words are not kept."""
    if n <= len(_weights):
        return _weights
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all rows, and each word's row.

    A word is a run of bytes that are not ASCII white space; rows end words. The hash is
    multilinear over the bytes, mixed with the length, so it depends on the word alone.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[cut] = solid[cut]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data, solid, rel = data[starts[0] :], solid[starts[0] :], starts - starts[0]
    kind = np.int32 if len(data) < 2**31 else np.int64
    place = np.arange(len(data), dtype=kind)
    place -= np.repeat(rel.astype(kind), np.diff(np.append(rel, len(data))))
    place *= solid
    terms = np.take(_weight_table(int(place.max()) + 1), place)
    terms *= _VALUE[data]
    length = np.add.reduceat(solid, rel, dtype=np.int32).astype(np.uint64)
    hashed = mix64(np.add.reduceat(terms, rel) ^ (length * np.uint64(0xD6E8FEB86659FD93)))
    return hashed, np.searchsorted(offsets, starts, "right") - 1
