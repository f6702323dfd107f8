"""Running a stream over what is there now, and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closing(stream: DataFrame, at: int, **values: str) -> DataFrame:
    """``stream`` with a second source of one row: all null but ``ms`` and, if it is there, ``ts``, at ``at`` milliseconds, and ``values``.
    Its time moves the watermark past all other rows; it waits itself for ever. It comes with the first batch, so that the
    other source must have no limit for a batch: else rows of later ones are behind the watermark."""
    spark = stream.sparkSession
    folder = f"{scratch(spark, 'closing')}/rows"
    known = {"ms": F.lit(at), "ts": F.expr(f"timestampadd(MILLISECOND, {at}, timestamp_ntz'1970-01-01 00:00:00')")} | {k: F.lit(v) for k, v in values.items()}
    spark.range(1).select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def drained(stream: DataFrame, tag: str, mode: str = "append", each: Callable[[DataFrame, int, str], None] | None = None, again: Callable[[], None] | None = None, read: bool = True) -> DataFrame | None:
    """Runs ``stream`` until its present input is used up and returns the rows of its Parquet sink.

    ``each(batch, number, folder)`` replaces the sink for batches that are to be written otherwise, below ``folder``. With
    ``again``, the stream goes on after that call, from where it stood. Without ``read``, ``each`` knows how to read what it wrote.
    """
    spark = stream.sparkSession
    folder = scratch(spark, tag)
    out, key = f"{folder}/out", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        for more in (None, again) if again else (None,):
            if more:
                more()
            writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
            query = writer.foreachBatch(lambda df, n: each(df, n, out)).start() if each else writer.format("parquet").option("path", out).start()
            query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    if not read:
        return None
    return spark.read.schema(stream.schema).parquet(out) if each is None else spark.read.parquet(out)
