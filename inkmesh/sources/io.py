"""Sources and sinks S1 to S7: logs, queues, inventories, snapshots, status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def client_ip(forwarded: Column, real: Column, socket: Column) -> Column:
    """The first address that is not empty, else ``unknown``."""
    some = [F.nullif(c, F.lit("")) for c in (forwarded, real, socket)]
    return F.coalesce(*some, F.lit("unknown"))


def conn_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.CONN_LOG).format(fmt).load(path)


def conn_log_stream(spark: SparkSession, path: str, fmt: str = "parquet", files: int = 64) -> DataFrame:
    """The same rows as a stream, with ``ts`` as an instant so that it can carry a watermark."""
    rows = spark.readStream.schema(schemas.CONN_LOG).option("maxFilesPerTrigger", files).format(fmt).load(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def read_queue(df: DataFrame, queue: str = "queue") -> DataFrame:
    """One row per queued operation of a JSON array; unreadable JSON is an empty queue."""
    parsed = F.from_json(queue, schemas.QUEUE, {"mode": "PERMISSIVE"})
    rest = [c for c in df.columns if c != queue]
    return df.select(*rest, F.inline(parsed))


def write_queue(ops: DataFrame, *keys: str) -> DataFrame:
    """The pending operations of each key as one JSON array in order; a queue is one client's and stays small."""
    op = F.struct("seq", "id", "type", "path", F.col("new_path").alias("newPath"), "content", F.col("user_id").alias("userId"))
    return ops.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(op))).alias("queue"))


def inventory(files: DataFrame) -> DataFrame:
    """The distinct files of each replica; folders are told apart by a flag."""
    flagged = files if "is_folder" in files.columns else files.withColumn("is_folder", F.lit(False))
    return flagged.select("vault_id", "replica", "path", "is_folder").distinct()


def tree_inventory(spark: SparkSession, root: str, vault_id: str, replica: str) -> DataFrame:
    """The inventory of a directory tree, from file listings without contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    local = F.regexp_replace("path", "^[a-z]+:/*", "/")
    own = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(root.rstrip('/')) + 2})")
    return found.filter(F.startswith(local, F.lit(root.rstrip("/") + "/"))).select(F.lit(vault_id).alias("vault_id"), F.lit(replica).alias("replica"), own.alias("path"), F.lit(False).alias("is_folder"))


def document_key(df: DataFrame) -> DataFrame:
    return df.withColumn("document", F.concat_ws("/", "vault_id", "path"))


def request_params(df: DataFrame, url: str) -> DataFrame:
    """``vaultId``, ``userId`` and ``token`` of request urls; the token is kept up to its maximum size, trimmed."""
    param = lambda name: F.try_url_decode(F.regexp_replace(F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit(name)), r"\+", "%20"))
    token = param("token")
    return df.withColumns({"vault_id": param("vaultId"), "user_id": param("userId"), "token": F.when(F.length(token) <= schemas.MAX_TOKEN, F.trim(token))})
