"""Shared helpers: the shared work folder, written intermediate tables, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only below this many bytes, by a measured bound.
BROADCAST_BYTES = 32 << 20

#: White space as the contracts define it: space and U+0009 to U+000D.
WS = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (local mode only) a temporary one."""
    settle(spark)
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
        made = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def settle(spark: SparkSession) -> None:
    """Session settings that bound memory outside the heap, unless the session has its own.

    Vectored reads of Parquet go through native buffers as large as a chunk of text, which
    threads keep.  Batches for Python lie in native memory too, on both sides; 10,000 whole
    texts are too many.
    """
    for key, default, ours in (("parquet.hadoop.vectored.io.enabled", None, "false"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")):
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, ours)


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage: what follows survives lost executors without recomputing df,
    and values that depend on partition order are fixed from here on.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what stored() wrote for df; nothing may read it any more."""
    if name := getattr(df, "_stored_path", None):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def located(docs: DataFrame) -> DataFrame:
    """docs with __file and __row, which name a row alike in every read and on every executor.

    For rows, filters and projections of files these are the file (hashed) and the row's
    place in it.  Anything else is first written to the shared folder.  Row numbers that
    depend on partitions would change when executors are lost or won between two reads.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    spark = docs.sparkSession
    try:
        if node.nodeName() != "LogicalRelation":
            raise AnalysisException("not a table of files")
        place = docs.metadataColumn("_metadata")
        return docs.select("*", F.xxhash64(place["file_path"]).alias("__file"), place["row_index"].alias("__row"))
    except AnalysisException:
        path = work_path(spark, "located")
        docs.write.parquet(path)
        held = spark.read.schema(docs.schema).parquet(path)
        place = held.metadataColumn("_metadata")
        return held.select("*", F.xxhash64(place["file_path"]).alias("__file"), place["row_index"].alias("__row"))


def without(docs: DataFrame, dropped: DataFrame, n: int) -> DataFrame:
    """The rows of docs, which is located(), that are not among dropped (__file, __row; n rows), without the two columns."""
    kept = docs.join(small(dropped, n, 48), ["__file", "__row"], "left_anti")
    return kept.drop("__file", "__row")


#: A table of no more rows than this may pass through the driver, where a row is a few numbers and names.
FEW = 10_000


def fixed(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: kept in the plan itself if it has at most FEW rows, else written as stored() does.

    For tables that are small as a rule (a row for each source, or each frequent hash) but
    need not be; rows must be small.
    """
    rows = df.limit(FEW + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= FEW else stored(df, name)


def cleanup(spark: SparkSession) -> None:
    """Delete every written intermediate table of this module; results that still read them become invalid."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(batches):
    """batches, and when they end, what the Python worker has freed goes back to the machine: workers live on between tasks."""
    yield from batches
    release()


def release() -> None:
    """Give memory that Python has freed back to the machine."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its bound, rows times row_bytes, is under BROADCAST_BYTES; otherwise df, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % mod
