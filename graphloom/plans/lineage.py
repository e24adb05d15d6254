"""Cutting lineage in loops, with written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes, by a counted bound.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where that is unset, a temporary folder."""
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
    return base


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else uses; cleanup() deletes it."""
    return f"{shared_dir(spark).rstrip('/')}/graphloom-cut/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder, without its plan.

    A written table has the size of its files.  A checkpoint would keep the estimate of
    its plan, and in a loop of joins estimates of estimates grow beyond any number.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what cut() wrote for df; nothing may read it any more."""
    if path := getattr(df, "_cut_path", None):
        _delete(df.sparkSession, path)


def cleanup(spark: SparkSession) -> None:
    """Delete everything that cut() has written; results that were not written elsewhere become invalid."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/graphloom-cut")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """df marked for broadcast if rows times row_bytes is bounded; else for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
