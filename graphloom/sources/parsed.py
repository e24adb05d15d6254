"""Facts of files kept by the hash of their content: what was parsed once is read, and only new contents are parsed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def facts(sources: DataFrame, parse: Callable[[DataFrame], DataFrame], cache: str | None = None) -> DataFrame:
    """parse(sources), written; with a cache, a path for this parser alone, files whose path and content it has are not parsed.

    sources: file_path (a key), content; parse gives rows with file_path that depend on that
    file only.  What is parsed is added in a batch: its facts first and then its files,
    and facts count with files of their batch only, so a run that was cut off leaves
    nothing behind that is read.
    """
    if cache is None:
        return cut(parse(sources))
    spark = sources.sparkSession
    told = sources.select("file_path", "content", F.sha2(F.encode(F.coalesce("content", F.lit("")), "UTF-8"), 256).alias("hash"))
    now = cut(told.select("file_path", "hash"))
    try:
        files = spark.read.parquet(f"{cache}/files")
        fresh = told.join(files, ["file_path", "hash"], "left_anti")
    except AnalysisException:  # nothing is kept yet
        files, fresh = None, told
    fresh = cut(fresh)
    if not fresh.isEmpty() or files is None:
        batch = F.lit(uuid.uuid4().hex).alias("batch")
        made = parse(fresh.select("file_path", "content"))
        made.join(fresh.select("file_path", "hash"), "file_path").select("*", batch).write.mode("append").parquet(f"{cache}/facts")
        fresh.select("file_path", "hash", batch).write.mode("append").parquet(f"{cache}/files")
    files = spark.read.parquet(f"{cache}/files").join(now, ["file_path", "hash"], "left_semi")
    return cut(spark.read.parquet(f"{cache}/facts").join(files, ["file_path", "hash", "batch"], "left_semi").drop("hash", "batch"))
