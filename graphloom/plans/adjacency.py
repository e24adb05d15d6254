"""Edges written once for many rounds: bucketed by the node they leave, and sorted by it.

A round joins its frontier with them.  A small frontier is looked up: only the buckets of
its nodes are opened, and in them the row groups that can hold those nodes.  A large one is
dealt into the edges' buckets, or broadcast; the edges themselves never move again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import BROADCAST_BYTES, scratch

#: A frontier of no more nodes than this is looked up by its nodes, which pass through the driver.
FEW = 1000
PREFIX = "graphloom_adjacency_"


class Adjacency:
    """steps: a table with the column at, and what is found there; equal rows once."""

    def __init__(self, steps: DataFrame, buckets: int | None = None):
        spark = steps.sparkSession
        self.spark, self.columns = spark, [c for c in steps.columns if c != "at"]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"{PREFIX}{uuid.uuid4().hex}"
        # dealt once: equal rows meet where their bucket is written, and each task writes one file
        dealt = steps.repartition(self.buckets, "at").distinct()
        dealt.write.bucketBy(self.buckets, "at").sortBy("at").option("path", scratch(spark)).option("parquet.block.size", 8 << 20).format("parquet").saveAsTable(name)
        self.name = name
        self.table = spark.table(name)

    def around(self, frontier: DataFrame, n: int | None = None) -> DataFrame:
        """The columns of frontier (id, ...), which is a written table of n rows, with those of the steps from id."""
        n = frontier.count() if n is None else n
        if n <= FEW:
            ids = [r[0] for r in frontier.select("id").distinct().collect()]
            near = self.table.where(F.col("at").isin(ids)) if ids else self.table.limit(0)
            return near.join(F.broadcast(frontier), F.col("at") == F.col("id")).select(*frontier.columns, *self.columns)
        side = F.broadcast(frontier) if n * 64 <= BROADCAST_BYTES // 8 else frontier.hint("merge")
        return side.join(self.table, F.col("at") == F.col("id")).select(*frontier.columns, *self.columns)

    def drop(self) -> None:
        """Forget the table; lineage.cleanup() deletes its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
