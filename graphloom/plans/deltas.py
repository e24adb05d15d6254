"""A table that is kept up to date in batches, each of which writes no more than itself.

A batch becomes a folder of its own, named by its number; writing it again replaces it.
Every FAN folders of one size become one of the next size, so a row is rewritten as often
as the number of batches has digits to that base.  A read takes the largest whole folders
that cover all batches, and combines their rows.  Folders that a larger one covers are
deleted one merge later, when readers of the older state are done.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders of one size that are merged.
FAN = 8


class Deltas:
    """combine gives one row for each key from rows of several batches; combining combined rows must change nothing."""

    def __init__(self, spark: SparkSession, path: str, combine: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.combine = spark, path.rstrip("/"), combine

    def write(self, batch: DataFrame, number: int) -> None:
        """Batch number (from 0, in order; again if it was cut off)."""
        if not any(a <= number <= b and a < b for a, b in self._whole()):  # else it is merged already
            self._put(self.combine(batch), number, number)
        size = FAN
        while (number + 1) % size == 0:
            low, whole = number + 1 - size, self._whole()
            parts = self._cover([(a, b) for a, b in whole if b <= number and b - a + 1 < size], low)
            if (low, number) not in whole and parts and parts[-1][1] == number:
                self._put(self.combine(self._rows(parts)), low, number)
            for a, b in whole:  # what the parts were made of
                if any(c <= a and b <= d and d - c > b - a for c, d in parts):
                    self._delete(f"{self.path}/{a}-{b}")
            size *= FAN

    def read(self) -> DataFrame | None:
        """The table as of all whole batches; None before the first."""
        cover = self._cover(self._whole(), 0)
        return self.combine(self._rows(cover)) if cover else None

    @staticmethod
    def _cover(whole: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
        """The largest folders one after the other from batch `at`."""
        cover = []
        while ends := [b for a, b in whole if a == at]:
            cover.append((at, max(ends)))
            at = max(ends) + 1
        return cover

    def _rows(self, parts: list[tuple[int, int]]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{a}-{b}") for a, b in parts])

    def _put(self, rows: DataFrame, low: int, high: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{low}-{high}")

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _whole(self) -> list[tuple[int, int]]:
        """First and last batch of each folder that was written to its end."""
        path, files = self._folder(self.path)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(tuple(map(int, n.split("-"))) for n in names if files.exists(self._folder(f"{self.path}/{n}/_SUCCESS")[0]))

    def _delete(self, name: str) -> None:
        path, files = self._folder(name)
        files.delete(path, True)


def last_wins(key: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """combine for upserts: of the rows of one key the greatest by order stays."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return lambda rows: rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
