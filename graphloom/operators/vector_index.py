"""A kept index of vectors in cells, which answers a probe exactly from the cells that can matter.

build() fits centres on a bounded sample and deals every vector to its nearest centre; a
cell keeps the least and the greatest angle of its vectors to the centre.  Angles between
directions obey the triangle inequality, so a vector at angle a from a centre and a probe
at angle p from it are at least |p - a| apart: that bounds the cosine of all of a cell, and
of all of a row group, since a cell's files are sorted by angle.  A search scores the cells
of the greatest bounds until they hold k vectors; the k-th score then excludes every
further cell, and angles within the others, whose bound is below it.

Results are those of text.cosine_top over the live vectors.  Vectors that are null, empty
or zero, hold null or non-finite components, have no finite sum of squares, or have
another length than the index are not held.  Where vectors spread evenly over many dimensions the bounds exclude little and
a search reads most cells; it stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, small
from .text import cosine

#: Components of the sample that centres are fitted on, and of all centres, at most; centres at most; k-means rounds.
SAMPLE_COMPONENTS, CENTRE_COMPONENTS, MOST_CELLS, ROUNDS = 4 << 20, 1 << 20, 1024, 8
#: What angles computed in doubles may be off by; acos is ill-conditioned near 0.
SLACK = 1e-6

_VECTORS = "vec_id long, embedding array<double>, angle double, segment int, cell int"
_CELLS = "cell int, n long, least double, most double, segment int"
_CENTRES = "cell int, centre array<double>"
_DEAD = "vec_id long, segment int"


def _read(spark: SparkSession, path: str, what: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{path}/{what}")
    except AnalysisException:  # nothing of it was written
        return spark.createDataFrame([], schema)


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of doubles, without the rows that have no direction."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)  # null, NaN or infinite if a component is
    return rows.where(F.col("vec_id").isNotNull() & (squares > 0) & (squares < float("inf")))


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very large components would overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most `cells` different directions, by k-means on the sphere; begins with far-apart rows, empty cells go."""
    units = _units(sample)
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < cells and nearest.min() < 1 - 1e-12:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    centres = units[chosen]
    for _ in range(rounds):
        of = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        kept = np.abs(sums).max(axis=1) > 1e-9
        centres = _units(sums[kept])
    return centres


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cosines = _units(np.vstack(b["embedding"].to_numpy()).astype(float)) @ centres.T
                cell = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(b)), cell], -1, 1))
                yield b.assign(cell=cell.astype("int32"), angle=angle)

    return vectors.where(F.size("embedding") == centres.shape[1]).mapInPandas(deal, "vec_id long, embedding array<double>, cell int, angle double")


def build(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Start an index of vectors (vec_id, a key, and embedding) in path, which is new.

    The length of most vectors is the index's.  cells: about the root of their number unless given.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors)
    usual = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if usual is None:
        return
    dim, n = usual
    sample = rows.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, SAMPLE_COMPONENTS // dim)).select("embedding").toPandas()  # bounded
    most = max(1, min(MOST_CELLS, CENTRE_COMPONENTS // dim))
    centres = fit_centres(np.vstack(sample["embedding"].to_numpy()).astype(float), min(most, cells or max(1, round(n**0.5))))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], _CENTRES).coalesce(1).write.parquet(f"{path}/centres")
    _write(rows, path, centres, 0)


def add(vectors: DataFrame, path: str) -> None:
    """A segment of further vectors; those of an id that the index has replace it.  What is written follows vectors."""
    spark = vectors.sparkSession
    centres = _centres(spark, path)
    if centres is None:
        return build(vectors, path)
    given = cut(vectors.select("vec_id", "embedding"))
    number = 1 + _read(spark, path, "cells", _CELLS).agg(F.coalesce(F.max("segment"), F.lit(0))).first()[0]
    remove(given, path)
    _write(_usable(given), path, centres, number)


def remove(ids: DataFrame, path: str) -> None:
    """Vectors with these ids (vec_id) are no longer found."""
    spark = ids.sparkSession
    held = _read(spark, path, "vectors", _VECTORS).select("vec_id", "segment").join(_read(spark, path, "dead", _DEAD), ["vec_id", "segment"], "left_anti")
    cut(held.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")).write.mode("append").parquet(f"{path}/dead")


def _centres(spark: SparkSession, path: str) -> np.ndarray | None:
    rows = _read(spark, path, "centres", _CENTRES).orderBy("cell").collect()  # at most CENTRE_COMPONENTS numbers
    return np.array([r["centre"] for r in rows]) if rows else None


def _write(rows: DataFrame, path: str, centres: np.ndarray, segment: int) -> None:
    dealt = cut(_assigned(rows, centres))
    # by range of angle and id within a cell too, so that a cell of many vectors, or of many copies of one, is many tasks' work
    laid = dealt.repartitionByRange("cell", "angle", "vec_id").sortWithinPartitions("cell", "angle", "vec_id")
    laid.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment", "cell").parquet(f"{path}/vectors")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    cells.withColumn("segment", F.lit(segment)).coalesce(1).write.mode("append").parquet(f"{path}/cells")


def bounds(spark: SparkSession, path: str, probe: list[float]) -> pd.DataFrame:
    """segment, cell, n, p (angle of probe to the cell's centre), gap (no vector of the cell is nearer than this angle), least gap first."""
    centres = _centres(spark, path)
    cells = _read(spark, path, "cells", _CELLS).toPandas()  # a row for each cell and segment
    if centres is None or cells.empty:
        return cells.assign(p=0.0, gap=0.0)
    to_centre = np.arccos(np.clip(centres @ _units(np.array([probe], dtype=float))[0], -1, 1))
    p = to_centre[cells["cell"].to_numpy()]
    gap = np.maximum(0, np.maximum(p - cells["most"], cells["least"] - p) - SLACK)
    return cells.assign(p=p, gap=gap).sort_values(["gap", "segment", "cell"], kind="stable").reset_index(drop=True)


def _of(vectors: DataFrame, cells: pd.DataFrame, within: float | None = None) -> DataFrame:
    """The vectors of these cells; within: only those whose angle to the centre lets them be that near to the probe."""
    wanted = F.lit(False)
    for segment, some in cells.groupby("segment"):
        wanted = wanted | ((F.col("segment") == int(segment)) & F.col("cell").isin([int(c) for c in some["cell"]]))
    kept = vectors.where(wanted)
    if within is not None:
        p = vectors.sparkSession.createDataFrame([(int(c), float(a)) for c, a in sorted(set(zip(cells["cell"], cells["p"])))], "cell int, p double")
        reach = within + 2 * SLACK
        # the whole range first, which row groups are skipped by, then each cell's own
        kept = kept.where(F.col("angle").between(float(cells["p"].min()) - reach, float(cells["p"].max()) + reach))
        kept = kept.join(F.broadcast(p), "cell").where(F.abs(F.col("angle") - F.col("p")) <= reach)  # at most MOST_CELLS rows
    return kept


def search(spark: SparkSession, path: str, probe: list[float], k: int = 10) -> DataFrame:
    """vec_id, score of the k live vectors nearest to probe by cosine, ties to the lesser id; none for a probe without direction or of another length."""
    nothing = spark.createDataFrame([], "vec_id long, score double")
    probe = [float(x) for x in probe]
    centres = _centres(spark, path)
    if centres is None or len(probe) != centres.shape[1] or not 0 < sum(x * x for x in probe) < float("inf") or k < 1:
        return nothing
    cells = bounds(spark, path, probe)
    dead = cut(_read(spark, path, "dead", _DEAD))
    n_dead = dead.count()
    vectors = _read(spark, path, "vectors", _VECTORS)

    def best(rows: DataFrame) -> DataFrame:
        if n_dead:
            rows = rows.join(small(dead, n_dead, 16), ["vec_id", "segment"], "left_anti")
        return rows.select("vec_id", cosine(F.col("embedding"), probe).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)

    enough = int(np.searchsorted(cells["n"].cumsum().to_numpy(), k)) + 1
    top = cut(best(_of(vectors, cells[:enough])))
    found = top.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    rest, within = cells[enough:], None
    if found["n"] == k:
        within = float(np.arccos(np.clip(found["least"] - 1e-12, -1, 1)))
        rest = rest[rest["gap"] <= within + SLACK]
    if rest.empty:
        return top.orderBy(F.desc("score"), "vec_id")
    return top.unionByName(best(_of(vectors, rest, within))).orderBy(F.desc("score"), "vec_id").limit(k)
