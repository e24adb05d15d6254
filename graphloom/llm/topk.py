"""Exact top-k search by inner product, with pivot-table elimination.

Whole vectors are first lifted by one coordinate to one common length, so that a larger
inner product is a smaller distance: |q - x|^2 = |q|^2 + M - 2 q.x for |x|^2 <= M.  A
table, written once, holds every vector's distance to each of PIVOTS pivots; by the
triangle inequality |d(q, p) - d(x, p)| is a lower bound of d(q, x) for every pivot p, and
the greatest of them bounds q.x from above.

The table is put in order of the nearest pivot and the distance to it and cut into blocks,
so that a block's distances lie in narrow ranges.  A query is first searched in its own
block; the k-th score found there is what any other candidate must reach.  Queries are
dealt in batches, in the same order.  A pair of a batch and a block whose ranges show that
no candidate can reach is dropped before any vector moves; in the others a query evaluates
candidates in the order of their bounds until none left can reach the k-th score.

Each task has a block and a batch and keeps at most k rows for each query.  Work grows with
queries times rows where bounds tell little (vectors spread evenly over many dimensions),
memory with a block and a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 20
SCALE = 64
PIVOTS = 24
#: Rows the pivots are chosen from, by hash of the id.
PIVOT_ROWS = 1024
#: Rows in a block of candidates, queries in a batch.
BLOCK, BATCH = 4096, 2048
#: Candidates a query evaluates first; each next step takes STEP_GROWTH times as many.
STEP, STEP_GROWTH = 512, 4


def whole(column: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x as double, as an array of long; null if any component is null or not finite, or none is there."""
    x = F.col(column)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(x.isNotNull() & (F.size(x) > 0) & ~odd, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def choose_pivots(rows: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Far-apart rows: each is the farthest from those before it."""
    if not len(rows):
        return rows
    chosen = [0]
    far = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(rows)):
        i = int(far.argmax())
        if far[i] == 0:
            break
        chosen.append(i)
        far = np.minimum(far, ((rows - rows[i]) ** 2).sum(axis=1))
    return rows[chosen]


def distances(x: np.ndarray, most: float, pivots: np.ndarray, query: bool = False) -> np.ndarray:
    """Distances to the pivots of vectors lifted to the squared length most; of queries, whose lifted coordinate is 0."""
    lift = lambda v: np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0.0))
    gap = (np.zeros(len(x)) if query else lift(x))[:, None] - lift(pivots)[None, :]
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T) + gap * gap
    return np.sqrt(np.maximum(square, 0.0))


def reach(q2, most: float, lower):
    """What q.x is at most for |q|^2 = q2 and a distance of at least lower; widened for rounding."""
    return (q2 + most - lower * lower) / 2 + 1e-9 * (q2 + most) + 1e-6


def slack(most: float) -> float:
    """How far a distance kept as a float, or a difference of two, may be from the true one: distances are at most twice the common length."""
    return 1e-6 * (2 * most**0.5 + 1)


def search_block(q_rid, q, dq, floor, x_rid, x_id, x, dx, most: float, k: int) -> tuple[list, int]:
    """(query, vector id, score) of the k best vectors of the block for each query, ties to the smaller id; and how many pairs were evaluated.

    floor: a score for each query that its k-th best is known to reach.  dx has a row for each pivot.
    """
    q2 = np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64))
    out, evaluated = [], 0
    off = slack(most)
    gap, lower = np.empty(dx.shape[1], dx.dtype), np.empty(dx.shape[1], dx.dtype)
    for i in range(len(q)):
        lower.fill(0)
        for p in range(len(dx)):
            np.abs(np.subtract(dx[p], dq[i, p], out=gap), out=gap)
            np.maximum(lower, gap, out=lower)
        bound = reach(q2[i], most, np.maximum(lower.astype(np.float64) - off, 0.0))
        kth = floor[i]
        left = np.flatnonzero((bound >= kth) & (x_rid != q_rid[i]))
        score, ids, step = x[:0] @ q[i], x_id[:0], STEP
        while len(left):
            if len(left) > step:
                order = np.argpartition(-bound[left], step)
                some, left = left[order[:step]], left[order[step:]]
            else:
                some, left = left, left[:0]
            evaluated += len(some)
            own = x[some] @ q[i]
            near = own >= kth
            score, ids = np.concatenate([score, own[near]]), np.concatenate([ids, x_id[some[near]]])
            if len(score) > k:
                top = score >= np.partition(score, len(score) - k)[len(score) - k]
                score, ids = score[top], ids[top]
                best = np.lexsort((ids, -score))[:k]
                score, ids = score[best], ids[best]
            if len(score) == k:
                kth = max(kth, score.min())
                left = left[bound[left] >= kth]  # no other candidate can reach the k-th score
            step *= STEP_GROWTH
        out += [(int(q_rid[i]), int(v), int(s)) for v, s in zip(ids, score, strict=True)]
    return out, evaluated


def search(rows: DataFrame, queries: Column, *, id_column="vec_id", vector_column="embedding", k: int = K, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query row's k best rows by inner product of whole vectors.

    queries marks the rows that are queries.  A row is no candidate of its own; another row
    of the same id is one, and each of several query rows with one id has its own k rows.
    Rows with a null id, or a vector that is null, empty, of another length than most, or
    holds null or non-finite components take no part.  Columns other than the two are not
    read.  Scores must fit a long: larger vectors raise ValueError.
    """
    spark = rows.sparkSession
    valid = rows.select(F.col(id_column).cast("long").alias("id"), whole(vector_column, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id IS NOT NULL AND v IS NOT NULL")
    sizes = valid.groupBy(F.size("v").alias("dim")).agg(
        F.count("*").alias("n"), F.count_if("asks").alias("asked"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("most"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")
    )
    facts = sizes.orderBy(F.desc("n"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score long"
    if facts is None or not facts["asked"]:
        return spark.createDataFrame([], empty)
    dim, most = facts["dim"], float(facts["most"])
    largest = dim * int(facts["top"]) ** 2
    if largest >= 1 << 63:
        raise ValueError("inner products do not fit a long")
    # products of doubles are exact below 2^53
    kind = np.float64 if largest < 1 << 53 else np.int64
    held = next(x for x in ("<i1", "<i2", "<i4", "<i8") if int(facts["top"]) <= np.iinfo(x).max)
    valid = valid.where(F.size("v") == dim)
    # at most PIVOT_ROWS rows
    sample = valid.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(PIVOT_ROWS).collect()
    table = choose_pivots(np.array([r["v"] for r in sample], np.float64).reshape(-1, dim), pivots)

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            v = np.array(pdf["v"].tolist(), np.float64).reshape(-1, dim)
            d = distances(v, most, table).astype("<f4")
            near = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            yield pd.DataFrame(
                {"rid": pdf["rid"], "id": pdf["id"], "asks": pdf["asks"], "near": near, "far": d[np.arange(len(d)), near], "v": [x.tobytes() for x in np.array(pdf["v"].tolist()).reshape(-1, dim).astype(held)], "d": [x.tobytes() for x in d]}
            )

    rows = valid.select(F.monotonically_increasing_id().alias("rid"), "id", "asks", "v").mapInPandas(measure, "rid long, id long, asks boolean, near int, far float, v binary, d binary")
    rows = common.stored(rows, "pivot-table")
    n_blocks = max(1, -(-facts["n"] // BLOCK))

    def vectors(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rid = np.frombuffer(row.rid, "<i8")
        return rid, np.frombuffer(row.v, held).reshape(len(rid), dim).astype(kind), np.frombuffer(row.d, "<f4").reshape(len(rid), -1)

    def packed(some: pd.DataFrame, **more) -> pd.DataFrame:
        """One row with all rows of some, and the ranges of their distances."""
        d = np.frombuffer(b"".join(some["d"]), "<f4").reshape(len(some), -1)
        ends = {"low": d.min(axis=0).tolist(), "high": d.max(axis=0).tolist()}
        return pd.DataFrame([{"rid": some["rid"].to_numpy("<i8").tobytes(), "v": b"".join(some["v"]), "d": d.tobytes()} | more | ends])

    def to_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []

        def block(some):
            return packed(some, number=int(some["rid"].iloc[0]), id=some["id"].to_numpy("<i8").tobytes(), asks=some["asks"].to_numpy("u1").tobytes())

        for pdf in parts:
            waiting.append(pdf)
            while sum(map(len, waiting)) >= BLOCK:
                all_rows = pd.concat(waiting)
                yield block(all_rows.iloc[:BLOCK])
                waiting = [all_rows.iloc[BLOCK:]]
        if sum(map(len, waiting)):
            yield block(pd.concat(waiting))

    def at_home(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The queries of a block, each with its k-th score in it."""
        for pdf in parts:
            for row in pdf.itertuples():
                rid, x, d = vectors(row)
                own = np.flatnonzero(np.frombuffer(row.asks, "u1"))
                if not len(own):
                    continue
                dq = distances(x[own].astype(np.float64), most, table, query=True).astype("<f4")
                found, _ = search_block(rid[own], x[own], dq, np.full(len(own), -np.inf), rid, np.frombuffer(row.id, "<i8"), x, np.ascontiguousarray(d.T), most, k)
                scores: dict[int, list] = {}
                for q, _, score in found:
                    scores.setdefault(q, []).append(score)
                # a double may lie above the long it stands for
                floor = [(m := min(scores[q])) - abs(m) * 1e-15 if len(scores.get(q, ())) >= k else -np.inf for q in rid[own].tolist()]
                yield pd.DataFrame({"rid": rid[own], "near": d[own].argmin(axis=1), "far": d[own].min(axis=1), "v": [y.tobytes() for y in x[own].astype(held)], "d": [y.tobytes() for y in dq], "floor": floor})

    def to_batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A batch is what a partition has: about BATCH queries."""
        from pyspark import TaskContext

        if waiting := [pdf for pdf in parts if len(pdf)]:
            some = pd.concat(waiting)
            v = np.frombuffer(b"".join(some["v"]), held).astype(np.float64).reshape(len(some), dim)
            yield packed(some, batch=TaskContext.get().partitionId(), floor=some["floor"].to_numpy("<f8").tobytes(), least=float(some["floor"].min()), longest=float((v * v).sum(axis=1).max()))

    spans = "low array<float>, high array<float>"
    ordered = rows.repartitionByRange(n_blocks, "near", "far", "rid").sortWithinPartitions("near", "far", "rid")
    blocks = ordered.select("rid", "id", "asks", "v", "d").mapInPandas(to_blocks, f"number long, rid binary, id binary, asks binary, v binary, d binary, {spans}")
    blocks = common.stored(blocks, "blocks")
    home = blocks.select("rid", "id", "asks", "v", "d").mapInPandas(at_home, "rid long, near int, far float, v binary, d binary, floor double")
    home = common.stored(home, "queries")
    ordered = home.repartitionByRange(max(1, -(-int(facts["asked"]) // BATCH)), "near", "far", "rid").sortWithinPartitions("near", "far", "rid")
    batches = ordered.select("rid", "v", "d", "floor").mapInPandas(to_batch, f"batch int, rid binary, v binary, d binary, floor binary, least double, longest double, {spans}")
    batches = common.stored(batches, "batches")
    last = batches.agg(F.max("batch")).first()[0]
    # pairs of a block and a batch, by their ranges alone; what cannot meet goes no further
    ends = batches.select("batch", "least", "longest", F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    pairs = blocks.select("number", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("batch")).join(ends, "batch")
    apart = F.zip_with(F.zip_with("low", "q_high", lambda a, b: a - b), F.zip_with("q_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0).cast("float")))
    lower = F.greatest(F.array_max(apart).cast("double") - F.lit(slack(most)), F.lit(0.0))
    pairs = pairs.where(reach(F.col("longest"), most, lower) >= F.col("least")).select("number", "batch")
    asked = batches.select("batch", F.col("rid").alias("q_rid"), F.col("v").alias("q_v"), F.col("d").alias("q_d"), "floor")
    asked = common.small(asked, int(facts["asked"]), dim * np.dtype(held).itemsize + 4 * len(table) + 32)
    tasks = pairs.join(asked, "batch").join(blocks.select("number", "rid", "id", "v", "d"), "number")
    tasks = tasks.repartition(min((last + 1) * n_blocks, 4 * common.partitions(spark)), "batch", "number")

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for row in pdf.itertuples():
                rid, x, d = vectors(row)
                q_rid = np.frombuffer(row.q_rid, "<i8")
                q, dq = np.frombuffer(row.q_v, held).reshape(len(q_rid), dim).astype(kind), np.frombuffer(row.q_d, "<f4").reshape(len(q_rid), -1)
                found, _ = search_block(q_rid, q, dq, np.frombuffer(row.floor, "<f8"), rid, np.frombuffer(row.id, "<i8"), x, np.ascontiguousarray(d.T), most, k)
                yield pd.DataFrame(found, columns=["q", "vec_id", "score"])

    best = tasks.select("q_rid", "q_v", "q_d", "floor", "rid", "id", "v", "d").mapInPandas(find, "q long, vec_id long, score long")
    # sort-based per query: at most k rows from each block
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(rows.where("asks").select(F.col("rid").alias("q"), F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")
