"""Best-fit packing of documents into fixed-length sequences, after dominance reduction.

Pieces have whole lengths from 1 to capacity, so an instance, however many pieces it
has, is a count for each length.  The counts are gathered (at most capacity numbers),
the driver fixes dominating sets and best-fits the remainder on counts, and the result
is a list of fill patterns with multiplicities, a few for each length.  Every piece then
finds its place from its rank among the pieces of its length; nothing but counts and
patterns passes through the driver.

Dominance (Martello and Toth): a feasible set F with item j dominates when some optimal
solution holds F as a bin.
  1. j and the smallest item together are too long: {j} alone.
  2. j and k fill a bin exactly: {j, k}.
  3. k is the longest partner of j, and no two items that fit beside j are together
     longer than k (nor do three fit): {j, k}.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import END_ID, encoder, runs, vocabulary_path

CAPACITY = 1024


@dataclass
class Plan:
    """patterns: (lengths in a sequence, in order; number of such sequences)."""

    capacity: int
    patterns: list[tuple[list[int], int]] = field(default_factory=list)
    fixed: int = 0  # sequences fixed by dominance

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def reduce_and_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack counts[length] pieces of each length. The number of patterns is bounded by a few times capacity."""
    plan = Plan(capacity)
    c = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} cannot be packed into {capacity}")
        c[length] += n

    def fix(lengths: list[int], n: int) -> None:
        for x in lengths:
            c[x] -= n
        plan.patterns.append((lengths, n))
        plan.fixed += n

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while c[j]:
                found = _dominating(c, j, capacity)
                if found is None:
                    break
                n = min(c[x] // found.count(x) for x in set(found))
                fix(found, n)
                changed = True
    _best_fit(c, capacity, plan)
    return plan


def _at_least(c: list[int], used: dict[int, int], x: int) -> bool:
    return c[x] - used.get(x, 0) > 0


def _dominating(c: list[int], j: int, capacity: int) -> list[int] | None:
    """A set with j that dominates all other sets with j, or None if none is known."""
    room = capacity - j
    used = {j: 1}
    if room == 0:
        return [j]
    if _at_least(c, used, room):
        return [j, room]
    small = [x for x in range(1, room + 1) if _at_least(c, used, x)][:3]
    if not small:
        return [j]
    k = next(x for x in range(room, 0, -1) if _at_least(c, used, x))
    # three items beside j
    least: list[int] = []
    for x in small:
        least += [x] * min(3, c[x] - used.get(x, 0))
    if len(least) >= 3 and sum(sorted(least)[:3]) <= room:
        return None
    # the longest pair beside j
    if len(least) < 2 or sum(sorted(least)[:2]) > room:
        return [j, k]
    a, best = 1, 0
    for b in range(room - 1, 0, -1):
        if not _at_least(c, used, b):
            continue
        for a in range(min(b, room - b), 0, -1):
            if _at_least(c, used, a) and (a != b or c[a] - used.get(a, 0) >= 2):
                best = max(best, a + b)
                break
        if best > k or 2 * b < best:
            break
    return [j, k] if best <= k else None


def _best_fit(c: list[int], capacity: int, plan: Plan) -> None:
    """Best-fit decreasing over counts: open bins are groups of equal contents."""
    groups: list[list] = []  # [room, contents, number]
    for s in range(capacity, 0, -1):
        left = c[s]
        c[s] = 0
        for group in sorted((g for g in groups if g[0] >= s), key=lambda g: g[0]) if left else []:
            if not left:
                break
            room, contents, number = group
            fit = room // s
            full = min(number, left // fit)
            left -= full * fit
            part = min(left, fit) if full < number else 0
            left -= part
            groups.remove(group)
            if full:
                groups.append([room - fit * s, contents + [s] * fit, full])
            if part:
                groups.append([room - part * s, contents + [s] * part, 1])
            if number - full - bool(part):
                groups.append([room, contents, number - full - bool(part)])
        fit = capacity // s
        if left >= fit:
            groups.append([capacity - fit * s, [s] * fit, left // fit])
        if left % fit:
            groups.append([capacity - left % fit * s, [s] * (left % fit), 1])
    plan.patterns += [(contents, number) for _, contents, number in groups]


def segments(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go: (length, first rank, rank after the last, first sequence, pieces of the length in a sequence, their offset)."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for contents, number in plan.patterns:
        offset, i = 0, 0
        contents = sorted(contents, reverse=True)
        while i < len(contents):
            s = contents[i]
            m = contents.count(s)
            at = rank.get(s, 0)
            rows.append((s, at, at + m * number, sequence, m, offset))
            rank[s] = at + m * number
            offset += m * s
            i += m
        sequence += number
    return rows


def tokenised(docs: DataFrame, *, id_column="doc_id", text_column="text", vocabulary: str | None = None, end_id: int | None = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, written to the shared folder: doc_id, piece, start, length, ids, part, k.

    ids: the piece's ids, little-endian in the fewest whole bytes for the vocabulary
    (2 for 50,257 ids).  A longer document is cut from its end, so that its first
    piece may be short and the others are full.  part and k number the pieces of one
    length within one task; they are fixed by being written.
    """
    vocabulary = vocabulary or vocabulary_path()
    id_type = docs.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        code = encoder(vocabulary)
        kind = id_kind(code.vocabulary)
        seen: dict[int, int] = {}
        for pdf in common.trimmed(batches):
            names, texts = pdf[id_column].tolist(), pdf[text_column].tolist()
            for run in runs(texts):
                out = []
                for name, ids in zip(names[run], code.encode(texts[run]), strict=True):
                    if end_id is not None:
                        ids = np.append(ids, np.int32(end_id))
                    ids = ids.astype(kind)
                    at = 0
                    for piece in range(-(-len(ids) // capacity)):
                        n = (len(ids) - at) % capacity or capacity
                        k = seen.get(n, 0)
                        seen[n] = k + 1
                        out.append((name, piece, at, n, ids[at : at + n].tobytes(), part, k))
                        at += n
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids", "part", "k"])

    rows = docs.select(id_column, text_column).mapInPandas(cut, f"doc_id {id_type}, piece int, start long, length long, ids binary, part long, k long")
    return common.stored(rows, "pieces")


def id_kind(vocabulary: int) -> str:
    return "<u1" if vocabulary <= 1 << 8 else "<u2" if vocabulary <= 1 << 16 else "<u4"


def pack(docs: DataFrame, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """Pack every document of docs; one row per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    Null texts are empty (a lone end id); repeated rows are packed each for itself; an
    empty table gives no rows.  Sequences are gapless from offset 0.  The result reads
    the written pieces once.  Each finds its rank from a row for its task and length; while
    those rows are few enough to be broadcast (about 500 tasks) no ids are shuffled, beyond
    that ids, which take two bytes, go once through a join on task and length.
    """
    pieces = tokenised(docs, capacity=capacity, **options)
    spark = docs.sparkSession
    counts = common.stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # at most capacity rows reach the driver
    held = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = reduce_and_fit(held, capacity)
    where = spark.createDataFrame(segments(plan), "length long, first long, last long, sequence long, m long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bound = counts.count()
    return (
        pieces.join(common.small(base, bound, 64), ["part", "length"])
        .withColumn("rank", F.col("base") + F.col("k"))
        .join(F.broadcast(where), "length")  # a few rows for each length up to capacity
        .where("rank >= first AND rank < last")
        .select(
            "doc_id", "piece", "start", "length", "ids",
            (F.col("sequence") + F.expr("(rank - first) div m")).alias("sequence_id"),
            (F.col("at") + F.expr("(rank - first) % m") * F.col("length")).alias("offset"),
        )
    )


def digest(packed: DataFrame) -> DataFrame:
    """The packed rows with ids_crc32, the unsigned crc32 of ids as little-endian uint32, in place of ids."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series, length: pd.Series) -> pd.Series:
        import zlib

        # an id takes as many bytes as its vocabulary needs
        return pd.Series([zlib.crc32(np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes()) for x, n in zip(ids, length, strict=True)], dtype="int64")

    return packed.select("doc_id", "piece", "start", "length", crc("ids", "length").alias("ids_crc32"), "sequence_id", "offset")
