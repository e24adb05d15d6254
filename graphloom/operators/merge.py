"""Three-way merges of many texts at once: which changes meet, and the merged lines.

Texts are rows (source, pos from 0 without gaps, line).  Two versions of a text are matched
in two steps.  Lines that stand once in either version, and that no other such pair
crosses, are anchors: joins and windows find them, and they cut a text into stretches.
Within a stretch the longest common subsequence of lines decides, by bits of big integers;
of several the one that takes lines earliest, first in the old text.  Base lines matched in
both versions are stable; what lies between two stable lines is a chunk, as in diff3.

A text that a version does not have is empty there, so a text made anew on both sides, or
changed on one and removed on the other, is a chunk like any other.  Null lines are empty
ones.  A stretch or chunk is a row, and at most a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Rows of the bit table between those that are kept; the others are made again when the path needs them.
KEPT_EVERY = 256


def common(old: list, new: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists; of several, the one that takes old's, then new's, earliest."""
    m = len(new)
    places: dict = {}
    for j, x in enumerate(new):
        places[x] = places.get(x, 0) | 1 << (m - 1 - j)
    everything = (1 << m) - 1

    def above(row: int, x) -> int:
        """The row of one line more of old: its zeros below bit m - j count what old's rest has in common with new[j:]."""
        met = row & places.get(x, 0)
        return ((row + met) | (row - met)) & everything

    kept, row = {len(old): everything}, everything
    for i in range(len(old) - 1, -1, -1):
        row = above(row, old[i])
        if i % KEPT_EVERY == 0:
            kept[i] = row
    out, i, j, rows = [], 0, 0, {}
    while i < len(old) and j < m:
        if old[i] == new[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        if i not in rows or i + 1 not in rows:
            low = i - i % KEPT_EVERY
            last = min(len(old), low + KEPT_EVERY)
            rows = {last: kept[last]}
            for r in range(last - 1, low - 1, -1):
                rows[r] = above(rows[r + 1], old[r])
        left = m - j
        without_old = left - (rows[i + 1] & ((1 << left) - 1)).bit_count()
        without_new = left - 1 - (rows[i] & ((1 << (left - 1)) - 1)).bit_count()
        if without_old >= without_new:
            i += 1
        else:
            j += 1
    return out


def _plain(texts: DataFrame) -> DataFrame:
    return texts.select("source", F.col("pos").cast("int").alias("pos"), F.coalesce("line", F.lit("")).alias("line"))


def _number(points: DataFrame, by: str) -> DataFrame:
    """points with their number k in their source, from 1."""
    return points.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(by)))


def _between(versions: list[DataFrame], points: DataFrame, names: list[str]) -> DataFrame:
    """source, k and for each version a sorted array of (pos, line) that lie after the k-th point and before the next; points: source, k and the places by these names."""
    so_far = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = []
    for i, (version, name) in enumerate(zip(versions, names)):
        at = version.join(points.select("source", F.col(name).alias("pos"), F.col("k").alias("point")), ["source", "pos"], "left")
        rows.append(at.withColumn("k", F.coalesce(F.last("point", True).over(so_far), F.lit(0))).where("point IS NULL").select("source", "k", F.lit(i).alias("version"), "pos", "line"))
    side = lambda i: F.sort_array(F.collect_list(F.when(F.col("version") == i, F.struct("pos", "line")))).alias(names[i])
    return reduce(DataFrame.unionByName, rows).groupBy("source", "k").agg(*[side(i) for i in range(len(versions))])


def matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, old_pos, new_pos of the lines that two versions have in common, in order in both."""
    old, new = _plain(old), _plain(new)
    once = lambda rows, name: rows.groupBy("source", "line").agg(F.count("*").alias("n"), F.min("pos").alias(name)).where("n = 1").drop("n")
    pairs = once(old, "old_pos").join(once(new, "new_pos"), ["source", "line"]).drop("line")
    order = Window.partitionBy("source").orderBy("old_pos")
    before = F.max("new_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # the least of what follows, as the greatest of what precedes in the other direction: both stay running windows
    after = F.min("new_pos").over(Window.partitionBy("source").orderBy(F.desc("old_pos")).rowsBetween(Window.unboundedPreceding, -1))
    pairs = pairs.withColumns({"before": before, "after": after})
    anchors = cut(_number(pairs.where("coalesce(before < new_pos, true) AND coalesce(after > new_pos, true)").select("source", "old_pos", "new_pos"), "old_pos"))
    stretches = _between([old, new], anchors, ["old_pos", "new_pos"]).where("size(old_pos) > 0 AND size(new_pos) > 0")
    stretches = cut(stretches.select("source", F.col("old_pos.line").alias("a"), F.col("new_pos.line").alias("b"), F.col("old_pos")[0]["pos"].alias("old_from"), F.col("new_pos")[0]["pos"].alias("new_from")))
    same = stretches.where("a = b").select("source", F.explode(F.sequence(F.lit(0), F.size("a") - 1)).alias("i"), "old_from", "new_from")
    same = same.select("source", (F.col("old_from") + F.col("i")).alias("old_pos"), (F.col("new_from") + F.col("i")).alias("new_pos"))
    kind = old.schema["source"].dataType.simpleString()

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                found = pd.DataFrame(common(list(r.a), list(r.b)), columns=["old_pos", "new_pos"], dtype="int32")
                yield pd.DataFrame({"source": pd.Series([r.source] * len(found), dtype=batch["source"].dtype), "old_pos": found["old_pos"] + r.old_from, "new_pos": found["new_pos"] + r.new_from})

    other = stretches.where("a <> b AND arrays_overlap(a, b)").mapInPandas(align, f"source {kind}, old_pos int, new_pos int")
    return anchors.drop("k").unionByName(same).unionByName(other)


def _stable(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """source, base, ours, theirs (places), k of the base lines that both versions have."""
    a = matched(base, ours).toDF("source", "base", "ours")
    b = matched(base, theirs).toDF("source", "base", "theirs")
    return cut(_number(a.join(b, ["source", "base"]), "base"))


def _chunks(base: DataFrame, ours: DataFrame, theirs: DataFrame, stable: DataFrame) -> DataFrame:
    names = ["base", "ours", "theirs"]
    found = _between([_plain(base), _plain(ours), _plain(theirs)], stable, names)
    starts = stable.select("source", "k", *[(F.col(n) + 1).alias(f"{n}_start") for n in names])
    a, b, o = F.col("ours.line"), F.col("theirs.line"), F.col("base.line")
    kind = F.when(a == b, "both").when(b == o, "ours").when(a == o, "theirs").otherwise("conflict")
    rows = found.join(starts, ["source", "k"], "left")
    return rows.select("source", F.col("k").alias("chunk"), kind.alias("kind"), *[F.coalesce(f"{n}_start", F.lit(0)).alias(f"{n}_start") for n in names], *[F.col(f"{n}.line").alias(f"{n}_lines") for n in names])


def chunks(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """source, chunk, kind, and the start (from 0) and lines of base, ours and theirs, of every place where a version departs from base.

    chunk: how many stable lines precede it.  kind: both (the versions say the same), ours or
    theirs (only that one departs), conflict.
    """
    return _chunks(base, ours, theirs, _stable(base, ours, theirs))


def resolved(kind: Column, ours: Column, theirs: Column) -> Column:
    """The merged lines of a chunk; a conflict shows both sides between markers."""
    mark = lambda s: F.array(F.lit(s))
    return F.when(kind == "theirs", theirs).when(kind == "conflict", F.concat(mark("<<<<<<< ours"), ours, mark("======="), theirs, mark(">>>>>>> theirs"))).otherwise(ours)


def merged(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """source, pos, line of the merged texts, conflicts between markers; sources.files.merge_conflicts finds them by those."""
    stable = _stable(base, ours, theirs)
    kept = stable.join(_plain(base).withColumnRenamed("pos", "base"), ["source", "base"]).select("source", "k", F.lit(0).alias("part"), F.array("line").alias("lines"))
    changed = _chunks(base, ours, theirs, stable)
    changed = changed.select("source", F.col("chunk").alias("k"), F.lit(1).alias("part"), resolved(F.col("kind"), F.col("ours_lines"), F.col("theirs_lines")).alias("lines"))
    rows = kept.unionByName(changed).select("source", "k", "part", F.posexplode("lines").alias("i", "line"))
    return rows.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("k", "part", "i")) - 1).alias("pos"), "line")


def outcome(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """source, changes, conflicts, clean of the texts that differ between any two of the versions."""
    rows = chunks(base, ours, theirs).groupBy("source").agg(F.count("*").alias("changes"), F.count_if(F.col("kind") == "conflict").alias("conflicts"))
    return rows.withColumn("clean", F.col("conflicts") == 0)
