"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, its rate the document's quality weight; within
a source, documents in key order are a weighted sample without replacement.  A source's
target is met by whole epochs first (every document once for each), then by documents in
key order: each that is no longer than what is left of the target is taken, each other one
is skipped, and at the end one more is if that brings the source nearer to its target.

Only sizes and keys are shuffled, never texts.  A source may hold any share of the
rows: its documents are split by key range into buckets, summed per bucket, and only
bucket totals are added up per source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARES = (5, 2, 1)
TOTAL = 1.5
MOST = 2.0
SEED = 20_240_617
#: Buckets of keys for each doubling of the key and each shuffle partition.
FINE = 1


def _place() -> Column:
    """Where a row of a located() table lies; it orders rows that are alike."""
    return F.struct(F.col("__file").alias("file"), F.col("__row").alias("row"))


def words(text: Column) -> Column:
    """Number of white-space separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A document's default weight: falls with its share of table and markup symbols, 1 for none."""
    n = F.char_length(text)
    symbols = n - F.char_length(F.translate(text, "|#*%&$<>{}[]=~^_\\", ""))
    return F.coalesce(1 / (1 + 20 * symbols / F.greatest(n, F.lit(1))), F.lit(1.0))


def key(doc_id: Column, weight: Column, seed: int = SEED, text: Column | None = None) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the id, or of the text where that is null: the same in every run."""
    named = [doc_id] if text is None else [doc_id, F.when(doc_id.isNull(), F.xxhash64(text))]
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *named), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.greatest(weight.cast("double"), F.lit(1e-9))


@dataclass
class Mix:
    """targets: one row per source; decisions: one row per document."""

    targets: DataFrame
    decisions: DataFrame


def targets(sizes: DataFrame, shares=SHARES, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size, weight, target of every source; sizes has source and size.

    Weights repeat over the sources in code point order, null last.  total times all
    sizes is shared by weight; a target stops at most times its source's size and the
    excess goes to the others by weight, until none is above.  Sources stay distributed:
    each round is one sum over the table of sources, and ends when no more reach the stop.
    """
    spark = sizes.sparkSession
    per = common.fixed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = per.repartitionByRange(common.partitions(spark), F.col("source").asc_nulls_last())
    ranked = common.fixed(ranked.select("*", F.spark_partition_id().alias("part")), "sources-ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(x)) for x in shares])
    weighted = ranked.withColumn("place", place).join(F.broadcast(offsets), "part")  # a row for each partition
    weighted = weighted.select("source", "source_size", F.get(weights, ((F.col("place") + F.col("base")) % len(shares)).cast("int")).alias("weight"))
    weighted = common.fixed(weighted, "sources-weighted")
    all_size = weighted.agg(F.sum("source_size")).first()[0] or 0
    budget = total * all_size
    stop = F.col("source_size") * F.lit(float(most))
    level, seen = 0.0, -1
    while True:  # level: target for a weight of 1; rises until no further source is stopped
        at_stop = F.col("weight") * F.lit(level) >= stop
        row = weighted.agg(
            F.sum(F.when(at_stop, stop).otherwise(0.0)).alias("held"), F.sum(F.when(at_stop, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(at_stop).alias("n")
        ).first()
        if row["n"] is None or row["n"] == seen or not row["free"]:
            level = level if row["free"] else float("inf")
            break
        seen, level = row["n"], max(0.0, budget - row["held"]) / row["free"]
    goal = F.least(stop, F.col("weight") * F.lit(level)) if level != float("inf") else stop
    return weighted.withColumn("target", goal.cast("double"))


def mix(docs: DataFrame, *, id_column="doc_id", source_column="source", text_column="text", weight: Column | None = None, shares=SHARES, total=TOTAL, most=MOST, seed=SEED) -> Mix:
    """Decide how many words of each document the mix takes.

    decisions: doc_id, source, size, source_size, target, taken and copies (how often the
    document is taken).  Null texts have size 0 and a null source is a source of its own; rows
    without an id are drawn by their text, equal ones in the order of the table;
    repeated rows count each; an empty table gives no rows.  In key order, every document that
    fits what is left of its source's rest is taken; then the shortest other, if that is nearer.
    """
    sized, goals, rules, n_sources = _rules(common.located(docs), id_column, source_column, text_column, weight, shares, total, most, seed)
    there = sized["source"].eqNullSafe(rules["source"])
    rows = sized.join(common.small(rules, n_sources, 1024), there, "left").drop(rules["source"])
    copies = _copies(F.struct("key", "doc_id", "rid"), F.col("size"))
    decided = rows.select("doc_id", "source", "size", "source_size", "target", "key", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
    return Mix(goals, decided)


def apply(docs: DataFrame, *, id_column="doc_id", source_column="source", text_column="text", weight: Column | None = None, shares=SHARES, total=TOTAL, most=MOST, seed=SEED) -> DataFrame:
    """docs with each row as often as mix() takes it. A row's own key and its source's rule decide, so no texts are shuffled."""
    columns, docs = docs.columns, common.located(docs)
    _, _, rules, n_sources = _rules(docs, id_column, source_column, text_column, weight, shares, total, most, seed)
    weight = quality(F.col(text_column)) if weight is None else weight
    rules = rules.select(F.col("source").alias("__source"), "epochs", "steps", "extra")
    rows = docs.withColumns({"__key": key(F.col(id_column), weight, seed, F.col(text_column)), "__size": words(F.col(text_column)), "__rid": _place()})
    rows = rows.join(common.small(rules, n_sources, 1024), F.col(source_column).eqNullSafe(F.col("__source")), "left")
    place = F.struct(F.col("__key").alias("key"), F.col(id_column).alias("doc_id"), F.col("__rid").alias("rid"))
    rows = rows.withColumn("__copies", _copies(place, F.col("__size")).cast("int")).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)


def _chosen(place: Column, size: Column) -> Column:
    """Whether a row with its source's steps beside it is among those that fit.

    Limits fall and stops rise from step to step, so a row that a later step names was taken by its own.
    """
    within = F.exists("steps", lambda s: (size <= s["limit"]) & (s["stop"].isNull() | (place < s["stop"])))
    return F.coalesce(within, F.lit(False))


def _copies(place: Column, size: Column) -> Column:
    """How often a row with its source's rule beside it is taken."""
    chosen = _chosen(place, size) | F.coalesce(place == F.col("extra"), F.lit(False))
    return F.coalesce(F.col("epochs"), F.lit(0)) + chosen.cast("long")


def _rules(docs, id_column, source_column, text_column, weight, shares, total, most, seed) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Of docs, located(): sized documents; targets; each source's rule (epochs, steps, extra); the number of sources."""
    weight = quality(F.col(text_column)) if weight is None else weight
    sized = docs.select(
        _place().alias("rid"), F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), words(F.col(text_column)).alias("size"),
        key(F.col(id_column), weight, seed, F.col(text_column)).alias("key"),
    )
    sized = common.stored(sized, "sized")
    goals = targets(sized, shares, total, most)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = common.fixed(goals.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))), "targets")
    n_sources = goals.count()
    cuts = _cuts(sized, goals, n_sources)
    rules = common.fixed(goals.join(cuts, goals["source"].eqNullSafe(cuts["source"]), "left").select(goals["*"], "steps", "extra"), "cuts")
    return sized, goals, rules, n_sources


def _cuts(sized: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """source, steps and extra: the documents that fit the rest in key order, and the one more that brings it nearest.

    A step takes the documents up to limit words that come before stop (null: all of them).
    Its limit is what was left of the rest, its stop the first of them that no longer fits;
    the next step goes on behind it with what is left then.  Once few documents are left
    that could fit, they are gone through one by one.
    """
    spark = sized.sparkSession
    # A weight only shifts a key's logarithm, whose density stays under 0.37 a unit: so whatever the
    # weights are, the fullest bucket holds under 0.37 ln(2) / FINE, a quarter, of a partition's share of a source.
    spread = F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * (FINE * common.partitions(spark))).cast("long")
    place = F.struct("key", "doc_id", "rid")
    kind = f"struct<key:double,doc_id:{sized.schema['doc_id'].dataType.simpleString()},rid:struct<file:bigint,row:bigint>>"
    steps = f"array<struct<stop:{kind},limit:double>>"
    columns = ["source", "bucket", "size", "key", "doc_id", "rid"]
    rows = sized.where("size > 0").withColumn("bucket", spread)
    per = common.fixed(goals.select("source", F.col("rest").alias("gap"), F.lit(None).cast(kind).alias("stop"), F.array().cast(steps).alias("steps")), "gaps")
    live = rows
    while True:
        left = per.select(F.col("source").alias("g"), "gap", "stop")
        live = live.join(common.small(left, n_sources, 128), F.col("source").eqNullSafe(F.col("g")))
        # a source whose last step had no stop has taken all that fit
        live = common.stored(live.where((F.col("size") <= F.col("gap")) & (F.col("stop").isNull() | (place > F.col("stop")))).select(*columns), "near")
        if live.count() <= common.FEW:
            break
        per = _step(per, live, n_sources)
        live = live.join(common.small(per.where("NOT done").select(F.col("source").alias("g")), n_sources, 64), F.col("source").eqNullSafe(F.col("g")), "left_semi")
    per = _one_by_one(per, live, n_sources, steps)
    ends = per.select(F.col("source").alias("g"), "gap", "steps")
    other = rows.join(common.small(ends, n_sources, 1024), F.col("source").eqNullSafe(F.col("g"))).where((F.col("size") < 2 * F.col("gap")) & ~_chosen(place, F.col("size")))
    nearest = other.groupBy("source").agg(F.min(F.struct(F.col("size").alias("size"), place.alias("place"))).alias("nearest")).select(F.col("source").alias("n"), "nearest")
    return per.join(nearest, F.col("source").eqNullSafe(F.col("n")), "left").select("source", "steps", F.col("nearest.place").alias("extra"))


def _step(per: DataFrame, live: DataFrame, n_sources: int) -> DataFrame:
    """per (source, gap, stop, steps) after one more step over live; done where nothing is left."""
    total = live.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    gaps = per.select(F.col("source").alias("g"), "gap")
    base = total.withColumn("base", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).join(common.small(gaps, n_sources, 128), F.col("source").eqNullSafe(F.col("g")))
    base = common.stored(base.drop("g"), "buckets")
    # only the bucket in which a source's gap is used up is put in order
    full = base.where("base <= gap AND base + in_bucket > gap").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base", "gap")
    upto = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = live.join(common.small(full, n_sources, 128), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = inside.withColumn("sum", F.col("base") + F.sum("size").over(upto)).where("sum > gap")
    stops = inside.groupBy("source").agg(F.min(F.struct(F.struct("key", "doc_id", "rid").alias("stop"), (F.col("sum") - F.col("size")).alias("words"))).alias("at"))
    took = total.groupBy("source").agg(F.sum("in_bucket").alias("all")).select(F.col("source").alias("t"), "all")
    stops = stops.select(F.col("source").alias("n"), "at")
    out = per.select("source", "gap", "stop", "steps").join(took, F.col("source").eqNullSafe(F.col("t")), "left").join(stops, F.col("source").eqNullSafe(F.col("n")), "left")
    more = F.array(F.struct(F.col("at.stop").alias("stop"), F.col("gap").alias("limit")))
    some = F.col("all").isNotNull()
    out = out.select(
        "source", (F.col("gap") - F.when(some, F.coalesce("at.words", "all")).otherwise(0)).alias("gap"), F.coalesce("at.stop", "stop").alias("stop"),
        F.when(some, F.concat("steps", more)).otherwise(F.col("steps")).alias("steps"), F.col("at").isNull().alias("done"),
    )
    return common.fixed(out, "gaps")


def _one_by_one(per: DataFrame, live: DataFrame, n_sources: int, kind: str) -> DataFrame:
    """per (source, gap, steps) after all further steps over the few rows of live."""
    gaps = per.select(F.col("source").alias("g"), "gap")
    rows = live.join(common.small(gaps, n_sources, 128), F.col("source").eqNullSafe(F.col("g"))).orderBy("source", "key", "doc_id", "rid").collect()
    ends: dict = {}
    for r in rows:
        steps, limit, gap = ends.get(r["source"], ([], r["gap"], r["gap"]))
        if r["size"] <= gap:
            gap -= r["size"]
        elif r["size"] <= limit:
            steps, limit = [*steps, ((r["key"], r["doc_id"], r["rid"]), limit)], gap
        ends[r["source"]] = (steps, limit, gap)
    found = [(source, [*steps, (None, limit)], float(gap)) for source, (steps, limit, gap) in ends.items()]
    more = live.sparkSession.createDataFrame(found, f"n {per.schema['source'].dataType.simpleString()}, more {kind}, left double")
    out = per.join(more, F.col("source").eqNullSafe(F.col("n")), "left")
    out = out.select("source", F.coalesce("left", "gap").alias("gap"), F.when(F.col("more").isNotNull(), F.concat("steps", "more")).otherwise(F.col("steps")).alias("steps"))
    return common.fixed(out, "gaps")
