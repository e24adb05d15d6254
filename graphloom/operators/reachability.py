"""How many nodes reach each node, exactly, without a row for each pair.

condense() gives the cycles of a graph: nodes that reach each other become one component.
What is left has no cycles, and is worked level by level: a component's ancestors are those
of the components before it and itself, kept as bits, in rows of WORDS * 64 components.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop, scratch

#: 64-bit numbers of a row of ancestors.
WORDS = 8
_BITS = [f"b{i}" for i in range(WORDS)]


def _inner(edges: DataFrame) -> DataFrame:
    """edges (written) without those of nodes that nothing enters or nothing leaves, which are on no cycle."""
    n = edges.count()
    while n:
        keep = edges.select(F.col("src").alias("id")).distinct().intersect(edges.select("dst").distinct())
        left = cut(edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        drop(edges)
        edges, before = left, n
        n = edges.count()
        if n == before:
            break
    return edges


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges with each chain as one edge; chains (first, src, dst) and links (id, first), the nodes within them; a ring of links only has src null.

    A link has one way in and one way out; pointers to the link before are doubled until they
    show each chain's first, or, on rings, its greatest, so long ways take few rounds.
    """
    one = lambda c, to: edges.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n"), F.min(to).alias(to)).where("n = 1").select("id", to)
    links = cut(one("dst", "src").join(one("src", "dst"), "id"))
    n = links.count()
    before = links.select(F.col("id").alias("src"), F.lit(True).alias("linked"))
    at = links.join(before, "src", "left").select("id", F.when(F.col("linked"), F.col("src")).otherwise(F.col("id")).alias("first"), F.col("id").alias("most"))
    at = cut(at)
    starts = cut(at.where("id = first").select(F.col("id").alias("first"), F.lit(True).alias("start")))
    for _ in range(n.bit_length() + 1):
        ends = at.join(starts, "first", "left")
        if ends.where("start IS NULL").isEmpty():
            break
        on = at.select(F.col("id").alias("first"), F.col("first").alias("to"), F.col("most").alias("other"))
        after = cut(at.join(on, "first").select("id", F.col("to").alias("first"), F.greatest("most", "other").alias("most")))
        drop(at)
        at = after
    at = at.join(starts, "first", "left").select("id", F.when(F.col("start"), F.col("first")).otherwise(F.col("most")).alias("first"), "start")
    at = cut(at)
    named = links.join(at, "id")
    head = named.where("start AND id = first").select("first", "src")
    tail = named.where("start").join(links.select(F.col("id").alias("dst"), F.lit(True).alias("linked")), "dst", "left").where("linked IS NULL").select("first", "dst")
    rings = at.where("start IS NULL").select("first").distinct().select("first", F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.lit(None).cast(edges.schema["src"].dataType).alias("dst"))
    chains = cut(head.join(tail, "first").unionByName(rings))
    inside = links.select("id")
    kept = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_anti").join(inside.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    kept = kept.union(chains.where("src <> dst").select("src", "dst")).distinct()
    return cut(kept), chains, at.select("id", "first")


def cycles(edges: DataFrame) -> DataFrame:
    """id, component for nodes that are on cycles, and some that are not and so alone; component is one of its ids.

    Nodes that nothing enters or leaves go first, and chains become edges.  Then labels flow
    forward, the greatest first (by degree, so that the largest component's hub leads); who
    has its own label is a root, and what leads back to it under that label is its
    component.  Components leave, labels no longer mix, and the rest is trimmed again.
    """
    left, chains, links = _chains(_inner(cut(edges.select("src", "dst").where("src <> dst").distinct())))
    left = _inner(left)
    found = []
    while left.count():
        out, into = left.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o")), left.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
        state = cut(out.join(into, "id").select("id", F.struct((F.col("o") * F.col("i")).alias("d"), "id").alias("label"), F.lit(True).alias("moved")))
        while True:
            moved = state.where("moved").select(F.col("id").alias("src"), "label").join(left, "src").groupBy(F.col("dst").alias("id")).agg(F.max("label").alias("new"))
            better = F.coalesce(F.col("new") > F.col("label"), F.lit(False))
            after = cut(state.join(moved, "id", "left").select("id", F.when(better, F.col("new")).otherwise(F.col("label")).alias("label"), better.alias("moved")))
            drop(state)
            state = after
            if state.where("moved").isEmpty():
                break
        of = state.select("id", F.col("label.id").alias("label"))
        alike = left.join(of.select(F.col("id").alias("src"), "label"), "src").join(of.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst")
        alike = cut(alike.where("label = to").select("src", "dst", "label"))
        frontier = cut(of.where("id = label"))
        rounds = [frontier]
        while True:
            back = alike.join(frontier.withColumnRenamed("id", "dst"), ["dst", "label"]).select(F.col("src").alias("id"), "label").distinct()
            frontier = cut(back.join(reduce(DataFrame.unionByName, rounds), ["id", "label"], "left_anti"))
            if frontier.isEmpty():
                break
            rounds.append(frontier)
        own = cut(reduce(DataFrame.unionByName, rounds))
        found.append(own.select("id", F.col("label").alias("component")))
        gone = own.select(F.col("id").alias("src"))
        rest = alike.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")
        left = _inner(cut(rest))
    none = edges.limit(0).select(F.col("src").alias("id"), F.col("src").alias("component"))
    known = cut(reduce(DataFrame.unionByName, found, none))
    # a chain is on a cycle if its ends are in one component; a ring is one by itself
    end = lambda c, to: known.select(F.col("id").alias(c), F.col("component").alias(to))
    a, b = F.coalesce("a", "src"), F.coalesce("b", "dst")
    held = chains.join(end("src", "a"), "src", "left").join(end("dst", "b"), "dst", "left").where(F.col("src").isNull() | (a == b))
    return known.unionByName(links.join(held.select("first", F.coalesce(a, "first").alias("component")), "first").select("id", "component"))


def condense(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """members (id, component) of every node of edges (src, dst) and nodes (id), and the edges between components (src, dst), which have no cycle."""
    edges = cut(edges.select("src", "dst").distinct())
    every = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    every = (every if nodes is None else every.union(nodes.select("id"))).distinct()
    members = cut(every.join(cycles(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    of = lambda c, to: members.select(F.col("id").alias(c), F.col("component").alias(to))
    between = edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return members, cut(between)


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """id, level (the edges of the longest way to it) for nodes (id) of a graph without cycles, and the number of levels."""
    left, edges = cut(nodes.select("id").distinct()), cut(edges)
    rounds: list[DataFrame] = []
    while True:
        ready = cut(left.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(len(rounds))))
        if ready.isEmpty():
            break
        rounds.append(ready)
        gone = ready.select("id")
        left = cut(left.join(gone, "id", "left_anti"))
        edges = cut(edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti"))
    return (reduce(DataFrame.unionByName, rounds) if rounds else left.withColumn("level", F.lit(0))), len(rounds)


def _numbered(sizes: DataFrame, n: int) -> DataFrame:
    """component, size, block, place: each component's bit; blocks hold WORDS * 64 components at most, numbered within buckets, so no task numbers all."""
    buckets = -(-n // (64 * WORDS * 64))
    turn = Window.partitionBy("bucket").orderBy("component")
    rows = sizes.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).withColumn("row", F.row_number().over(turn) - 1)
    return rows.select("component", "size", (F.col("bucket") * 2**32 + F.floor(F.col("row") / (64 * WORDS))).alias("block"), (F.col("row") % (64 * WORDS)).alias("place"))


def _words(place, mark=None):
    """The columns of bits with a 1 at place."""
    one = F.expr(f"shiftleft(1L, CAST({place} % 64 AS INT))")
    return [F.when(F.floor(F.col(place) / 64) == i, one if mark is None else F.when(mark, one).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long").alias(b) for i, b in enumerate(_BITS)]


def ancestors(edges: DataFrame, nodes: DataFrame | None = None, enough: int | None = None) -> DataFrame:
    """id, n: how many other nodes reach each node of edges (src, dst) and of nodes (id).

    enough: a node that more than so many reach gives n null, and its ancestors are
    not kept: what comes after it has more than enough too.  Then rows grow with the
    edges; without it they grow with the pairs of components over WORDS * 64, at most.
    """
    members, dag = condense(edges, nodes)
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    bits = cut(_numbered(sizes, members.count()))
    level, depth = levels(sizes.select(F.col("component").alias("id")), dag)
    level = cut(level)
    at = lambda c, name: level.select(F.col("id").alias(c), F.col("level").alias(name))
    dag = cut(dag.join(at("src", "level"), "src").join(at("dst", "to"), "dst"))
    # the sizes of a block's components, a mask for each power of two in them
    top = bits.agg(F.coalesce(F.max("size"), F.lit(1))).first()[0].bit_length()
    planes = bits.select("block", "place", "size", F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("power"))
    planes = planes.where(F.expr("(shiftright(size, power) & 1) = 1")).select("block", "power", *_words("place"))
    planes = cut(planes.groupBy("block", "power").agg(*[F.bit_or(b).alias(f"p{b}") for b in _BITS]))
    counted = sum((F.bit_count(F.col(b).bitwiseAND(F.col(f"p{b}"))) for b in _BITS), F.lit(0))
    weight = F.sum(F.expr("shiftleft(1L, power)") * counted)
    spark = edges.sparkSession
    path = scratch(spark)
    out = []
    for i in range(depth):
        own = bits.join(level.where(F.col("level") == i).select(F.col("id").alias("component")), "component").select("component", "block", *_words("place"))
        rows = own.withColumn("full", F.lit(False))
        if i:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/to={i}"))
        sets = cut(rows.groupBy("component", "block").agg(*[F.bit_or(b).alias(b) for b in _BITS], F.bool_or("full").alias("full")))
        n = sets.join(planes, "block", "left").groupBy("component").agg(F.coalesce(weight, F.lit(0)).alias("n"), F.bool_or("full").alias("full"))
        if enough is not None:
            n = n.select("component", F.when(~F.col("full") & (F.col("n") - 1 <= enough), F.col("n")).alias("n"))
        n = cut(n.select("component", "n"))
        out.append(n)
        onward = dag.where(F.col("level") == i).select(F.col("src").alias("component"), "dst", "to")
        sent = sets.where("NOT full").join(n.where("n IS NOT NULL").select("component"), "component", "left_semi").join(onward, "component").select(F.col("dst").alias("component"), "block", *_BITS, "full", "to")
        sent = sent.groupBy("component", "block", "to").agg(*[F.bit_or(b).alias(b) for b in _BITS], F.bool_or("full").alias("full"))
        full = n.where("n IS NULL").select("component").join(onward, "component").select(F.col("dst").alias("component"), "to").distinct()
        full = full.select("component", F.lit(-1).cast("long").alias("block"), *[F.lit(0).cast("long").alias(b) for b in _BITS], F.lit(True).alias("full"), "to")
        # each level finds what was sent to it in a folder of its own
        both = sent.unionByName(full) if enough is not None else sent
        both.select("component", "block", *_BITS, "full", "to").write.mode("append").partitionBy("to").parquet(path)
        drop(sets)
    per = reduce(DataFrame.unionByName, out) if out else sizes.select("component", F.lit(0).cast("long").alias("n"))
    return members.join(per, "component").select("id", (F.col("n") - 1).alias("n"))
