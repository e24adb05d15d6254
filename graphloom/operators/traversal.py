"""Breadth-first traversals as loops of joins; every round's new nodes are written.

Edges are written once, bucketed by the node they leave (plans.adjacency), so a round moves
its frontier only and reads the buckets that have its nodes.  Only whether a round found
anything, and the nodes of small frontiers, reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.adjacency import Adjacency
from ..plans.lineage import cut
from .reachability import ancestors


def directed(edges: DataFrame, direction: str = "forward") -> DataFrame:
    """at, to, kind, forward (true where the edge runs that way): edges as they are followed."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind", F.lit(True).alias("forward"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "kind", F.lit(False).alias("forward"))
    return {"forward": out, "backward": back, "both": out.unionByName(back)}[direction]


def steps_of(edges: DataFrame, direction: str = "forward", kinds: tuple[str, ...] | None = None) -> Adjacency:
    """at, to: edges of these kinds, written for the rounds of reach()."""
    some = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    return Adjacency(directed(some, direction).select("at", "to"))


def reach(edges: DataFrame | Adjacency, roots: DataFrame, depth: int | None = None, direction: str = "forward", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """root, id, depth for every node that roots (root, id) reach, themselves included at depth 0.

    depth None: until nothing new is found.  Cycles and parallel edges are harmless.  Edges
    may be those that steps_of() has written; direction and kinds are then its own.
    """
    steps = edges if isinstance(edges, Adjacency) else steps_of(edges, direction, kinds)
    frontier = cut(roots.select("root", "id").distinct().withColumn("depth", F.lit(0)))
    rounds = [frontier]
    n, level = frontier.count(), 0
    while n and (depth is None or level < depth):
        level += 1
        seen = reduce(DataFrame.unionByName, rounds).select("root", "id")
        new = steps.around(frontier.select("root", "id"), n).select("root", F.col("to").alias("id")).distinct()
        frontier = cut(new.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(level)))
        n = frontier.count()
        rounds.append(frontier)
    if steps is not edges:
        steps.drop()
    return reduce(DataFrame.unionByName, rounds)


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """What a change of seeds (id) reaches: id and depth, over reversed calls, imports and data flow."""
    found = reach(edges, seeds.select(F.lit(0).alias("root"), "id"), depth, "backward", ("calls", "imports", "data_flow"))
    return found.select("id", "depth")


def transitive_callers(edges: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """root, id, depth of the callers at distance 1 to max_depth - 1; roots (id)."""
    found = reach(edges, roots.select(F.col("id").alias("root"), "id"), max_depth - 1, "backward", ("calls",))
    return found.where("depth > 0 AND id <> root")


def count_callers(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id and the number of its direct and indirect callers, itself not counted; cycles are condensed, and no row is made for each caller of each root."""
    calls = edges.where("kind = 'calls'").select("src", "dst")
    return ancestors(calls, roots).join(roots.select("id").distinct(), "id", "left_semi").select("id", F.col("n").alias("callers"))


def blast_buckets(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id and the bucket of its number of callers; callers are no longer told apart where there are more than 100, the top bucket."""
    n = ancestors(edges.where("kind = 'calls'").select("src", "dst"), roots, enough=100).join(roots.select("id").distinct(), "id", "left_semi")
    bucket = F.when(F.col("n").isNull(), 10).when(F.col("n") > 50, 8).when(F.col("n") > 20, 6).when(F.col("n") > 5, 4).when(F.col("n") > 0, 2).otherwise(0)
    return n.select("id", bucket.alias("blast"))


def context(edges: DataFrame, seed, depth: int = 2) -> DataFrame:
    """id, depth and relation of the first discovery: outgoing before incoming, then the edge's order.

    edges: src, dst, kind, ord.  Discoveries come in the order of a queue: by the position
    of the node they were made from.
    """
    spark = edges.sparkSession
    steps = cut(
        edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("kind").alias("relation"), F.lit(0).alias("way"), "ord").unionByName(
            edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.concat(F.lit("inverse_"), "kind").alias("relation"), F.lit(1).alias("way"), "ord")
        )
    )
    frontier = cut(spark.createDataFrame([(seed, 0, "self", [0])], "id long, depth int, relation string, place array<long>"))
    rounds = [frontier]
    for level in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, rounds).select("id")
        made = frontier.join(steps, frontier["id"] == steps["at"])
        # the path of places orders discoveries as the queue does
        place = F.concat("place", F.array(F.col("way").cast("long"), F.col("ord").cast("long")))
        new = made.select(F.col("to").alias("id"), steps["relation"], place.alias("place")).join(seen, "id", "left_anti")
        new = new.groupBy("id").agg(F.min(F.struct("place", "relation")).alias("first"))
        new = cut(new.select("id", F.lit(level).alias("depth"), "first.relation", "first.place"))
        if new.isEmpty():
            break
        rounds.append(new)
        frontier = new
    return reduce(DataFrame.unionByName, rounds).select("id", "depth", "relation")


def trace(edges: DataFrame, seeds: DataFrame, depth: int = 5, direction: str = "forward", kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (id, depth) to one step beyond depth, the edges followed (src, dst, kind), and whether it fell back to both directions.

    depth is held to 1 to 10 (0 means 5).  If a trace in one direction follows no edge, it
    is made in both.
    """
    depth = min(10, max(1, depth or 5))
    nodes = cut(reach(edges, seeds.select(F.lit(0).alias("root"), "id"), depth + 1, direction, kinds).select("id", "depth"))
    some = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    steps = directed(some, direction)
    used = steps.join(nodes.where(F.col("depth") <= depth).select(F.col("id").alias("at")), "at")
    found = used.select(F.when(F.col("forward"), F.col("at")).otherwise(F.col("to")).alias("src"), F.when(F.col("forward"), F.col("to")).otherwise(F.col("at")).alias("dst"), "kind").distinct()
    if direction != "both" and found.isEmpty():
        nodes, found, _ = trace(edges, seeds, depth, "both", kinds)
        return nodes, found, True
    return nodes, found, False


def shortest_path(edges: DataFrame, start, goal) -> DataFrame:
    """hop, id, forward of a shortest undirected path from start to goal; ties to the lesser id at each step back. Empty if there is none.

    forward: whether an edge runs from the node before to this one; null at the start.
    """
    spark = edges.sparkSession
    steps = Adjacency(directed(edges, "both").groupBy("at", "to").agg(F.bool_or("forward").alias("forward")))
    found = cut(reach(steps, spark.createDataFrame([(0, start)], "root int, id long")).select("id", "depth"))
    end = found.where(F.col("id") == goal).first()
    if end is None:
        return spark.createDataFrame([], "hop int, id long, forward boolean")
    # each node's least node before it, and its edge's way; then pointers are doubled back from the goal
    at = lambda c, depth: found.select(F.col("id").alias(c), F.col("depth").alias(depth))
    before = steps.table.join(at("to", "hop"), "to").join(at("at", "from"), "at").where("from = hop - 1")
    first = cut(before.groupBy(F.col("to").alias("id")).agg(F.min(F.struct("at", "forward")).alias("b")).select("id", F.col("b.at").alias("back"), F.col("b.forward").alias("forward")))
    jump, path = first.select("id", "back"), found.where(F.col("id") == goal).select("id")
    for _ in range(int(end["depth"]).bit_length()):
        path = cut(path.union(path.join(jump, "id").select("back")).distinct())
        jump = cut(jump.join(jump.select(F.col("id").alias("back"), F.col("back").alias("further")), "back").select("id", F.col("further").alias("back")))
    return path.join(found, "id").join(first, "id", "left").select(F.col("depth").alias("hop"), "id", "forward")


def flow_paths(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """root, path: from each root's seed over data flow to every node without a way on; seeds: root, id; edges: src, dst, kind, ord.

    A node is on one path only, that of its first discovery in the order of a queue.
    """
    steps = Adjacency(edges.where("kind = 'data_flow'").select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("ord").cast("long").alias("ord")))
    frontier = cut(seeds.select("root", "id", F.array("id").alias("path"), F.array(F.lit(0).cast("long")).alias("place")))
    rounds = [frontier]
    for _ in range(depth):
        seen = reduce(DataFrame.unionByName, rounds).select("root", "id")
        new = steps.around(frontier).select("root", F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"), F.concat("place", F.array("ord")).alias("place"))
        new = new.join(seen, ["root", "id"], "left_anti").groupBy("root", "id").agg(F.min(F.struct("place", "path")).alias("first"))
        new = cut(new.select("root", "id", "first.path", "first.place"))
        if new.isEmpty():
            break
        rounds.append(new)
        frontier = new
    return reduce(DataFrame.unionByName, rounds).join(steps.table.select(F.col("at").alias("id")).distinct(), "id", "left_anti").select("root", "path")


def test_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """test, prod, link, via: direct calls from tests, and one call further; nodes: id, is_test. One row per test, link and prod."""
    calls = edges.where("kind = 'calls'").select("src", "dst").distinct()
    test, prod = nodes.where("is_test").select("id"), nodes.where("NOT is_test").select("id")
    direct = calls.join(test.select(F.col("id").alias("src")), "src").join(prod.select(F.col("id").alias("dst")), "dst")
    nxt = calls.select(F.col("src").alias("via"), F.col("dst").alias("prod")).join(prod.select(F.col("id").alias("prod")), "prod")
    far = direct.join(nxt, F.col("dst") == F.col("via")).select(F.col("src").alias("test"), "prod", "via").groupBy("test", "prod").agg(F.min("via").alias("via"))
    first = direct.select(F.col("src").alias("test"), F.col("dst").alias("prod"), F.lit("direct").alias("link"), F.lit(None).cast("long").alias("via"))
    return first.unionByName(far.select("test", "prod", F.lit("transitive").alias("link"), "via"))


def test_impact(links: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """test and reason (direct, transitive) for changed (id) nodes: their own links, then those of their direct callers; changed nodes without links are gaps and expand no further."""
    own = links.join(changed.select(F.col("id").alias("prod")), "prod").select("test", F.lit(0).alias("rank"), F.col("link").alias("reason"))
    covered = links.select(F.col("prod").alias("id")).distinct()
    calls = edges.where("kind = 'calls'").select("src", "dst").distinct()
    callers = calls.join(changed.join(covered, "id", "left_semi").select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("prod")).distinct()
    more = links.join(callers, "prod").select("test", F.lit(1).alias("rank"), F.lit("transitive").alias("reason"))
    return own.unionByName(more).groupBy("test").agg(F.min(F.struct("rank", "reason")).alias("best")).select("test", F.col("best.reason").alias("reason"))


def processes(edges: DataFrame, entries: DataFrame, max_steps: int = 100, max_depth: int = 20) -> DataFrame:
    """entry, step, id, depth, is_branch: what each entry (id) leads to, calls before data flow, in the order of a queue.

    edges: src, dst, kind, ord.  Visited nodes are not taken again; processes of one step are left out.
    What follows a node comes in the order of that node's step, so a row keeps no path; of a
    round only the steps up to max_steps are kept.
    """
    way = F.when(F.col("kind") == "calls", 0).otherwise(1).cast("long")
    steps = Adjacency(edges.where("kind IN ('calls', 'data_flow')").select(F.col("src").alias("at"), "dst", way.alias("way"), F.col("ord").cast("long").alias("ord")))
    # n: steps of the entry so far
    frontier = cut(entries.select(F.col("id").alias("entry"), "id", F.lit(0).alias("depth"), F.lit(0).alias("step"), F.lit(1).alias("n")).distinct())
    rounds = [frontier]
    of_entry, turn = Window.partitionBy("entry"), Window.partitionBy("entry").orderBy("place", "id")
    for level in range(1, max_depth + 1):
        open_ = cut(frontier.where(F.col("n") < max_steps).drop("depth"))
        seen = reduce(DataFrame.unionByName, rounds).where(F.col("n") < max_steps).select("entry", "id")
        new = steps.around(open_).select("entry", F.col("dst").alias("id"), F.struct("step", "way", "ord").alias("place"), "n")
        new = new.groupBy("entry", "id").agg(F.min("place").alias("place"), F.max("n").alias("n")).join(seen, ["entry", "id"], "left_anti")
        new = new.withColumns({"step": F.col("n") + F.row_number().over(turn) - 1, "n": F.least(F.col("n") + F.count("*").over(of_entry).cast("int"), F.lit(max_steps))})
        new = cut(new.where(F.col("step") < max_steps).select("entry", "id", F.lit(level).alias("depth"), "step", "n"))
        if new.isEmpty():
            break
        rounds.append(new)
        frontier = new
    if len(rounds) > 1:  # entries alone are no processes
        rounds[0] = rounds[0].join(rounds[1].where("step = 1").select("entry"), "entry", "left_semi")
    found = reduce(DataFrame.unionByName, rounds if len(rounds) > 1 else [rounds[0].limit(0)])
    fan = steps.table.where("way = 0").groupBy(F.col("at").alias("id")).agg((F.count("*") > 1).alias("is_branch"))
    return found.join(fan, "id", "left").select("entry", "step", "id", "depth", F.coalesce("is_branch", F.lit(False)).alias("is_branch"))
