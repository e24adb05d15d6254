"""Graphs of many functions, each small, worked function by function: many functions share a task.

Nodes and edges carry fn, the function they belong to.  A function of more than LARGE rows
is not taken into one task's memory: it goes to the joins that the caller gives for it.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Nodes and edges of a function that a task takes; rows that share a task.
LARGE, TASK_ROWS = 20_000, 50_000


def solved(nodes: DataFrame, edges: DataFrame, solve: Callable[[list, list], Iterable[tuple]], schema: str, by_joins: Callable[[DataFrame, DataFrame], DataFrame], large: int | None = None) -> DataFrame:
    """Rows of schema that solve(nodes, edges) gives for every function, as lists of named tuples, after its fn; by_joins for large ones."""
    large = LARGE if large is None else large
    nodes, edges = cut(nodes), cut(edges)
    sizes = nodes.select("fn").union(edges.select("fn")).groupBy("fn").agg(F.count("*").alias("rows"))
    facts = sizes.agg(F.sum("rows").alias("rows"), F.count_if(F.col("rows") > large).alias("large")).first()
    outside = None
    if facts["large"]:
        much = cut(sizes.where(F.col("rows") > large).select("fn"))
        outside = by_joins(nodes.join(much, "fn", "left_semi"), edges.join(much, "fn", "left_semi"))
        nodes, edges = nodes.join(much, "fn", "left_anti"), edges.join(much, "fn", "left_anti")
    tasks = max(1, (facts["rows"] or 0) // TASK_ROWS)
    names = [x.split()[0] for x in schema.split(", ")]
    task = F.pmod(F.xxhash64("fn"), F.lit(tasks)).alias("task")

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        own, ways = defaultdict(list), defaultdict(list)
        for row in n.drop(columns="task").itertuples(index=False):
            own[row.fn].append(row)
        for row in e.drop(columns="task").itertuples(index=False):
            ways[row.fn].append(row)
        return pd.DataFrame([(fn, *row) for fn in own for row in solve(own[fn], ways[fn])], columns=names)

    kept = [c for c in nodes.columns if c != "task"], [c for c in edges.columns if c != "task"]
    inside = nodes.select(*kept[0], task).groupBy("task").cogroup(edges.select(*kept[1], task).groupBy("task")).applyInPandas(run, schema)
    return inside if outside is None else inside.unionByName(outside.select(*names))


def following(edges: list) -> dict:
    """The targets of each node, in the order of edges, once each."""
    out: dict = defaultdict(dict)
    for e in edges:
        out[e.src][e.dst] = e
    return out


def within(start, ways: dict, most: int | None = None) -> Iterator[tuple]:
    """(node, depth) of all that start reaches, itself first, breadth first and fewer than most steps away."""
    seen, queue = {start}, deque([(start, 0)])
    while queue:
        at, depth = queue.popleft()
        yield at, depth
        if most is not None and depth + 1 >= most:
            continue
        for to in ways.get(at, ()):
            if to not in seen:
                seen.add(to)
                queue.append((to, depth + 1))
