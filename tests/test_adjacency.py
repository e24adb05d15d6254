"""Edges bucketed by the node they leave: what rounds read and move, and what they find."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import traversal
from graphloom.plans import adjacency
from graphloom.plans.lineage import cut


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(1)
    rows = {(rng.randrange(300), rng.randrange(300)) for _ in range(900)}
    return sorted(rows), cut(spark.createDataFrame([(a, b, "calls") for a, b in rows] * 2, "src long, dst long, kind string"))


def scanned(df, column):
    """Rows that scans of a table with this column gave in df's run."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        x = todo.pop()
        while x.nodeName().startswith("AdaptiveSparkPlan") or "QueryStage" in x.nodeName():
            x = x.plan() if "QueryStage" in x.nodeName() else x.executedPlan()
        if x.nodeName().startswith("Scan") and column in x.output().toString():
            rows += x.metrics().get("numOutputRows").get().value()
        todo += [x.children().apply(i) for i in range(x.children().size())]
    return rows


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_stay_where_they_are(spark, edges, monkeypatch):
    steps = traversal.steps_of(edges[1])
    assert sorted((r["at"], r["to"]) for r in steps.table.collect()) == edges[0]  # equal ones once
    # a few nodes: their buckets only
    few = cut(spark.createDataFrame([(1,)], "id long"))
    assert "Exchange hashpartitioning" not in plan(steps.around(few))
    assert 0 < scanned(steps.around(few), "at#") < len(edges[0]) / 2
    # many: the frontier alone is dealt into the buckets
    monkeypatch.setattr(adjacency, "FEW", 0)
    monkeypatch.setattr(adjacency, "BROADCAST_BYTES", 0)
    many = cut(spark.range(300))
    near = steps.around(many)
    text = plan(near).split("Initial Plan")[0]
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 1
    assert "Bucketed: true" in text
    assert sorted((r["id"], r["to"]) for r in near.collect()) == edges[0]
    # and so with a limit of time in between: a round's rows follow its frontier
    monkeypatch.undo()
    assert sorted(r["to"] for r in steps.around(few).collect()) == sorted(b for a, b in edges[0] if a == 1)
    assert steps.around(few.limit(0)).count() == 0
    steps.drop()
    assert not spark.catalog.tableExists(steps.name)


@pytest.mark.parametrize("few", [0, 20, 1000])
def test_rounds_find_what_a_search_finds(spark, edges, monkeypatch, few):
    monkeypatch.setattr(adjacency, "FEW", few)
    after = {}
    for a, b in edges[0]:
        after.setdefault(a, set()).add(b)
    want = set()
    for root in (3, 77, 1000):
        depth, frontier, level = {root: 0}, {root}, 0
        while frontier:
            level += 1
            frontier = {b for a in frontier for b in after.get(a, ())} - set(depth)
            depth |= dict.fromkeys(frontier, level)
        want |= {(root, v, d) for v, d in depth.items()}
    roots = spark.createDataFrame([(3, 3), (77, 77), (1000, 1000)], "root long, id long")
    steps = traversal.steps_of(edges[1])
    for what in (edges[1], steps):  # written steps serve any number of traversals
        assert {tuple(r) for r in traversal.reach(what, roots).collect()} == want
    assert {tuple(r) for r in traversal.reach(steps, roots, 2).collect()} == {r for r in want if r[2] <= 2}
    assert spark.catalog.tableExists(steps.name)


def test_long_ways_back(spark):
    line = spark.range(150).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("calls").alias("kind"))
    steps = traversal.steps_of(line.where("src < 12"), "both")
    assert traversal.reach(steps, spark.createDataFrame([(0, 0)], "root int, id long")).count() == 13
    got = traversal.shortest_path(line.where("src < 9").union(spark.sql("SELECT 9L, 4L, 'calls'")), 8, 2).orderBy("hop").collect()
    assert [(r["hop"], r["id"], r["forward"]) for r in got] == [(0, 8, None), (1, 9, True), (2, 4, True), (3, 3, False), (4, 2, False)]
