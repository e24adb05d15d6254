"""Counts of ancestors, cycles and levels against plain loops on random graphs."""

import random

import pytest

from graphloom.operators import reachability, traversal


def reached(n, edges):
    """The nodes that reach each node, by plain search."""
    before = {v: set() for v in range(n)}
    for a, b in edges:
        before[b].add(a)
    out = {}
    for v in range(n):
        seen, todo = {v}, [v]
        while todo:
            for u in before[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        out[v] = seen
    return out


def graph(kind):
    rng = random.Random(kind)
    if kind == "sparse":
        return 120, {(rng.randrange(120), rng.randrange(120)) for _ in range(130)}
    if kind == "large cycle":
        ring = [(i, (i + 1) % 60) for i in range(60)]
        return 150, set(ring) | {(rng.randrange(60, 150), rng.randrange(60, 150)) for _ in range(50)} | {(rng.randrange(150), rng.randrange(150)) for _ in range(9)}
    if kind == "cycles in a row":
        return 45, {(i, i - i % 9 + (i + 1) % 9) for i in range(36)} | {(9 * k + 3, 9 * k + 12) for k in range(3)} | {(5, 32), (5, 5), (40, 41), (41, 42), (42, 40), (6, 43), (43, 6)}
    if kind == "dense":
        return 40, {(rng.randrange(40), rng.randrange(40)) for _ in range(300)}
    return 40, {(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.1}  # no cycle


KINDS = ("large cycle", "cycles in a row")


def table(spark, edges):
    return spark.createDataFrame(sorted(edges), "src long, dst long")


@pytest.mark.parametrize("kind", KINDS)
def test_counts_cycles_and_levels(spark, monkeypatch, kind):
    monkeypatch.setattr(reachability, "WORDS", 1)
    monkeypatch.setattr(reachability, "_BITS", ["b0"])
    n, edges = graph(kind)
    want = reached(n, edges)
    nodes = spark.range(n)
    got = {r.id: r.n for r in reachability.ancestors(table(spark, edges), nodes).collect()}
    assert got == {v: len(s) - 1 for v, s in want.items()}
    members, dag = reachability.condense(table(spark, edges), nodes)
    of = {r.id: r.component for r in members.collect()}
    assert all((of[a] == of[b]) == (a in want[b] and b in want[a]) for a in range(n) for b in range(n))
    assert {(r.src, r.dst) for r in dag.collect()} == {(of[a], of[b]) for a, b in edges if of[a] != of[b]}


@pytest.mark.parametrize("kind, enough", [("sparse", 6)])
def test_enough_is_enough(spark, kind, enough):
    n, edges = graph(kind)
    want = {v: len(s) - 1 for v, s in reached(n, edges).items()}
    got = {r.id: r.n for r in reachability.ancestors(table(spark, edges), spark.range(n), enough).collect()}
    assert got == {v: k if k <= enough else None for v, k in want.items()}


def test_callers_of_roots(spark):
    n, edges = graph("sparse")
    want = reached(n, edges)
    kinds = table(spark, edges).selectExpr("src", "dst", "'calls' AS kind").union(spark.sql("SELECT 1L, 2L, 'imports'"))
    got = {r.id: r.callers for r in traversal.count_callers(kinds, spark.range(500)).collect()}
    assert got == {v: len(want[v]) - 1 if v < n else 0 for v in range(500)}
    assert reachability.ancestors(table(spark, edges).limit(0)).count() == 0
