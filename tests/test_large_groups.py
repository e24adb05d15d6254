"""Work of operators where one file, scope or block of nodes has most rows: rows of joins stay near the rows read."""

from __future__ import annotations

import random

from graphloom.operators import flow, lookups, overlap, traversal
from graphloom.plans.lineage import cut


def joined(df) -> tuple[list, int]:
    """The rows of df and how many rows its joins made."""
    rows = df.collect()

    def walk(plan) -> int:
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        made = plan.metrics().get("numOutputRows") if "Join" in plan.nodeName() else None
        children = plan.children()
        return (made.get().value() if made is not None and made.isDefined() else 0) + sum(walk(children.apply(i)) for i in range(children.size()))

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_enclosing_of_many_overlapping_nodes(spark):
    dice = random.Random(3)
    nodes = [(i, dice.randrange(500), "function", f"f{i % 2}", a := dice.randrange(-50, 400), a + dice.randrange(200)) for i in range(1500)]
    nodes += [(5000, 1, "class", "f0", -1000, 9000), (5001, 0, "variable", "f0", 0, 3), (5002, 0, "function", None, 0, 900), (5003, 2, "function", "f1", 7, None)]
    points = [(i, f"f{i % 3}", dice.randrange(-60, 640)) for i in range(1500)] + [(9000, None, 5), (9001, "f0", None), (9002, "f0", 9001)]
    df = lookups.enclosing(spark.createDataFrame(points, "point long, file_path string, line int"), spark.createDataFrame(nodes, "id long, ord long, kind string, file_path string, start_line int, end_line int"))
    assert df.columns == ["point", "file_path", "line", "symbol_id"]
    rows, made = joined(df)
    want = {}
    for p, f, n in points:
        around = [(e - s, o, i) for i, o, k, g, s, e in nodes if f and n is not None and k != "variable" and g == f and e is not None and s <= n <= e]
        want[p] = min(around)[:2] if around else None
    known = {i: (e - s, o) for i, o, _, _, s, e in nodes if e is not None}
    assert {r["point"]: known.get(r["symbol_id"]) for r in rows} == want
    assert made < 20 * len(points)  # a join of points with the nodes around them makes hundreds for each


def test_type_environment_of_large_scopes(spark):
    dice = random.Random(4)
    kinds = ["string", "number", None, "array"]
    said = [(dice.choice(["a", "a.K", "a.K.m", None]), dice.choice(["x", "y", None]), o if o % 50 else None, kinds[dice.randrange(4)]) for o in range(1200)]
    uses = [(o, dice.choice(["a", "a.K", "a.K.m", "a.L.n", "b", None]), dice.choice(["x", "y", "z", None]), o if o % 90 else None) for o in range(1200)]
    df = flow.type_environment(spark.createDataFrame(said, "scope string, name string, ord long, type string"), spark.createDataFrame(uses, "use long, scope string, name string, ord long"))
    assert df.columns == ["use", "scope", "name", "ord", "type"]
    rows, made = joined(df)

    def of(scope, name, at):
        parts = (scope or "").split(".")
        for n in range(len(parts), 0, -1):
            here, own = ".".join(parts[:n]), n == len(parts)
            hits = [(o is not None, o or 0, t) for s, x, o, t in said if s == here and x == name and None not in (s, x, t) and (not own or (o is not None and at is not None and o < at))]
            if hits:
                return max(hits)[2]
        return None

    assert {r["use"]: r["type"] for r in rows} == {u: of(s, n, o) if n else None for u, s, n, o in uses}
    assert made < 3 * len(uses)  # each use met hundreds of assignments


def test_tiles_of_pairs_are_not_broadcast(spark):
    """Repeated tiles grow with the square of the tiles; their estimate does not."""
    rows = spark.createDataFrame([(i, i % 7) for i in range(700)], "group long, v long")
    df = overlap.pairs_of(rows, ["v"])
    got = df.collect()
    assert len(got) == 700 * 699 // 2 and all(r["a"] < r["b"] and r["v_a"] == r["a"] % 7 and r["v_b"] == r["b"] % 7 for r in got)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_processes_keep_the_first_steps_of_a_round(spark, monkeypatch):
    """A round of many discoveries writes the steps that are left, no path of each."""
    edges = [(0, i, "calls", i) for i in range(1, 41)] + [(i, 100 * i + j, "calls", j) for i in range(1, 41) for j in range(40)]
    written = []
    monkeypatch.setattr(traversal, "cut", lambda df: written.append(out := cut(df)) or out)
    frame = spark.createDataFrame(edges, "src long, dst long, kind string, ord long")
    got = traversal.processes(frame, spark.createDataFrame([(0,), (4000,)], "entry long").toDF("id"), 60).orderBy("entry", "step").collect()
    assert [r["id"] for r in got] == [0, *range(1, 41), *range(100, 119)] and [r["step"] for r in got] == list(range(60))
    assert max(df.count() for df in written) <= 60 and not any("array" in kind for df in written for _, kind in df.dtypes)


def test_label_propagation_looks_at_what_is_near_a_change(spark, monkeypatch):
    """Once labels settle, rounds read edges near changes alone; the result is that of full rounds."""
    dice = random.Random(6)
    edges = [(100 * c + dice.randrange(30), 100 * c + dice.randrange(30), 1.0 + dice.randrange(2)) for c in range(8) for _ in range(90)] + [(100 * c, 100 * c + 100, 1.0) for c in range(7)]
    asked = []
    around = flow.Adjacency.around
    monkeypatch.setattr(flow.Adjacency, "around", lambda self, frontier, n=None: asked.append(frontier.count()) or around(self, frontier, n))
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {r["id"]: r["community"] for r in flow.label_propagation(frame).collect()}
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
    odd = {r["id"]: r["h"] for r in spark.createDataFrame([(i,) for i in near], "id long").selectExpr("id", "pmod(xxhash64(id), 2) AS h").collect()}
    want, still = {i: i for i in near}, 0
    for r in range(50):
        new = dict(want)
        for i in near:
            votes: dict = {}
            for j, w in near[i].items():
                votes[want[j]] = votes.get(want[j], 0) + w
            best = max(votes, key=lambda c: (votes[c], -c))
            if odd[i] == r % 2 and votes.get(want[i], 0) < votes[best]:
                new[i] = best
        still, want = still + 1 if new == want else 0, new
        if still == 2:
            break
    assert got == want and asked and min(asked) < len(near) // 4
