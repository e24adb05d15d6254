"""Operators against plain versions on random graphs, and functions too large for a task against the others."""

from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions import rules
from graphloom.operators import branches, control, flow, lookups, metrics, text, traversal, views
from graphloom.sources import files, git, python_ast
from graphloom.streaming import runtime


@pytest.fixture(scope="module")
def functions():
    """(nodes, edges) of 12 functions: fn, id, ord, flags; and fn, src, dst."""
    rng = np.random.default_rng(3)
    nodes, edges = [], []
    for fn in range(12):
        n = int(rng.integers(2, 14))
        for k in range(n):
            nodes.append((fn, fn * 100 + k, k, *(bool(x) for x in rng.random(4) < 0.3)))
        for _ in range(int(n * 1.7)):
            a, b = rng.integers(0, n, 2)
            if a != b:
                edges.append((fn, fn * 100 + int(a), fn * 100 + int(b)))
    return nodes, sorted(set(edges))


@pytest.fixture(scope="module")
def frames(spark, functions):
    nodes, edges = functions
    return spark.createDataFrame(nodes, "fn long, id long, ord long, is_def boolean, is_source boolean, is_sink boolean, is_sanitizer boolean"), spark.createDataFrame(edges, "fn long, src long, dst long")


def ways(edges):
    out = defaultdict(list)
    for _, a, b in edges:
        out[a].append(b)
    return out


def depths(start, to, most=10**9):
    seen, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for x in to[at] if seen[at] + 1 < most else ():
            if x not in seen:
                seen[x] = seen[at] + 1
                queue.append(x)
    return seen


LARGE = pytest.mark.parametrize("large", [None, 0])  # 0: every function is worked by joins


@LARGE
def test_reaching_and_traces(frames, functions, large):
    nodes, edges = functions
    to = ways(edges)
    want = Counter((n[0], n[1], x) for n in nodes if n[3] for x in depths(n[1], to))
    assert Counter(map(tuple, flow.reaching(*frames, large=large).collect())) == want
    starts = frames[0].where("is_source").select(F.col("id").alias("root"), "fn", "id")
    got = Counter((r["root"], r["id"], r["depth"]) for r in flow.trace_value(frames[1], starts, 4, large).collect())
    assert got == Counter((n[1], x, d) for n in nodes if n[4] for x, d in depths(n[1], to, 4).items())


@LARGE
def test_taint_takes_the_first_arrival(frames, functions, large):
    nodes, edges = functions
    to, known, want = ways(edges), {n[1]: n for n in nodes}, Counter()
    for n in (n for n in nodes if n[4]):
        queue, seen = deque([(n[1], False, 1)]), {n[1]}
        while queue:
            at, safe, length = queue.popleft()
            if at != n[1] and known[at][5]:
                want[n[0], n[1], at, safe, length] += 1
                continue
            for x in sorted(to[at]):
                if x not in seen:
                    seen.add(x)
                    queue.append((x, safe or known[x][6], length + 1))
    got = flow.taint(*frames, large=large).collect()
    assert Counter((r["fn"], r["source"], r["sink"], r["sanitized"], r["length"]) for r in got) == want
    assert all(r["severity"] == ("critical" if not r["sanitized"] else "warning" if r["length"] > 5 else "info") for r in got)


@LARGE
def test_control_flow(frames, functions, large, spark):
    nodes, edges = functions
    to = ways(edges)
    entries = frames[0].where("ord = 0").select("fn", F.col("id").alias("block"))
    got = {(r["fn"], r["block"]): r["depth"] for r in control.block_depths(frames[1], entries, frames[0].where("is_def").select("fn", F.col("id").alias("block")), large).collect()}
    defs = {n[1] for n in nodes if n[3]}
    for fn in range(12):
        level, seen = {fn * 100: 0}, {}
        while level:
            seen |= level
            new = {}
            for at, d in level.items():
                for x in to[at]:
                    if x not in seen:
                        new[x] = min(new.get(x, 99), d + (at in defs))
            level = new
        assert {b: d for (f, b), d in got.items() if f == fn} == seen
    few = [e for e in edges if e[0] in (1, 4)]
    ends = [(fn, fn * 100, max(n[1] for n in nodes if n[0] == fn)) for fn in (1, 4)]

    def paths(at, goal, path):
        if at == goal:
            yield path
            return
        for x in ways(few)[at]:
            if x not in path:
                yield from paths(x, goal, [*path, x])

    want = {(fn, tuple(p)) for fn, a, b in ends for p in paths(a, b, [a])}
    rows = control.simple_paths(spark.createDataFrame(few, "fn long, src long, dst long"), spark.createDataFrame(ends, "fn long, entry long, exit long"), 10_000, large).collect()
    assert {(r["fn"], tuple(r["path"])) for r in rows} == want and len(rows) == len(want)


@LARGE
def test_param_flows(frames, functions, large):
    nodes, edges = functions
    to = ways(edges)
    marked = frames[1].withColumn("transform", F.when(F.col("dst") % 3 == 0, "escapeHtml").when(F.col("dst") % 3 == 1, "trim"))
    got = {(r["param"], r["id"]): r["sanitized"] for r in control.param_flows(marked, frames[0].where("ord = 0"), large).collect()}
    want = {}
    for start in (n[1] for n in nodes if n[2] == 0):
        level, seen = {start: False}, {}
        while level:
            seen |= level
            new = {}
            for at, safe in level.items():
                for x in to[at]:
                    if x not in seen:
                        new[x] = new.get(x, False) or safe or x % 3 == 0
            level = new
        want |= {(start, x): s for x, s in seen.items() if x != start}
    assert got == want


def test_loops(spark):
    edges = [(1, 0, 1, "next"), (1, 1, 2, "true"), (1, 2, 3, "true"), (1, 3, 2, "back"), (1, 2, 4, "false"), (1, 4, 1, "back"), (1, 1, 5, "false"), (2, 0, 1, "next")]
    edges = spark.createDataFrame(edges, "fn long, src long, dst long, kind string")
    blocks = spark.createDataFrame([(1, b, b == 0, b in (1, 2)) for b in range(6)] + [(2, 0, True, False), (2, 1, False, False)], "fn long, block long, is_entry boolean, is_header boolean")
    assert sorted((r["src"], r["dst"]) for r in control.back_edges(edges).collect()) == [(3, 2), (4, 1)]
    nesting = {(r["fn"], r["block"]): r["nesting"] for r in control.loop_nesting(edges, blocks).collect()}
    assert nesting == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 2, (1, 5): 1, (2, 0): 0, (2, 1): 0}


@pytest.fixture(scope="module")
def graph():
    rng = np.random.default_rng(9)
    return sorted({(int(a), int(b), "calls" if (a + b) % 3 else "imports") for a, b in rng.integers(0, 60, (170, 2)) if a != b})


def test_bootstrap_in_the_order_of_a_queue(spark, graph):
    frame = spark.createDataFrame([(*e, e[1]) for e in graph], "src long, dst long, kind string, ord long")
    seeds = spark.createDataFrame([(3, 0), (5, 1)], "id long, ord long")
    for depth, most in ((4, 400), (2, 400), (4, 25)):
        out, seen, queue = [], {3, 5}, deque([(3, 0), (5, 0)])
        while queue and len(out) < most:
            at, d = queue.popleft()
            for a, b, kind in sorted((e for e in graph if e[0] == at), key=lambda e: e[1]):
                if len(out) < most:
                    out.append((a, b, kind))
                if d < depth and b not in seen:
                    seen.add(b)
                    queue.append((b, d + 1))
        got = runtime.bootstrap(frame, seeds, depth, most).collect()
        assert Counter((r["source"], r["target"], r["kind"]) for r in got) == Counter(out) and all(r["hit_count"] == 1 for r in got)


def test_bootstrap_never_lowers_what_was_observed(spark):
    key = "session_id long, kind string, source_key string, target_key string"
    stored = spark.createDataFrame([(1, "calls", "a", "b", "observed", 5, 10, 20), (1, "calls", "b", "c", "bootstrapped", 1, 10, 10)], f"{key}, source_type string, hit_count long, first_seen_ms long, last_seen_ms long")
    made = spark.createDataFrame([(1, "calls", "a", "b", 1), (1, "calls", "b", "c", 1), (1, "calls", "c", "d", 1)], f"{key}, hit_count long")
    got = {r["source_key"]: (r["source_type"], r["hit_count"], r["first_seen_ms"], r["last_seen_ms"]) for r in runtime.with_bootstrap(stored, made, 99).collect()}
    assert got == {"a": ("observed", 6, 10, 99), "b": ("bootstrapped", 2, 10, 99), "c": ("bootstrapped", 1, 99, 99)}


def test_processes_in_the_order_of_a_queue(spark, graph):
    frame = spark.createDataFrame([(*e, e[1]) for e in graph], "src long, dst long, kind string, ord long")
    calls = [(a, b) for a, b, k in graph if k == "calls"]
    got = defaultdict(dict)
    for r in traversal.processes(frame, spark.createDataFrame([(i,) for i in range(0, 60, 7)], "id long"), 20, 6).collect():
        got[r["entry"]][r["step"]] = (r["id"], r["depth"], r["is_branch"])
    for entry in range(0, 60, 7):
        order, seen = [(entry, 0)], {entry}
        for at, d in order:
            for b in sorted(b for a, b in calls if a == at) if d < 6 else ():
                if b not in seen:
                    seen.add(b)
                    order.append((b, d + 1))
        want = {k: (i, d, sum(a == i for a, _ in calls) > 1) for k, (i, d) in enumerate(order[:20])} if len(order) > 1 else {}
        assert got[entry] == want


def test_shortest_paths_say_which_way_edges_run(spark, graph):
    frame = spark.createDataFrame(graph, "src long, dst long, kind string")
    both = defaultdict(set)
    for a, b, _ in graph:
        both[a].add(b)
        both[b].add(a)
    for goal in (11, 40, 59):
        path = [tuple(r) for r in traversal.shortest_path(frame, 7, goal).orderBy("hop").collect()]
        if goal not in depths(7, both):
            assert path == []
            continue
        assert path[0] == (0, 7, None) and path[-1][1] == goal and len(path) - 1 == depths(7, both)[goal]
        for (_, a, _), (_, b, forward) in zip(path, path[1:], strict=False):
            assert b in both[a] and forward == any(e[:2] == (a, b) for e in graph)


def test_flow_paths_visit_a_node_once(spark):
    edges = spark.createDataFrame([(1, 2, "data_flow", 0), (1, 3, "data_flow", 1), (2, 4, "data_flow", 0), (3, 4, "data_flow", 0), (3, 5, "data_flow", 1), (4, 6, "calls", 0)], "src long, dst long, kind string, ord long")
    got = sorted(r["path"] for r in traversal.flow_paths(edges, spark.createDataFrame([(0, 1)], "root long, id long"), 5).collect())
    assert got == [[1, 2, 4], [1, 3, 5]]


def test_local_moving_as_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 30, (2, 60)), rng.integers(1, 3, 60), strict=True) if a != b]
    adjacent = {i: {} for i in range(30)}
    for a, b, w in edges:
        adjacent[a][b] = adjacent[a].get(b, 0) + w
        adjacent[b][a] = adjacent[b].get(a, 0) + w
    where = list(range(30))
    for _ in range(50):
        moved = False
        for i in range(30):
            weight = Counter()
            for j, w in adjacent[i].items():
                weight[where[j]] += w
            own = weight[where[i]]
            best = max(((w - own, -k, c) for k, (c, w) in enumerate(weight.items()) if c != where[i]), default=(0, 0, 0))
            if best[0] > 0:
                where[i], moved = best[2], True
        size = Counter(where)
        for i in range(30):
            if size[where[i]] < 2:
                near = [(size[where[j]], -k, where[j]) for k, j in enumerate(adjacent[i]) if size[where[j]] >= 2]
                if near:
                    size[where[i]] -= 1
                    where[i] = max(near)[2]
                    size[where[i]] += 1
        if not moved:
            break
    frame = spark.createDataFrame([(0, *e) for e in edges], "repo long, src long, dst long, weight double")
    nodes = spark.createDataFrame([(0, i, i) for i in range(30)], "repo long, id long, ord long")
    got = {r["id"]: r["community"] for r in flow.local_moving(frame, nodes).collect()}
    group = lambda of: sorted(sorted(i for i in range(30) if of(i) == c) for c in {of(i) for i in range(30)})
    assert group(got.get) == group(where.__getitem__)


def test_search_folds_accents_of_queries(spark):
    docs = spark.createDataFrame([(1, "café lounge", "x", "y"), (2, "cafe", "x", "y"), (3, "tea", "x", "y")], "node_id long, name string, qualified_name string, file_path string")
    for q in ("café", "CAFE"):
        assert sorted(r["node_id"] for r in text.bm25(docs, q).collect()) == [1, 2]
        assert sorted(r["node_id"] for r in text.match(docs, q).collect()) == [1, 2]
    assert text.bm25(docs, "cafe lounge").count() == 1 and text.bm25(docs, " ").count() == 0 and text.tfidf(docs, "!").count() == 0 and text.match(docs, "").count() == 0


def test_custom_rules(spark):
    own = rules.added(rules.LINES, (r"\bTODO\b", "unfinished", "low"))
    found = text.scan_lines(spark.createDataFrame([("a.ts", "x TODO y\neval(TODO)\nz")], "file_path string, content string"), own)
    assert sorted((r["line"], r["category"], r["severity"]) for r in found.collect()) == [(1, "unfinished", "low"), (2, "command_injection", "critical")]
    with pytest.raises(ValueError):
        rules.added(rules.LINES, (r"x", "y"))


def test_ignore_patterns(spark, tmp_path):
    for name in ("a.py", "node_modules/b.py", "src/c.min.js", "src/d.js", "target/e.py", "src/f.py", "src/gen/g.py", "src/gen/keep.py", "docs/h.py", "x/docs/i.py", "bin/Debug/j.py", "bin/k.py", "l.d.ts", "m.lock"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    (tmp_path / ".gitignore").write_text("# own\nsrc/gen/*\n!src/gen/keep.py\n/docs\n")
    names = lambda **o: sorted(r["file_path"].split(str(tmp_path) + "/")[1] for r in files.walk(spark, str(tmp_path), **o).select("file_path").collect())
    assert names() == ["a.py", "bin/k.py", "src/d.js", "src/f.py", "src/gen/keep.py", "x/docs/i.py"]
    assert names(respect_gitignore=False, extra=("*.js",)) == ["a.py", "bin/k.py", "docs/h.py", "src/f.py", "src/gen/g.py", "src/gen/keep.py", "x/docs/i.py"]
    assert names(most=2) == ["a.py", "bin/k.py"]


def test_walked_contents_and_branches(spark):
    rows = git.lines(spark.createDataFrame([(1, "* main 1234567 m\n  dev abcdef1 m\n  remotes/origin/dev abcdef1 m\n  remotes/origin/HEAD -> origin/main"), (2, "* dev 1234567 m\n  master 1234567 m")], "source long, text string"))
    found = git.parse_branches(rows)
    assert sorted((r["source"], r["name"], r["remote"], r["current"]) for r in found.collect()) == [(1, "dev", False, False), (1, "dev", True, False), (1, "main", False, True), (2, "dev", False, True), (2, "master", False, False)]
    assert {r["source"]: r["main"] for r in git.main_branch(found).collect()} == {1: "main", 2: "master"}


def test_python_code_gives_flows(spark):
    source = "class K:\n    def run(self, x):\n        return self.help(x)\n    def help(self, y):\n        return y\n\ndef main(req, cur):\n    k = K()\n    k.run(1)\n    q = req.body\n    s = 'select ' + q\n    cursor.execute(s)\n    n = int(q)\n    safe = parseInt(q)\n    cursor.execute(safe)\n"
    more = "from m import K as Z\ndef go():\n    Z.help(1, 2)\n    helper(1)\n"
    frame = spark.createDataFrame([("a/m.py", source), ("b/n.py", more), ("c/o.py", "def helper(a):\n    pass\n"), ("c/bad.py", "def (")], "file_path string, content string")
    engine = Engine.from_sources(frame)
    names = {r["id"]: r["qualified_name"] for r in engine.nodes.collect()}
    calls = {(names[r["src"]], names[r["dst"]]): r["confidence"] for r in engine.edges.where("kind = 'calls'").collect()}
    assert calls == {("K.run", "K.help"): 0.95, ("main", "K.run"): 0.95, ("go", "helper"): 0.5, ("go", "K.help"): 0.9}
    flows = sorted((r["sink_line"], r["severity"], r["category"]) for r in engine.flows().collect())
    assert flows == [(12, "critical", "sql_injection"), (15, "info", "sql_injection")]
    nodes, edges = python_ast.data_flow(python_ast.facts(spark.createDataFrame([("p.py", "def f(a):\n    for b in a:\n        c, d = b\n    with g(c) as h:\n        h.x += d\n    def inner(z):\n        return z\n    return [h for i in a]\n")], "file_path string, content string")))
    code = {r["id"]: (r["fn"].split(":")[1], r["code"]) for r in nodes.collect()}
    got = {(code[r["src"]][1], code[r["dst"]][1]) for r in edges.collect() if code[r["src"]][0] == "f"}
    assert {("a", "b"), ("b", "c"), ("b", "d"), ("c", "g(c)"), ("g(c)", "h"), ("d", "h.x")} <= got and ("f", "z") not in code.values()


def test_python_control_flow(spark):
    source = """def f(a):
    for x in a:
        if x:
            break
        continue
    else:
        a = 1
    match a:
        case 1:
            return 1
        case [b]:
            pass
        case _:
            raise E
    try:
        return 2
    except E:
        return 3
    finally:
        done()
"""
    blocks, edges = python_ast.blocks(python_ast.facts(spark.createDataFrame([("p.py", source)], "file_path string, content string")))
    kind = {r["ord"]: r["kind"] for r in blocks.collect()}
    got = Counter((kind[r["src"]], kind[r["dst"]], r["kind"]) for r in edges.collect())
    assert got == Counter({
        ("entry", "loop_header", "next"): 1, ("loop_header", "loop_body", "true"): 1, ("loop_header", "loop_exit", "false"): 1, ("loop_body", "branch", "next"): 1, ("branch", "then", "true"): 1, ("branch", "else", "false"): 1, ("then", "loop_exit", "break"): 1,
        ("else", "merge", "next"): 1, ("merge", "loop_header", "back"): 1, ("loop_exit", "branch", "next"): 1, ("branch", "switch_case", "case"): 3, ("switch_case", "return", "next"): 1, ("switch_case", "merge", "next"): 1, ("switch_case", "throw", "next"): 1,
        ("return", "exit", "exit"): 3, ("throw", "exit", "exit"): 1, ("merge", "try", "next"): 1, ("try", "return", "next"): 1, ("try", "catch", "exception"): 1, ("catch", "return", "next"): 1, ("try", "finally", "exception"): 1, ("finally", "exit", "exit"): 1,
    })


def test_conflicts_of_two_branches(spark):
    items = [
        ("a", "file", "f1", None), ("b", "file", "f1", None), ("a", "symbol_added", "s", None), ("b", "symbol_modified", "s", None), ("a", "signature_changed", "g", None), ("a", "summary_changed", "s", None), ("a", "summary_changed", "t", None),
        ("b", "summary_changed", "u", None), ("a", "schema_field", "m.x", "m"), ("b", "schema_field", "m.y", "m"), ("b", "schema_field", "n.z", "n"), ("c", "file", "f1", None),
    ]
    frame = spark.createDataFrame(items, "branch string, item_kind string, key string, model string")
    got = [(r["level"], r["key"], r["other"], r["change"]) for r in branches.between(frame, "a", "b").collect()]
    assert got == [(5, "m.x", "m.y", None), (4, "s", None, "a"), (3, "g", None, "a"), (2, "s", None, "added/modified"), (1, "f1", None, None)]
    # against a branch that adds anything all summaries count
    assert sorted(r["key"] for r in branches.between(frame, "b", "a").where("level = 4").collect()) == ["u"]
    n = {(r["branch_a"], r["branch_b"], r["level"]): r["n"] for r in branches.detect(frame).collect()}
    assert n == {("a", "b", 1): 1, ("a", "c", 1): 1, ("b", "c", 1): 1, ("a", "b", 2): 1, ("a", "b", 3): 1, ("a", "b", 4): 1, ("a", "b", 5): 1}


def test_views_and_scores(spark):
    nodes = spark.createDataFrame([(1, "Alpha", "a.Alpha", "s/a.ts", "class", 40, False), (2, "beta", "b.beta", "s/b.ts", "function", 10, False), (3, "t", "t.t", "alpha_test.ts", "function", 5, True)], "id long, name string, qualified_name string, file_path string, kind string, risk int, is_test boolean")
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls")], "src long, dst long, kind string")
    kept, inner, groups = views.graph_filter(nodes, edges, text="ALPHA")
    assert sorted(r["id"] for r in kept.collect()) == [1, 3] and inner.count() == 0 and groups.count() == 2
    assert [r["id"] for r in views.graph_filter(nodes, edges, tests=False, least_risk=20)[0].collect()] == [1]
    models = spark.createDataFrame([("A", "m/x/a.ts"), ("B", "m/x/b.ts"), ("C", "c.ts")], "name string, file_path string")
    assert [tuple(r) for r in views.by_directory(models).collect()] == [("m/x", 2), (".", 1)]
    flows = spark.createDataFrame([(1, "info", "src/a"), (2, "warning", "lib/b"), (3, "critical", "src/c"), (4, "other", "src/c")], "id long, severity string, first_path string")
    assert [r["id"] for r in lookups.flow_filter(flows, "warning", "src").collect()] == [3] and lookups.flow_filter(flows).count() == 3
    blank = spark.createDataFrame([], "fn long, start_line int, end_line int")
    assert metrics.lines_of_code(blank).count() == 0
    assert metrics.lines_of_code(spark.createDataFrame([(1, None, None), (2, 3, 9), (2, 5, 20)], "fn long, start_line int, end_line int")).orderBy("fn").collect() == [(1, 0), (2, 18)]


def test_rate_limit_of_a_busy_key(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, int(t)) for i, (k, t) in enumerate(zip(np.where(rng.random(900) < 0.6, 0, rng.integers(1, 6, 900)), rng.integers(0, 5000, 900), strict=True))]
    want = {}
    for key in range(6):
        begin, used = None, 0
        for _, seq, ts in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if begin is None or ts - begin >= 100:
                begin, used = ts, 0
            used += 1
            want[seq] = used <= 3
    got = runtime.rate_limit(spark.createDataFrame(rows, "key long, seq long, ts_ms long").repartition(5), 3, 100)
    assert {r["seq"]: r["allowed"] for r in got.collect()} == want
