"""Micro-graphs and texts with answers worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import rules
from graphloom.operators import branches, control, flow, lookups, metrics, text, traversal
from graphloom.sources import git
from graphloom.streaming import runtime


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([(i, i + 1, "calls") for i in range(12)], "src long, dst long, kind string")


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def one(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_depth_contracts_on_a_chain(spark, chain):
    nodes, edges, fell_back = traversal.trace(chain, one(spark, 0), 3)
    assert ids(nodes) == [0, 1, 2, 3, 4] and edges.count() == 4 and not fell_back
    assert ids(traversal.impact(chain, one(spark, 12))) == [9, 10, 11, 12]
    assert ids(traversal.transitive_callers(chain, one(spark, 12), 10)) == list(range(3, 12))
    assert traversal.count_callers(chain, one(spark, 12, 0)).orderBy("id").collect() == [(0, 0), (12, 12)]
    path = traversal.shortest_path(chain, 3, 1).orderBy("hop").collect()
    assert [(r["hop"], r["id"]) for r in path] == [(0, 3), (1, 2), (2, 1)]
    assert traversal.shortest_path(chain, 3, 99).count() == 0


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls"), (3, 1, "calls")], "src long, dst long, kind string")
    assert ids(traversal.transitive_callers(edges, one(spark, 1))) == [2, 3]


def test_trace_falls_back_to_both(spark):
    edges = spark.createDataFrame([(1, 2, "calls")], "src long, dst long, kind string")
    nodes, found, fell_back = traversal.trace(edges, one(spark, 2), 5)
    assert fell_back and ids(nodes) == [1, 2] and found.count() == 1


def test_parallel_edges_count_for_coupling_and_not_for_traces(spark):
    edges = spark.createDataFrame([(1, 2, "calls"), (1, 2, "calls"), (1, 2, "imports")], "src long, dst long, kind string")
    nodes = spark.createDataFrame([(1, "f", "function"), (2, "f", "function")], "id long, file_path string, kind string")
    got = {r["id"]: (r["ca"], r["ce"], r["instability"]) for r in metrics.coupling(nodes, edges).collect()}
    assert got == {1: (0, 3, 1.0), 2: (3, 0, 0.0)}
    assert traversal.trace(edges, one(spark, 1))[1].count() == 2


def test_context_labels(spark):
    edges = spark.createDataFrame([(1, 2, "calls", 0), (3, 1, "imports", 1), (2, 3, "contains", 2)], "src long, dst long, kind string, ord long")
    got = {r["id"]: (r["depth"], r["relation"]) for r in traversal.context(edges, 1, 2).collect()}
    assert got == {1: (0, "self"), 2: (1, "calls"), 3: (1, "inverse_imports")}


def test_test_links(spark):
    edges = spark.createDataFrame([(1, 11, "calls"), (11, 12, "calls"), (2, 11, "calls"), (1, 2, "calls")], "src long, dst long, kind string")
    nodes = spark.createDataFrame([(1, True), (2, True), (11, False), (12, False), (19, False)], "id long, is_test boolean")
    links = traversal.test_links(edges, nodes)
    assert sorted((r["test"], r["prod"], r["link"], r["via"]) for r in links.collect()) == [
        (1, 11, "direct", None), (1, 12, "transitive", 11), (2, 11, "direct", None), (2, 12, "transitive", 11)
    ]
    assert traversal.test_impact(links, edges, one(spark, 19)).count() == 0
    assert traversal.test_impact(links, edges, one(spark, 12)).count() == 2


def test_blast_buckets(spark):
    edges = spark.createDataFrame([(i, 1000, "calls") for i in range(101)] + [(i, 2000, "calls") for i in range(100)] + [(i, 3000, "calls") for i in range(5)], "src long, dst long, kind string")
    assert dict(map(tuple, traversal.blast_buckets(edges, one(spark, 1000, 2000, 3000, 0)).collect())) == {1000: 10, 2000: 8, 3000: 2, 0: 0}


def test_risk_of_a_plain_function(spark):
    row = spark.createDataFrame([(5, 7, 0, 0, 5, 2)], "complexity int, testCoverage int, dataSensitivity int, blastRadius int, changeVelocity int, errorHandling int")
    got = metrics.risk(row).first()
    assert got["score"] == 33 and got["level"] == "medium" and got["recommendation"] == "Add test coverage for this code"


def test_security_score(spark):
    got = metrics.security_score(spark.createDataFrame([("critical", "sql_injection")], "severity string, category string")).first()
    assert (got["taint"], got["inputs"], got["dependencies"], got["flows"], got["overall"], got["grade"]) == (80, 88, 100, 100, 89, "B")


def test_enclosing_symbol(spark):
    nodes = spark.createDataFrame([(1, 0, "class", "f", 1, 50), (2, 1, "method", "f", 10, 20), (3, 2, "function", "f", 12, 15), (4, 3, "constructor", "f", 30, 40)], "id long, ord long, kind string, file_path string, start_line int, end_line int")
    points = spark.createDataFrame([(13, "f", 13), (18, "f", 18), (35, "f", 35), (60, "f", 60)], "point long, file_path string, line int")
    assert dict(lookups.enclosing(points, nodes, 8).select("point", "symbol_id").collect()) == {13: 3, 18: 2, 35: 1, 60: None}


def test_rank_fusion(spark):
    keyword = spark.createDataFrame([(1, -3.0), (2, -2.0), (3, -1.0)], "node_id long, score double")
    semantic = spark.createDataFrame([(3, 0.9), (1, 0.5)], "node_id long, score double")
    got = text.fuse(keyword, semantic).collect()
    assert [r["node_id"] for r in got] == [1, 3, 2] and abs(got[0]["score"] - (1 / 61 + 1 / 62)) < 1e-12


def test_bm25_phrases_and_accents(spark):
    docs = spark.createDataFrame([(1, "élan vital", "a", "x"), (2, "order item", "b", "y"), (3, "item order", "b", "y"), (4, "elan", "c", "z"), (5, "q", "r", "s"), (6, "q", "r", "t")], "node_id long, name string, qualified_name string, file_path string")
    assert ids(text.bm25(docs, "elan"), "node_id") == [1, 4] and ids(text.bm25(docs, "order_item"), "node_id") == [2] and text.bm25(docs, " ").count() == 0


def test_scanner(spark):
    content = "\n".join(["el.innerHTML = eval(x)", "// eval(x)", "# eval(x)", 'password = "longenough1"', "window.location ='x'", "plain"])
    files = spark.createDataFrame([("src/a.js", content), ("src/a.test.js", content)], "file_path string, content string")
    got = sorted((r["line"], r["category"], r["severity"]) for r in text.scan_lines(files).collect())
    assert got == [(1, "command_injection", "critical"), (4, "hardcoded_secret", "high"), (5, "open_redirect", "medium")]


def test_every_rule_is_a_java_pattern(spark):
    pats = [p for p, *_ in rules.SOURCES + rules.SINKS + rules.LINES] + rules.SANITIZERS
    spark.range(1).select(*[F.lit("x").rlike(p) for p in pats]).collect()


def test_taint(spark):
    def run(nodes, edges):
        n = spark.createDataFrame([(i, 1, i, s, k, z) for i, s, k, z in nodes], "id long, fn long, ord long, is_source boolean, is_sink boolean, is_sanitizer boolean")
        e = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, fn long")
        return [(r["sanitized"], r["length"], r["severity"]) for r in flow.taint(n, e).collect()]

    t, f = True, False
    assert run([(1, t, f, f), (2, f, t, f)], [(1, 2)]) == [(False, 2, "critical")]
    assert run([(1, t, f, f), (2, f, f, t), (3, f, t, f)], [(1, 2), (2, 3)]) == [(True, 3, "info")]
    assert run([(1, t, f, f), (2, f, f, t), *[(i, f, f, f) for i in (3, 4, 5)], (6, f, t, f)], [(i, i + 1) for i in range(1, 6)]) == [(True, 6, "warning")]
    # a short open path and a long safe one: the first arrival decides
    assert run([(1, t, f, f), (2, f, f, t), (3, f, f, f), (9, f, t, f)], [(1, 9), (1, 2), (2, 3), (3, 9)]) == [(False, 2, "critical")]


def test_reaching_definitions_end_on_back_edges(spark):
    nodes = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, True)], "id long, fn long, is_def boolean")
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 2, 1)], "src long, dst long, fn long")
    assert sorted(r["definition"] for r in flow.reaching(nodes, edges).where("id = 3").collect()) == [1, 2, 3]


def test_communities(spark):
    pairs = [(a, b) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(3, 10)]
    edges = spark.createDataFrame([(0, a, b, 1.0) for a, b in pairs], "repo long, src long, dst long, weight double")
    nodes = spark.createDataFrame([(0, i, i) for i in [*range(4), *range(10, 14)]], "repo long, id long, ord long")
    for got in (flow.local_moving(edges, nodes), flow.label_propagation(edges)):
        c = {r["id"]: r["community"] for r in got.collect()}
        assert len({c[i] for i in range(4)}) == 1 and len({c[i] for i in range(10, 14)}) == 1


def test_conflict_symmetry(spark):
    rows = [(1, "file", "a", None), (2, "file", "a", None), (1, "symbol_added", "s", None), (2, "symbol_modified", "s", None), (1, "signature_changed", "g", None), (1, "schema_field", "m.x", "m"), (2, "schema_field", "m.y", "m"), (2, "schema_field", "m.z", "m")]
    schema = "branch int, item_kind string, key string, model string"
    swapped = [(3 - b, *r) for b, *r in rows]
    got, other = ({(r["level"], r["n"]) for r in branches.detect(spark.createDataFrame(x, schema)).collect()} for x in (rows, swapped))
    assert got == other == {(1, 1), (2, 1), (3, 1), (5, 2)}


def test_fingerprint(spark):
    base = spark.createDataFrame([("f", "def f(a):\n  1"), ("g", "def g()")], "name string, source string")
    new = spark.createDataFrame([("f", "def f(a, b):\n  1\n  2"), ("h", "def h()")], "name string, source string")
    got = {r["name"]: tuple(r)[1:] for r in branches.fingerprint(base, new).collect()}
    assert got == {"f": ("modified", 1, 0, True), "g": ("removed", 0, 1, False), "h": ("added", 1, 0, False)}


def test_git_texts(spark):
    h = "a" * 40
    log = f"{h}|aaa|Ann|ann@x|2024-01-01T00:00:00Z|fix a|b\n\n3\t-\tsrc/a.py\n-\t-\tb.png\n"
    diff = "diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n ctx\n-old\n+new\n+more\n@@ -10 +11 @@\n tail"
    blame = f"{h} 1 1 2\nauthor Ann\nauthor-mail <ann@x>\nauthor-time 5\n\tline one\n{h} 2 2\n\tline two"
    rows = lambda s: git.lines(spark.createDataFrame([("s", s)], "source string, text string"))
    got = [(r["message"], r["file"], r["insertions"], r["deletions"]) for r in git.parse_log(rows(log)).collect()]
    assert got == [("fix a|b", "src/a.py", 3, 0), ("fix a|b", "b.png", 0, 0)]
    got = [(r["file_path"], r["type"], r["content"], r["old_line"], r["new_line"]) for r in git.parse_diff(rows(diff)).collect()]
    assert got == [("x.py", "context", "ctx", 1, 1), ("x.py", "delete", "old", 2, None), ("x.py", "add", "new", None, 2), ("x.py", "add", "more", None, 3), ("x.py", "context", "tail", 10, 11)]
    got = [(r["line_no"], r["author"], r["author_email"], r["content"]) for r in git.parse_blame(rows(blame)).collect()]
    assert got == [(1, "Ann", "<ann@x>", "line one"), (2, "Ann", "<ann@x>", "line two")]


def test_late_events_still_count_as_last(spark):
    rows = [(1, 7, 100, "runtime_call", "a", "b"), (2, 7, 50, "runtime_call", "a", "b"), (3, 7, 1, "runtime_call", "a", None)]
    events = spark.createDataFrame(rows, "seq long, session_id long, ts_ms long, kind string, source_key string, target_key string")
    for got in (runtime.fold(events).collect(), runtime.stream_once(events.where("target_key IS NOT NULL"), 2).collect()):
        assert [(r["hit_count"], r["first_seen_ms"], r["last_seen_ms"]) for r in got] == [(2, 100, 50)]


def test_rate_limit(spark):
    rows = spark.createDataFrame([(1, i, i * 10) for i in range(101)] + [(1, 200, 60_000)], "key long, seq long, ts_ms long")
    got = {r["seq"]: r["allowed"] for r in runtime.rate_limit(rows).collect()}
    assert not got[100] and got[99] and got[200] and sum(got.values()) == 101


def test_call_resolution_tiers(spark):
    nodes = spark.createDataFrame([(1, 1, "function", "f", "m.f", "a", True), (2, 2, "function", "f", "n.f", "b", False), (3, 3, "function", "g", "n.g", "b", True)], "id long, ord long, kind string, name string, qualified_name string, file_path string, exported boolean")
    calls = spark.createDataFrame([(1, "b", "f"), (2, "c", "f"), (3, "c", "g"), (4, "c", "h")], "call long, file_path string, callee string")
    imports = spark.createDataFrame([("c", "f", "n.f")], "file_path string, name string, qualified_name string")
    got = {r["call"]: (r["target"], r["tier"]) for r in lookups.resolve_calls(calls, nodes, imports).collect()}
    assert got == {1: (2, "same_file"), 2: (2, "import_scoped"), 3: (3, "global"), 4: (None, None)}


def test_queries_have_names_and_oracles():
    import __spark_entry__ as entry

    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) > 80
    json.dumps(sorted(known))


def test_flow_goes_on_beyond_a_hundred_hops(spark):
    edges = spark.createDataFrame([(1, i, i + 1, "escape" if i == 150 else None) for i in range(260)] + [(2, 0, 1, None), (2, 1, 0, None)], "fn long, src long, dst long, transform string")
    nodes = spark.createDataFrame([(1, i, i in (0, 120)) for i in range(261)] + [(2, 0, True), (2, 1, False)], "fn long, id long, is_def boolean")
    got = sorted(map(tuple, flow.reaching(nodes, edges).select("fn", "definition", "id").collect()))
    assert got == sorted([(1, d, i) for d in (0, 120) for i in range(d, 261)] + [(2, 0, 0), (2, 0, 1)])
    got = sorted(map(tuple, control.param_flows(edges, nodes.where("id = 0").select("fn", "id")).select("fn", "param", "id", "sanitized").collect()))
    assert got == [(1, 0, i, i > 150) for i in range(1, 261)] + [(2, 0, 1, False)]


def test_only_shortest_ways_sanitise(spark):
    edges = spark.createDataFrame([(1, 0, 1, None), (1, 1, 2, None), (1, 2, 3, None), (1, 0, 4, None), (1, 4, 5, None), (1, 5, 6, "escape"), (1, 6, 3, None), (1, 0, 7, "encode"), (1, 7, 2, None)], "fn long, src long, dst long, transform string")
    got = control.param_flows(edges, spark.createDataFrame([(1, 0)], "fn long, id long"))
    assert sorted(map(tuple, got.select("id", "sanitized").collect())) == [(1, False), (2, True), (3, True), (4, False), (5, False), (6, True), (7, True)]
