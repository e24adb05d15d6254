"""Blocks and data flow of brace languages: equal programs have the facts that Python's parser gives."""

import pytest

from graphloom.engine import Engine
from graphloom.operators import metrics
from graphloom.sources import brace_flow, python_ast

SCHEMA = "file_path string, content string"

# each program in Python and in brace languages; a statement a line, so that lines agree
PROGRAMS = {
    "branch": (
        "def f(a, b):\n    if a > b:\n        c = g(a)\n    else:\n        c = b\n    return c\n",
        {"ts": "function f(a: number, b: number): number {\n  if (a > b) {\n    let c = g(a);\n  } else {\n    c = b;\n  }\n  return c;\n}\n", "java": "class K {\n int f(int a, int b) {\n  if (a > b) {\n   c = g(a);\n  } else {\n   c = b;\n  }\n  return c;\n }\n}\n", "go": "func f(a int, b int) int {\n  if a > b {\n    c = g(a)\n  } else {\n    c = b\n  }\n  return c\n}\n"},
    ),
    "chain": (
        "def f(a):\n    if a == 1:\n        return x(a)\n    elif a == 2:\n        raise e(a)\n    else:\n        a = 3\n    a += 4\n    return a\n",
        {"ts": "const f = (a) => {\n if (a === 1)\n  return x(a)\n else if (a === 2)\n  throw e(a)\n else\n  a = 3\n a += 4\n return a\n}\n", "java": "class K { int f(int a) {\n if (a == 1) return x(a);\n else if (a == 2) throw e(a);\n else a = 3;\n a += 4;\n return a;\n} }\n"},
    ),
    "loops": (
        "def f(xs):\n    n = 0\n    for x in xs:\n        if x.bad:\n            continue\n        if h(x):\n            break\n        n = n + x\n    while n:\n        n = s.down(n, 1)\n    return n\n",
        {"ts": "function f(xs) {\n let n = 0\n for (const x of xs) {\n  if (x.bad) { continue }\n  if (h(x)) break;\n  n = n + x\n }\n while (n) { n = s.down(n, 1) }\n return n\n}\n", "java": "class K { int f(List<Item> xs) {\n int n = 0;\n for (Item x : xs) {\n if (x.bad) continue;\n if (h(x)) { break; }\n n = n + x;\n }\n while (n) n = s.down(n, 1);\n return n;\n} }\n", "go": "func f(xs []Item) int {\n n := 0\n for _, x := range xs {\n  if x.bad {\n   continue\n  }\n  if h(x) {\n   break\n  }\n  n = n + x\n }\n for n {\n  n = s.down(n, 1)\n }\n return n\n}\n"},
    ),
    "attempt": (
        "def f(a):\n    try:\n        b = read(a)\n    except E:\n        b = None\n    finally:\n        close(a)\n    return b\n",
        {"ts": "async function f(a) {\n try {\n  b = await read(a);\n } catch (e) {\n  b = null;\n } finally {\n  close(a);\n }\n return b;\n}\n", "java": "class K { Object f(Object a) {\n try { b = read(a); } catch (E e) { b = null; } finally { close(a); }\n return b;\n} }\n"},
    ),
    "cases": (
        "def f(a):\n    match a:\n        case 1:\n            b = p(a)\n        case 2:\n            b = q(a)\n        case _:\n            b = a\n    return b\n",
        {"ts": "function f(a) {\n switch (a) {\n case 1:\n  b = p(a); break\n case 2: { b = q(a); break }\n default:\n  b = a\n }\n return b\n}\n", "java": "class K { int f(int a) {\n switch (a) {\n case 1 -> b = p(a);\n case 2 -> { b = q(a); }\n default -> b = a;\n }\n return b;\n} }\n", "go": "func f(a int) int {\n switch a {\n case 1:\n  b = p(a)\n case 2:\n  b = q(a)\n default:\n  b = a\n }\n return b\n}\n"},
    ),
    "values": (
        "def f(o, i):\n    a = o.get(i).name\n    b, c = pair(a, [i, o])\n    o.last = b\n    d = a[i] + k(lambda z: z, c)\n    m.put('x', d)\n    return (b, d)\n",
        {"ts": "function f(o, i) {\n const a = o.get(i).name;\n const [b, c] = pair(a, [i, o]);\n o.last = b;\n const d = a[i] +\n  k((z) => z, c);\n m.put('x', d);\n return [b, d];\n}\n", "go": "func f(o O, i int) {\n a := o.get(i).name\n b, c := pair(a, []T{i, o})\n o.last = b\n d := a[i] + k(func(z int) int { return z }, c)\n m.put(\"x\", d)\n return b, d\n}\n"},
    ),
}


def shape(found):
    """Facts without paths, lines and the text of code."""
    blocks, flow, seen = [], [], sorted(found, key=lambda r: r["ord"])
    for r in seen:
        if r["fact"] in ("block", "block_edge"):
            blocks.append((r["fact"], r["name"], r["detail"]))
        elif r["fact"] == "flow_node":
            flow.append((r["fact"], r["name"], r["detail"].split(":")[0]))
        elif r["fact"] == "flow_edge":
            flow.append((r["fact"], r["name"], r["detail"]))
    return sorted(blocks), sorted(flow)


@pytest.fixture(scope="module")
def programs(spark):
    rows = [(f"{name}.{end}", code) for name, (_, others) in PROGRAMS.items() for end, code in others.items()]
    got = {}
    for r in brace_flow.facts(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["file_path"], []).append(r.asDict())
    return got


@pytest.mark.parametrize("name", PROGRAMS)
def test_equal_to_python(programs, name):
    columns = [c.split()[0] for c in python_ast.COLUMNS.split(", ")]
    want = shape([dict(zip(columns, r)) for r in python_ast.facts_of("p.py", PROGRAMS[name][0]) if r[3] == "f"])
    for end in PROGRAMS[name][1]:
        assert shape(programs[f"{name}.{end}"]) == want, end


def facts(spark, files):
    got = {}
    for r in brace_flow.facts(spark.createDataFrame(files, SCHEMA)).collect():
        got.setdefault((r["file_path"], r["owner"]), []).append(r.asDict())
    return got


def test_own_rules(spark):
    got = facts(spark, [
        ("do.ts", "function f(a) {\n do {\n  a = g(a)\n } while (a)\n return a\n}\nfunction empty() {}\n"),
        ("label.java", "class K { void f(int a) { outer: for (int i = 0; i < a; i++) { while (true) { if (g(i)) break outer; continue outer; } } }\n void f(String b) { b.m(); } }"),
        ("fall.js", "class K { m(a) { switch (a) { case 1: b = 1; case 2: b = 2; break; case 3: return } } }"),
        ("nested.ts", "function f(a) {\n function inner(b) { return b }\n const held = (c) => { return c.d }\n return xs.map(x => { return inner(x) }, a)\n}\n"),
        ("odd.go", "func f(a int) {\n if b, err := g(a); err != nil {\n  use(b)\n }\n // if a { }\n s := \"while (x) {\"\n put(s)\n"),
        ("none.ts", "const x = 1\n"),
        ("null.ts", None),
    ])
    assert set(k for k in got) == {("do.ts", "f"), ("do.ts", "empty"), ("label.java", "K.f"), ("label.java", "K.f#2"), ("fall.js", "K.m"), ("nested.ts", "f"), ("nested.ts", "inner"), ("nested.ts", "held"), ("odd.go", "f")}
    edges = lambda *k: [(r["name"], r["detail"]) for r in sorted(got[k], key=lambda r: r["ord"]) if r["fact"] == "block_edge"]
    codes = lambda *k: [r["detail"] for r in sorted(got[k], key=lambda r: r["ord"]) if r["fact"] == "flow_node"]
    assert edges("do.ts", "f") == [("0", "3:next"), ("2", "4:false"), ("3", "2:next"), ("2", "3:back"), ("4", "5:next"), ("5", "1:exit")]
    assert edges("do.ts", "empty") == [("0", "1:next")] and codes("do.ts", "empty") == []
    # outer loop 2 to 4, inner 5 to 7, branch 8, then 9, else 10, merge 11
    assert {("9", "4:break"), ("11", "2:back")} <= set(edges("label.java", "K.f"))
    assert codes("label.java", "K.f#2") == ["param:b", "call:b.m()"]
    assert {("3", "4:next"), ("5", "6:next"), ("6", "1:exit")} <= set(edges("fall.js", "K.m"))
    assert codes("nested.ts", "f") == ["param:a", "call:xs.map(x=>{return inner(x)},a)".replace(",a", ", a"), "return:return xs.map(x=>{return inner(x)}, a)"]
    assert codes("nested.ts", "inner") == ["param:b", "return:return b"] and codes("nested.ts", "held") == ["param:c", "field:c.d", "return:return c.d"]
    assert codes("odd.go", "f") == ["param:a", "call:g(a)", "assignment:b", "assignment:err", "call:use(b)", "assignment:s", "call:put(s)"]


def test_through_the_operators(spark):
    source = [("a.ts", PROGRAMS["loops"][1]["ts"]), ("a.go", PROGRAMS["loops"][1]["go"]), ("a.py", PROGRAMS["loops"][0])]
    files = spark.createDataFrame(source, SCHEMA)
    found = brace_flow.facts(files).unionByName(python_ast.facts(files))
    cyclomatic = {r["fn"]: r["cyclomatic"] for r in metrics.cyclomatic(*python_ast.blocks(found)).collect()}
    assert len(cyclomatic) == 3 and len(set(cyclomatic.values())) == 1
    nodes, edges = python_ast.data_flow(found)
    assert len({r["n"] for r in nodes.groupBy("fn").count().toDF("fn", "n").collect()}) == 1
    assert edges.join(nodes.selectExpr("id AS src"), "src").join(nodes.selectExpr("id AS dst"), "dst").count() == edges.count()
    assert brace_flow.facts(files.limit(0)).collect() == []


def test_untrusted_data_through_the_engine(spark):
    code = "export function run(req: Request) {\n  const command = req.body.command;\n  if (command) {\n    exec(command);\n  }\n}\nfunction safe(a) {\n  exec(a)\n}\n"
    made = Engine.from_sources(spark.createDataFrame([("a.ts", code)], SCHEMA))
    found = {(r["fn"], r["source_line"], r["sink_line"], r["category"], r["sanitized"]) for r in made.flows().collect()}
    assert ("a.ts:run", 2, 4, "command_injection", False) in found and not any(fn == "a.ts:safe" for fn, *_ in found)
    assert {r["name"]: r["cyclomatic"] for r in made.nodes.where("kind = 'function'").collect()} == {"run": 2, "safe": 1}
