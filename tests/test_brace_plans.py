"""Plans of the facts of brace code: texts are dealt out, not tokens, and facts are made once."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import __spark_entry__
from graphloom.sources import brace_code, brace_flow


def plan_of(df) -> str:
    with redirect_stdout(out := io.StringIO()):
        df.explain("simple")
    return out.getvalue()


def test_facts_of_blocks_are_made_once(spark):
    df = __spark_entry__.queries()["g16_brace_blocks"](spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in plan_of(df)


def test_tokens_are_not_exchanged(spark):
    files = spark.createDataFrame([(f"f{i}.ts", "function f(x) {\n if (x) { return g(x) }\n}\n" * i) for i in range(20)], "file_path string, content string")
    plan = plan_of(brace_code._scoped(brace_code._placed(brace_code.dealt(files))))
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # the exchange is below


def test_tokens_of_nested_functions(spark):
    """Each token is its innermost function's, in files of many functions and where one function ends with the file."""
    text = "".join(f"function a{i}(x) {{\n  const b{i} = (y) => {{\n    q(y);\n    return y;\n  }};\n  return x;\n}}\n" for i in range(200)) + "function open(z) {\n  return z;\n"
    found = brace_flow.facts(spark.createDataFrame([("m.ts", text)], "file_path string, content string")).where("fact = 'flow_node'").collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["owner"], []).append(r["detail"].split(":")[0])
    assert len(got) == 401 and sorted(got["open"]) == ["param", "return"]
    assert all(sorted(got[f"a{i}"]) == ["param", "return"] and sorted(got[f"b{i}"]) == ["call", "param", "return"] for i in range(200))


def test_heads_and_imports_read_their_tokens_only(spark):
    text = "import {\n a, b as c } from './x'; import d, * as e from 'y';\nconst z = import('w');\nclass A<T, U> extends B<T> implements C, D.E {\n m(a, b) { return g('import', a) }\n}\ninterface F extends G {}\n" + "function h(x) { return i(x, 'j') }\n" * 300
    rows, brackets = brace_code.read(spark.createDataFrame([("m.ts", text)], "file_path string, content string"))
    assert rows.where("heading OR importing").count() < 80 < rows.count() // 50
    _, _, types = brace_code._declared(rows, brackets)
    assert sorted((r["token"], r["owner"], r["how"]) for r in brace_code._heritage(rows, types).collect()) == [("B", "A", "extends"), ("C", "A", "implements"), ("E", "A", "implements"), ("G", "F", "extends")]
    assert sorted((r["name"], r["local"], r["source"]) for r in brace_code._taken(rows).collect()) == [("*", "e", "y"), ("a", "a", "./x"), ("b", "c", "./x"), ("default", "d", "y")]
