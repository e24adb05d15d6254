"""Only what is new is parsed, and the graph is that of a whole run."""

from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.sources import brace_code, parsed, python_ast

FILES = {f"app/m{i}.py": f"from app.m{i + 1} import f{i + 1}\n\ndef f{i}(x):\n    return f{i + 1}(x)\n" for i in range(6)} | {"web/a.ts": "import { b } from './b';\nexport function a() { b(); }\n", "web/b.ts": "export function b() {}\n"}


def table(spark, files):
    return spark.createDataFrame(sorted(files.items()), "file_path string, content string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_edits_are_parsed_and_nothing_else(spark, tmp_path):
    seen = []

    def parse(sources):
        seen.append(sorted(r["file_path"] for r in sources.select("file_path").collect()))
        return python_ast.facts(sources)

    cache = f"file://{tmp_path}/facts"
    assert rows(parsed.facts(table(spark, FILES), parse, cache)) == rows(python_ast.facts(table(spark, FILES)))
    edited = FILES | {"app/m2.py": "def f2(x):\n    return 0\n", "app/new.py": "def g():\n    pass\n"}
    del edited["app/m4.py"]
    assert rows(parsed.facts(table(spark, edited), parse, cache)) == rows(python_ast.facts(table(spark, edited)))
    assert rows(parsed.facts(table(spark, edited), parse, cache)) == rows(python_ast.facts(table(spark, edited)))
    assert rows(parsed.facts(table(spark, FILES), parse, cache)) == rows(python_ast.facts(table(spark, FILES)))  # the old state is still kept
    assert seen == [sorted(FILES), ["app/m2.py", "app/new.py"]]


def test_facts_without_their_files_do_not_count(spark, tmp_path):
    cache = f"file://{tmp_path}/facts"
    ts = {k: v for k, v in FILES.items() if k.endswith("ts")}
    want = rows(parsed.facts(table(spark, ts), brace_code.facts, cache))
    kept = spark.read.parquet(f"{cache}/facts")
    kept.withColumn("batch", F.lit("cut off")).write.mode("append").parquet(f"{cache}/facts")
    assert rows(parsed.facts(table(spark, ts), brace_code.facts, cache)) == want


def test_the_graph_is_that_of_a_whole_run(spark, tmp_path):
    cache = f"file://{tmp_path}/facts"
    Engine.from_sources(table(spark, FILES), cache)
    edited = FILES | {"app/m1.py": "from app.m2 import f2\n\ndef f1(x, y):\n    f2(y)\n", "web/b.ts": "export class B {}\n"}
    again, whole = Engine.from_sources(table(spark, edited), cache), Engine.from_sources(table(spark, edited))
    assert rows(again.nodes) == rows(whole.nodes) and rows(again.edges) == rows(whole.edges)
