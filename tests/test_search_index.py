"""Search by the kept index against the search that reads all documents."""

import random

import pytest

from graphloom.operators import search_index, text

SCHEMA = "node_id long, name string, qualified_name string, file_path string"


def documents(seed, n, start=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["rare", "café", "get_item"]
    weights = [2 ** -i for i in range(12)] + [0.01, 0.02, 0.05]
    say = lambda k: " ".join(rng.choices(words, weights, k=k)) if k else None
    return [(start + i, say(rng.randrange(12)), say(rng.randrange(4)), rng.choice(["a/b.py", "c.ts", None])) for i in range(n)]


def found(df):
    return [(r["node_id"], round(r["score"], 7)) for r in df.collect()]


QUERIES = ["w0", "w1 w2", "rare", "w0 w1 w3", "CAFE", "get_item", "b.py w0", "nothing", "", "w0 nothing"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    search_index.build(spark.createDataFrame(documents(1, 400), SCHEMA), path)
    return path


@pytest.mark.parametrize("first, block", [(16, 4096), (2, 4)])
def test_as_the_full_scan(spark, index, monkeypatch, tmp_path, first, block):
    monkeypatch.setattr(search_index, "FIRST", first)
    monkeypatch.setattr(search_index, "BLOCK", block)
    docs = spark.createDataFrame(documents(1, 400), SCHEMA)
    path = index
    if block == 4:
        path = f"file://{tmp_path}/i"
        search_index.build(docs, path)
    for query in QUERIES if block == 4 else QUERIES[:5]:
        assert found(search_index.bm25(spark, path, query, 7)) == found(text.bm25(docs, query, 7)), query


def test_segments_replace_and_remove(spark, tmp_path):
    path, old, new = f"file://{tmp_path}/i", documents(1, 120), documents(2, 50, 100)
    search_index.build(spark.createDataFrame(old, SCHEMA), path)
    search_index.add(spark.createDataFrame(new, SCHEMA), path)
    search_index.add(spark.createDataFrame(new[:5], SCHEMA), path)
    search_index.remove(spark.createDataFrame([(3,), (110,), (999,)], "node_id long"), path)
    live = {r[0]: r for r in old} | {r[0]: r for r in new}
    docs = spark.createDataFrame([r for i, r in live.items() if i not in (3, 110)], SCHEMA)
    for query in ("w0", "w1 w2", "get_item"):
        assert found(search_index.bm25(spark, path, query, 20)) == found(text.bm25(docs, query, 20)), query


def test_only_the_terms_folders_are_opened(spark, index):
    plan = search_index.postings(spark, index, ["w0"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(term,w0)" in plan
    assert len(search_index.postings(spark, index, ["w0"]).inputFiles()) > 0
