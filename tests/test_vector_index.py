"""Vector search by the kept index against the search that reads all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import text, vector_index

SCHEMA = "vec_id long, embedding array<double>"


def clustered(seed, n, start=0, dim=8, groups=12):
    """Vectors in tight groups, one of which holds a third of all; some are copies."""
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(99).normal(size=(groups, dim))
    of = np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))
    rows = middles[of] + 0.05 * rng.normal(size=(n, dim))
    rows[::17] = middles[of[::17]]
    return [(start + i, [float(x) * (1 + i % 3) for x in r]) for i, r in enumerate(rows)]


ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [None] + [1.0] * 7), (9005, [float("nan")] + [1.0] * 7), (9006, [float("inf")] * 8), (9007, [1.0, 2.0]), (9008, [1e200] * 8), (None, [1.0] * 8)]


def found(df):
    return [(r["vec_id"], round(r["score"], 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('vectors')}/i"
    rows = clustered(1, 1200)
    vector_index.build(spark.createDataFrame(rows + ODD, SCHEMA), path)
    return path, rows


def test_equal_to_full_scan(spark, index):
    path, rows = index
    held = spark.createDataFrame(rows, SCHEMA).cache()
    for probe, ks in ((rows[17][1], (1, 10)), ([-x for x in rows[5][1]], (300,)), ([1.0] + [0.0] * 7, (5000,))):
        all_of_it = found(text.cosine_top(held, probe, 5000))
        for k in ks:
            assert found(vector_index.search(spark, path, probe, k)) == all_of_it[:k]


def test_few_cells_are_read(spark, index):
    path, rows = index
    cells = vector_index.bounds(spark, path, rows[40][1])
    assert len(cells) > 12 and cells["n"].sum() == len(rows)
    top = vector_index.search(spark, path, rows[40][1], 10)
    within = np.arccos(min(1, top.collect()[-1]["score"]))
    read = cells[cells["gap"] <= within + vector_index.SLACK]["n"].sum()
    assert read < len(rows) / 2
    # no vector is nearer than its cell's bound says
    angles = {i: np.arccos(np.clip(np.dot(v, rows[40][1]) / np.linalg.norm(v) / np.linalg.norm(rows[40][1]), -1, 1)) for i, v in rows}
    gap = {(r.segment, r.cell): r.gap for r in cells.itertuples()}
    for r in spark.read.parquet(f"{path}/vectors").collect():
        assert angles[r["vec_id"]] >= gap[r["segment"], r["cell"]]


def test_only_chosen_cells_are_opened(spark, index):
    path, rows = index
    cells = vector_index.bounds(spark, path, rows[40][1])[:2]
    some = vector_index._of(vector_index._read(spark, path, "vectors", vector_index._VECTORS), cells, 0.3)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "GreaterThanOrEqual(angle" in plan
    opened = {(int(r[0].split("segment=")[1].split("/")[0]), int(r[0].split("cell=")[1].split("/")[0])) for r in some.select(F.input_file_name()).distinct().collect()}
    assert opened <= set(zip(cells["segment"], cells["cell"]))


def test_no_answer(spark, index, tmp_path):
    path, _ = index
    for probe in ([0.0] * 8, [float("nan")] * 8, [1.0, 2.0], [1e200] * 8):
        assert vector_index.search(spark, path, probe).collect() == []
    assert vector_index.search(spark, path, [1.0] * 8, 0).collect() == []
    empty = f"file://{tmp_path}/none"
    vector_index.build(spark.createDataFrame(ODD[:4], SCHEMA), empty)
    assert vector_index.search(spark, empty, [1.0] * 8).collect() == []


def test_grows_and_shrinks(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    live = dict(clustered(2, 300))
    vector_index.build(spark.createDataFrame(list(live.items()), SCHEMA), path)
    later = dict(clustered(3, 120, start=250))
    vector_index.add(spark.createDataFrame(list(later.items()) + ODD, SCHEMA), path)
    live |= later
    gone = [0, 1, 260, 369]
    vector_index.remove(spark.createDataFrame([(i,) for i in gone + [0, 12345]], "vec_id long"), path)
    live = {i: v for i, v in live.items() if i not in gone}
    again = dict(clustered(4, 5))
    vector_index.add(spark.createDataFrame(list(again.items()), SCHEMA), path)
    live |= again
    held = spark.createDataFrame(list(live.items()), SCHEMA).cache()
    for probe, k in ((later[300], 8), (again[0], 1000)):
        assert found(vector_index.search(spark, path, probe, k)) == found(text.cosine_top(held, probe, k))


def test_evenly_spread_and_one_vector(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    vector_index.build(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/even")
    held = spark.createDataFrame(rows, SCHEMA)
    assert found(vector_index.search(spark, f"file://{tmp_path}/even", rows[0][1], 7)) == found(text.cosine_top(held, rows[0][1], 7))
    vector_index.build(spark.createDataFrame([(i, [2.0, 1.0]) for i in range(30)], SCHEMA), f"file://{tmp_path}/one")
    assert [r["vec_id"] for r in vector_index.search(spark, f"file://{tmp_path}/one", [1.0, 0.0], 4).collect()] == [0, 1, 2, 3]
