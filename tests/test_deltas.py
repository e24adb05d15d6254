"""Tables kept in batches: what a batch writes, repeated and late batches, restarts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphloom.plans import deltas
from graphloom.streaming import runtime

SCHEMA = "seq long, session_id long, ts_ms long, kind string, source_key string, target_key string"


def events(seed, n, start=0):
    rng = random.Random(seed)
    return [(start + i, rng.randrange(3), rng.randrange(1000), "runtime_call", f"s{rng.randrange(4)}", rng.choice(["t1", "t2", None])) for i in range(n)]


def rows(df):
    return sorted(tuple(r) for r in df.select(*runtime.KEY, "hit_count", "first_seen_ms", "last_seen_ms").collect())


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.startswith("part-"))


@pytest.mark.parametrize("fan", [2, 3])
def test_batches_repeats_and_merges(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(deltas, "FAN", fan)
    kept = deltas.Deltas(spark, f"file://{tmp_path}/t", runtime.combined)
    assert kept.read() is None
    every = []
    for i in range(9):
        batch = events(i, 20, (8 - i) * 100 if i % 2 else i * 100)  # late ones too
        every += batch
        for _ in range(2 if i in (3, 7) else 1):  # a batch that was cut off comes again
            kept.write(runtime.fold(spark.createDataFrame(batch, SCHEMA)), i)
    assert rows(kept.read()) == rows(runtime.fold(spark.createDataFrame(every, SCHEMA)))
    assert len(os.listdir(tmp_path / "t")) < 9


def test_a_batch_writes_its_own_size(spark, tmp_path):
    kept = deltas.Deltas(spark, f"file://{tmp_path}/t", deltas.last_wins(["k"], ["batch"]))
    kept.write(spark.range(200_000).select(F.col("id").alias("k"), F.lit(0).alias("batch")), 0)
    large = size(tmp_path / "t")
    for i in (1, 2):
        kept.write(spark.createDataFrame([(5, i), (10**9 + i, i)], "k long, batch int"), i)
    assert size(tmp_path / "t") - large < large / 50
    got = kept.read()
    assert got.count() == 200_002 and [r["batch"] for r in got.where("k = 5").collect()] == [2]
    # a folder that was not written to its end does not count
    os.remove(tmp_path / "t" / "2-2" / "_SUCCESS")
    assert [r["batch"] for r in kept.read().where("k = 5").collect()] == [1]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    base = f"file://{tmp_path}"
    feed = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    every = []
    for i in range(2):
        batch = events(i, 50, i * 50)
        every += batch
        spark.createDataFrame(batch, SCHEMA).coalesce(2).write.mode("append").parquet(f"{base}/in")
        runtime.start(feed(), f"{base}/table", f"{base}/checkpoint").awaitTermination()
        assert rows(runtime.stored_edges(spark, f"{base}/table")) == rows(runtime.fold(spark.createDataFrame(every, SCHEMA)))
