"""The pipeline against a plain version of its deterministic stages, and what each stage must keep."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

import corpus_pipeline
from graphloom.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    frames = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.common.stored(stage(spark, kept, SF), "t")
        assert kept.columns == columns
        frames.append(kept.toPandas())
    raw, clean, single, unlike, mixed = frames
    # toxicity: just the rows under the threshold
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels, held_out=toxicity.held_out)
    assert set(clean["doc_id"]) == {i for i, t in zip(raw["doc_id"], raw["text"], strict=True) if model.score(t) < toxicity.THRESHOLD}
    # exact copies: the longest original, then the least id
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    best = {}
    for i, t in zip(clean["doc_id"], clean["text"], strict=True):
        best[norm(t)] = min(best.get(norm(t), (0, 10**18)), (-len(t), i))
    assert Counter(single["doc_id"]) == Counter(i for _, i in best.values())
    # near copies: one of each class
    sets = {}
    for i, t in zip(single["doc_id"], single["text"], strict=True):
        w = t.encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(unlike["doc_id"]) == {find(i) for i in ids}
    # the mix: as often as mix() says
    taken = mixing.mix(spark.createDataFrame(unlike)).decisions.toPandas()
    assert Counter(mixed["doc_id"]) == Counter({r.doc_id: r.copies for r in taken.itertuples() if r.copies})
    # packing: all tokens of all that is mixed, in whole sequences
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas()
    assert Counter(packed.loc[packed["piece"] == 0, "doc_id"]) == Counter(mixed["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_run_agrees_with_its_stages(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    again = corpus_pipeline.run(spark, SF).toPandas()
    key = lambda d: Counter(map(tuple, d[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist()))
    assert key(got) == key(again) and got["sequence_id"].nunique() == again["sequence_id"].nunique()


def test_pipeline_takes_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n", "en", "a", 2), (None, "some words of text to keep here", "en", "b", 3), (4, "x " * 5000, "en", "a", 9), (4, "x " * 5000, "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        now = corpus_pipeline.common.stored(frame, "odd")
        for _, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.common.stored(stage(spark, now, SF), "odd")
        out = now.toPandas()
        assert isinstance(out, pd.DataFrame) and (len(out) > 0) == (frame is docs)
    assert zlib.crc32(b"") == 0 and np.isfinite(1.0)
