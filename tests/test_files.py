"""Chunks of files against the plain loop; a walk opens the files that it keeps, and no others."""

import random

import pytest

from graphloom.sources import files


def filled(lengths, budget, most):
    chunk = used = 0
    out = []
    for i, n in enumerate(lengths):
        if n > most:
            continue
        if used and used + n > budget:
            chunk, used = chunk + 1, 0
        used += n
        out.append((i, n, chunk))
    return out


@pytest.mark.parametrize("seed, budget, most", [(1, 100, 60), (2, 1000, 1000), (3, 50, 50)])
def test_chunks_as_a_plain_loop(spark, seed, budget, most):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, rng.randrange(most + 20), most, most + 1]) for _ in range(300)]
    got = files.chunks(spark.createDataFrame(list(enumerate(lengths)), "ord long, length long").repartition(5), budget, most)
    assert sorted(tuple(r) for r in got.select("ord", "length", "chunk").collect()) == filled(lengths, budget, most)


def test_chunks_of_few_files(spark):
    of = lambda x: [tuple(r) for r in files.chunks(spark.createDataFrame(list(enumerate(x)), "ord long, length long"), 10, 10).orderBy("ord").collect()]
    assert of([0, 0, 0]) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)] and of([10, 0, 10]) == [(0, 10, 0), (1, 0, 0), (2, 10, 1)]
    assert files.chunks(spark.createDataFrame([], "ord long, length long")).count() == 0
    with pytest.raises(ValueError):
        files.chunks(spark.range(1).selectExpr("id AS ord", "id AS length"), 5, 6)


def test_ignored_contents_are_not_read(spark, tmp_path):
    for name, text in {"src/a.ts": "const a = 1;", "src/b [1] {x}.ts": "let b;", "node_modules/big.ts": "x" * 5000, "k=1/c.py": "c = 1", "own/skip.ts": "y" * 5000, "notes.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("own\n")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # a larger file that is opened fails
    try:
        got = files.walk(spark, str(tmp_path)).collect()
        one = files.walk(spark, str(tmp_path), most=1).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r["file_path"].removeprefix(f"{tmp_path}/"): (r["content"], r["language"]) for r in got} == {"src/a.ts": ("const a = 1;", "typescript"), "src/b [1] {x}.ts": ("let b;", "typescript"), "k=1/c.py": ("c = 1", "python")}
    assert [r["file_path"].rsplit("/", 1)[1] for r in one] == ["c.py"]
    assert files.walk(spark, str(tmp_path / "own"), ignore=("*",)).count() == 0
