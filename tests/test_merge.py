"""Three-way merges against a plain diff3, against git's where that is installed, and by hand."""

import random
import shutil
import subprocess

import pytest

from graphloom.operators import merge
from graphloom.sources import files

SCHEMA = "source long, pos int, line string"


def table(spark, texts):
    return spark.createDataFrame([(s, i, x) for s, lines in texts.items() for i, x in enumerate(lines)], SCHEMA)


def plain_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_matched(a, b):
    pairs = [(a.index(x), b.index(x)) for x in a if a.count(x) == 1 and b.count(x) == 1]
    anchors = [p for p in pairs if all((p[0] - q[0]) * (p[1] - q[1]) > 0 for q in pairs if q != p)]
    out = list(anchors)
    for (i, j), (k, m) in zip([(-1, -1), *anchors], [*anchors, (len(a), len(b))]):
        out += [(i + 1 + x, j + 1 + y) for x, y in plain_common(a[i + 1 : k], b[j + 1 : m])]
    return sorted(out)


def plain_merge(base, ours, theirs):
    to_ours, to_theirs = dict(plain_matched(base, ours)), dict(plain_matched(base, theirs))
    out, at = [], (0, 0, 0)
    for i in [*[i for i in range(len(base)) if i in to_ours and i in to_theirs], None]:
        stop = (len(base), len(ours), len(theirs)) if i is None else (i, to_ours[i], to_theirs[i])
        o, a, b = base[at[0] : stop[0]], ours[at[1] : stop[1]], theirs[at[2] : stop[2]]
        if a == b or b == o:
            out += a
        elif a == o:
            out += b
        else:
            out += ["<<<<<<< ours", *a, "=======", *b, ">>>>>>> theirs"]
        if i is not None:
            out.append(base[i])
            at = (stop[0] + 1, stop[1] + 1, stop[2] + 1)
    return out


def edited(rng, lines, word, moves=False):
    out = []
    for x in lines:
        r = rng.random()
        if r < 0.08:
            continue
        out.append(x if r > 0.16 else rng.choice([f"{word} {x}", f"same {x}"]))
        if rng.random() < 0.08:
            out.append(rng.choice([f"{word} after {x}", f"both after {x}"]))
    if moves and len(out) > 4:
        i, j, k = sorted(rng.sample(range(len(out) + 1), 3))
        out = out[:i] + out[j:k] + out[i:j] + out[k:]
    return out


def merged_of(spark, cases):
    sides = [table(spark, {s: c[i] for s, c in cases.items()}) for i in range(3)]
    got = {s: [] for s in cases}
    for r in merge.merged(*sides).orderBy("source", "pos").collect():
        assert r["pos"] == len(got[r["source"]])
        got[r["source"]].append(r["line"])
    return got


def test_common_by_bits():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        assert merge.common(a, b) == plain_common(a, b)
    a, b = ([rng.choice("abcdefgh") for _ in range(n)] for n in (600, 530))  # over several kept rows
    assert merge.common(a, b) == plain_common(a, b)


@pytest.mark.parametrize("moves", [False, True])
def test_against_plain(spark, moves):
    rng = random.Random(7 + moves)
    cases = {}
    for s in range(120):
        lines = [rng.choice(["}", "", f"line {i}", f"line {i}", f"x{rng.randrange(6)}"]) for i in range(rng.randrange(40))]
        cases[s] = (lines, edited(rng, lines, "ours", moves), edited(rng, lines, "theirs", moves))
    assert merged_of(spark, cases) == {s: plain_merge(*c) for s, c in cases.items()}
    pairs = {s: [] for s in cases}
    for r in merge.matched(table(spark, {s: c[0] for s, c in cases.items()}), table(spark, {s: c[1] for s, c in cases.items()})).orderBy("source", "old_pos").collect():
        pairs[r["source"]].append((r["old_pos"], r["new_pos"]))
    assert pairs == {s: plain_matched(c[0], c[1]) for s, c in cases.items()}


@pytest.mark.skipif(not shutil.which("git"), reason="git is not installed")
def test_against_git(spark, tmp_path):
    rng = random.Random(11)
    cases = {}
    for s in range(80):
        lines = [f"line {i}" for i in range(rng.randrange(1, 60))]  # different lines without moves have one longest common subsequence
        cases[s] = (lines, edited(rng, lines, "ours"), edited(rng, lines, "theirs"))
    got = merged_of(spark, cases)
    for s, case in cases.items():
        for name, lines in zip(("base", "ours", "theirs"), case):
            (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
        said = subprocess.run(["git", "merge-file", "-p", "--diff3", "-L", "ours", "-L", "base", "-L", "theirs", "ours", "base", "theirs"], cwd=tmp_path, capture_output=True, text=True).stdout.splitlines()
        want, in_base = [], False
        for x in said:
            in_base = (in_base or x.startswith("|||||||")) and x != "======="
            if not in_base:
                want.append(x)
        assert got[s] == want, s


def test_by_hand(spark):
    cases = {
        1: (["a", "b", "c"], ["a", "B", "c"], ["a", "b", "c", "d"]),  # apart
        2: (["a", "b", "c"], ["a", "B", "c"], ["a", "x", "c"]),  # meet
        3: (["a", "b"], [], ["a", "b"]),  # removed on one side
        4: (["a", "b"], [], ["a", "z"]),  # removed and changed
        5: ([], ["n"], ["n"]),  # made alike
        6: ([], ["n"], ["m"]),  # made apart
        7: (["a"], ["a"], ["a"]),  # untouched
        8: (["}", "}", "}"], ["}", "}"], ["}", "}", "}", "}"]),  # repeated lines only
        9: ([None, "b"], ["", "b"], [None, "c"]),  # null reads as empty
    }
    got = merged_of(spark, cases)
    assert got[1] == ["a", "B", "c", "d"] and got[2] == ["a", "<<<<<<< ours", "B", "=======", "x", ">>>>>>> theirs", "c"]
    assert got[3] == [] and got[4] == ["<<<<<<< ours", "=======", "a", "z", ">>>>>>> theirs"] and got[5] == ["n"]
    assert got[6] == ["<<<<<<< ours", "n", "=======", "m", ">>>>>>> theirs"] and got[7] == ["a"] and got[9] == ["", "c"]
    sides = [table(spark, {s: c[i] for s, c in cases.items()}) for i in range(3)]
    assert {r["source"]: (r["changes"], r["clean"]) for r in merge.outcome(*sides).collect()} == {1: (2, True), 2: (1, False), 3: (1, True), 4: (1, False), 5: (1, True), 6: (1, False), 8: (1, False), 9: (1, True)}
    text = merge.merged(*sides).where("source = 2").selectExpr("source", "pos + 1 AS pos", "line")
    head = spark.createDataFrame([(2, 0, "CONFLICT (content): Merge conflict in f")], SCHEMA)
    found = files.merge_conflicts(head.unionByName(text))
    assert [(r["start_line"], r["end_line"]) for r in found.collect()] == [(3, 7)]


def test_names_as_sources_and_no_rows(spark):
    base, ours, theirs = (spark.createDataFrame([("a/b.py", i, x) for i, x in enumerate(t)], "source string, pos long, line string") for t in (["x", "x", "y"], ["x", "z", "x", "y"], ["x", "x", "y", "x"]))
    assert [r["line"] for r in merge.merged(base, ours, theirs).orderBy("pos").collect()] == ["x", "z", "x", "y", "x"]
    nothing = base.limit(0)
    assert merge.merged(nothing, nothing, nothing).collect() == [] and merge.chunks(nothing, nothing, nothing).collect() == []
    assert {r["kind"] for r in merge.chunks(nothing, ours, nothing).collect()} == {"ours"}
