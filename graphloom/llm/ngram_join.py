"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact Jaccard decides.

A text's shingles are its runs of five words (the whole text if shorter), as 64-bit
hashes.  Texts with equal shingle sets are one representative with a multiplicity.

Each of TREES trees is a prefix trie: its labels, DEPTH min-hashes each, are put in order
(a sort by ranges, so no tree and no crowded prefix is one task), and the length of the
prefix that a label shares with the one before it gives the groups of every depth at once.
Representatives that share the longest prefixes are verified first.  The links found are
counted by similarity; where a depth finds too small a share of the links of some
similarity, prefixes are shortened by one value and what meets anew is verified, until the
share is RECALL for all of them.  The shortest prefix is the one with which pairs of the
least similarity meet with that probability.

A group whose members already meet elsewhere is verified once: members of groups that
overlap closely are pooled if verifying the pool costs less than verifying its groups.
A pair belongs to its pool, else to the first tree where it meets, and to the longest
depth, so it counts once.  Groups are cut into blocks, and each pair of blocks is work of
bounded size; small groups share a task.  Tasks give, for each representative, the number
of its links and the least representative it is linked with: no pairs are written, and no
link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import forget, runs

WORDS = 5
SIMILARITY = 0.8
#: Of 100,000 pairs of the least similarity, fewer than 3 do not meet at the depth that this gives, 4.
RECALL = 0.99995
TREES, DEPTH = 20, 6
#: Most shingles, and representatives, in a block of a group.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 1000
#: A group is cut into up to SPREAD blocks of at least LEAST_SETS before blocks grow to BLOCK_SETS.
SPREAD, LEAST_SETS = 16, 64
#: Rows of one group that meet what is known of the group in one place.
HOT = 128
#: Representatives of small groups that share a task.
TASK_SETS = 1000
#: Similarities are told apart by this much when recall is measured.
STRATUM = 0.01
#: Words a task remembers the hashes of.
MEMO = 100_000

_U = np.uint64


def met(similarity, depth: int, trees: int = TREES):
    """The probability that a pair of that similarity shares a prefix of that depth in some tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def least_depth(similarity=SIMILARITY, trees=TREES, longest=DEPTH, recall=RECALL) -> int:
    """The longest prefix with which a pair of that similarity meets in some tree with probability recall."""
    return next((d for d in range(longest, 1, -1) if met(similarity, d, trees) >= recall), 1)


def _mix(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


class _Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int = WORDS):
        from xxhash import xxh3_64_intdigest

        self.words, self.digest, self.memo = words, xxh3_64_intdigest, {}
        self.powers = [_U(int(x) | 1) for x in _mix(np.arange(1, words + 1, dtype=np.uint64))]

    def _hashes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        fresh = set(words).difference(memo)
        memo.update(zip(fresh, map(self.digest, fresh), strict=True))
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list) -> list[np.ndarray]:
        # bytes split at the six white space characters only
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        flat = self._hashes([w for s in split for w in s])
        n = np.fromiter(map(len, split), np.int64, len(split))
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(flat) - self.words + 1), np.uint64)
            for i, p in enumerate(self.powers):
                rolled += flat[i : i + len(rolled)] * p
        rolled = _mix(rolled)
        out, at = [], 0
        for m in n.tolist():
            if m >= self.words:
                out.append(np.unique(rolled[at : at + m - self.words + 1]))
            elif m:
                with np.errstate(over="ignore"):
                    one = _U(m)
                    for h in flat[at : at + m]:
                        one = one * _U(0x9E3779B97F4A7C15) + h
                out.append(_mix(np.array([one], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += m
        return out


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, as two signed numbers."""
    from xxhash import xxh3_128_digest

    a, b = np.frombuffer(xxh3_128_digest(shingles.tobytes()), "<i8")
    return int(a), int(b)


def _hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> _U(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> _U(32)).astype(np.uint32)


def _signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The low 16 bits of each min-hash; unlike sets share one by chance once in 65,536 times, which verification settles."""
    x = (shingles >> _U(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):  # a long text in slices
        h = x[None, i : i + 2048] * a[:, None] + b[:, None]
        h ^= h >> np.uint32(15)
        least = np.minimum(least, h.min(axis=1))
    return least.astype(">u2")


def signatures(docs: DataFrame, *, id_column="doc_id", text_column="text", words=WORDS, trees=TREES, depth=DEPTH) -> DataFrame:
    """rid, __file, __row, doc_id, n (shingles), d1, d2 (digest of the set) and labels (of all trees; null without words).

    docs is located().  rid is a number of the row that holds for this table once it is written.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        shingler = _Shingler(words)
        a, b = _hash_functions(trees * depth)
        for pdf in common.trimmed(batches):
            texts, out = pdf["text"].tolist(), []
            for run in runs(texts):
                for s in shingler.sets(texts[run]):
                    out.append((len(s), *_digest(s), _signature(s, a, b).tobytes() if len(s) else None))
            n, d1, d2, labels = zip(*out, strict=True) if out else ((), (), (), ())
            yield pdf.drop(columns="text").assign(n=n, d1=d1, d2=d2, labels=labels)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "__file", "__row", F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(sign, f"rid long, __file long, __row long, doc_id {kind}, n long, d1 long, d2 long, labels binary")


class Forest:
    """The sorted tries of representatives (rid, labels): rows that share a prefix of the least depth with a neighbour.

    at(depth) gives rid and group, a number for each prefix of that depth.
    """

    def __init__(self, reps: DataFrame, trees: int, depth: int, floor: int):
        self.depths = list(range(floor, depth + 1))
        spark, wide = reps.sparkSession, 2 * depth
        label = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(F.col("labels"), t * wide + 1, F.lit(wide)))
        rows = reps.select("rid", F.posexplode(label).alias("tree", "label")).select("tree", "label", "rid")
        rows = rows.repartitionByRange(common.partitions(spark), "tree", "label", "rid").sortWithinPartitions("tree", "label", "rid")
        self.rows = common.stored(rows.mapInPandas(_climb(self.depths, depth), "part long, rid long, tree int, groups array<long>, first binary, last binary"), "forest")
        # a row for each partition: its first and last label, and the groups of its last row
        edges = sorted(self.rows.where("first IS NOT NULL").drop("rid", "tree").collect(), key=lambda r: r["part"])
        self.renamed: list[list[tuple[int, int]]] = [[] for _ in self.depths]
        before, known = b"", []
        for r in edges:
            common_values = _shared(before, bytes(r["first"])) if before else 0
            now = list(r["groups"])
            for k, d in enumerate(self.depths):
                if common_values >= d:  # the partition goes on with the group that the one before it ended with
                    own = r["part"] << 33
                    self.renamed[k].append((own, known[k]))
                    now[k] = known[k] if now[k] == own else now[k]
            before, known = bytes(r["last"]), now

    def at(self, depth: int) -> DataFrame:
        k = self.depths.index(depth)
        rows = self.rows.where("rid IS NOT NULL").select("rid", "tree", F.get("groups", F.lit(k)).alias("group"))
        if not self.renamed[k]:
            return rows
        names = self.rows.sparkSession.createDataFrame(self.renamed[k], "group long, other long")  # at most a row for each partition
        return rows.join(F.broadcast(names), "group", "left").select("rid", "tree", F.coalesce("other", "group").alias("group"))


def _shared(a: bytes, b: bytes) -> int:
    """Values that two labels with their trees before them share from the start; 0 in different trees."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    return int(np.logical_and.accumulate(x[1:] == y[1:]).sum()) if x[0] == y[0] else 0


def _climb(depths: list[int], depth: int):
    """Groups of each depth over rows in order. A group is named by the partition and the place in it of its first row."""

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        place, first, last = 0, None, None
        held: dict | None = None  # the last row, whose next one is not known yet
        starts = np.full(len(depths), -1, np.int64)

        def frame(rid, tree, groups):
            return pd.DataFrame({"part": part, "rid": rid, "tree": tree, "groups": list(groups), "first": None, "last": None})

        for pdf in batches:
            if not len(pdf):
                continue
            tree = pdf["tree"].to_numpy(np.int32)
            value = np.concatenate([tree[:, None], np.frombuffer(b"".join(pdf["label"]), ">u2").reshape(-1, depth)], axis=1).astype(np.uint16)
            first = value[0].tobytes() if first is None else first
            above = np.concatenate([(np.frombuffer(last, np.uint16) if last else ~value[0])[None, :], value[:-1]])
            shares = np.where(value[:, 0] == above[:, 0], np.logical_and.accumulate(value[:, 1:] == above[:, 1:], axis=1).sum(axis=1), 0)
            at = np.arange(place, place + len(pdf))
            groups = np.empty((len(pdf), len(depths)), np.int64)
            for k, d in enumerate(depths):
                groups[:, k] = np.maximum(np.maximum.accumulate(np.where(shares < d, at, -1)), starts[k])
            starts = groups[-1].copy()
            names = groups + (part << 33)
            rid = pdf["rid"].to_numpy(np.int64)
            # rows whose neighbours share too little meet nobody
            if held is not None and (held["keep"] or shares[0] >= depths[0]):
                yield frame(held["rid"], held["tree"], held["groups"])
            keep = shares >= depths[0]
            keep[:-1] |= shares[1:] >= depths[0]
            keep |= at == 0
            held = {"rid": rid[-1:], "tree": tree[-1:], "groups": names[-1:], "keep": bool(keep[-1])}
            some = np.flatnonzero(keep[:-1])
            if len(some):  # pandas gives lists of no rows the type float, which Arrow does not take for lists
                yield frame(rid[some], tree[some], names[some])
            place, last = place + len(pdf), value[-1].tobytes()
        if held is not None:
            yield frame(held["rid"], held["tree"], held["groups"])
            yield pd.DataFrame({"part": [part], "rid": [None], "tree": [None], "groups": [held["groups"][0]], "first": [first], "last": [last]}).astype({"rid": "Int64", "tree": "Int32"})

    return climb


def components(edges: DataFrame) -> DataFrame:
    """id and label (the least id of its component) for every node of edges (u, v: long).

    Labels spread to neighbours and labels' labels, so rounds grow with the logarithm of
    a component's length; nothing but the number of changes reaches the driver.
    """
    both = common.stored(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "edges")
    labels = held = common.stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, "id").join(far, "label", "left").select("id", F.col("label").alias("old"), F.least("label", "near", "far").alias("label"))
        new = common.stored(new, "labels")
        common.drop(held)
        done = new.where("label <> old").isEmpty()
        labels, held = new.select("id", "label"), new
        if done:
            common.drop(both)
            return labels


def _pools(rows: DataFrame, verified: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units to verify at one depth: (unit, tree, rid), tree -1 for a pool; pool of each rid that has one; sizes of the groups.

    Groups with the same members, and those that a longer prefix gave already, are left
    out.  Two rounds of least members name pools; a pool stands if the square of its size
    is at most the sum of the squares of the groups within it.
    """
    mixed = lambda seed: F.bit_xor(F.xxhash64("rid", F.lit(seed)))
    sized = rows.groupBy("group").agg(F.count("*").alias("size"), F.min("rid").alias("hub"), mixed(1).alias("x"), mixed(2).alias("y")).where("size > 1")
    sized = common.stored(sized, "groups")
    sizes = sized.select("group", "size")
    if verified is not None:
        sized = sized.join(verified, ["group", "size"], "left_anti")
    # groups are named in the order of trees: the least of equal ones is in the first tree
    own = sized.groupBy("size", "x", "y").agg(F.min(F.struct("group", "hub")).alias("g")).select("size", "g.group", "g.hub")
    inside = common.stored(rows.join(own, "group"), "met")
    # a large group's rows and its hub meet in many places
    parts = F.ceil(F.col("size") / HOT).cast("int")
    dealt = inside.select("rid", "group", F.pmod(F.xxhash64("rid", "group"), parts).alias("part"))
    near = inside.select("rid", "hub")
    for _ in range(2):
        pool = near.groupBy("rid").agg(F.min("hub").alias("pool"))
        hubs = inside.join(pool, "rid").groupBy("group").agg(F.min("pool").alias("hub"), F.first("size").alias("size"))
        hubs = hubs.select("group", "hub", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))
        near = dealt.join(hubs, ["group", "part"]).select("rid", "hub")
    pool = near.groupBy("rid").agg(F.min("hub").alias("pool"))
    labelled = common.stored(inside.select("rid", "tree", "group", "size").join(pool, "rid"), "pooled")
    pool = labelled.groupBy("rid").agg(F.first("pool").alias("pool"))
    whole = labelled.groupBy("group").agg(F.min("pool").alias("pool"), F.max("pool").alias("other"), F.first("size").alias("size"))
    whole = whole.where("pool = other").select("group", "pool", "size")
    work = whole.groupBy("pool").agg(F.sum(F.col("size") * F.col("size")).alias("work"))
    stand = pool.groupBy("pool").agg(F.count("*").alias("n")).join(work, "pool").where("n * n <= work").select("pool")
    pools = common.stored(pool.join(stand, "pool").select("rid", "pool"), "pools")
    left = labelled.join(whole.join(stand, "pool").select("group"), "group", "left_anti")
    units = pools.select(F.col("pool").alias("unit"), F.lit(-1).alias("tree"), "rid").union(left.select(F.col("group").alias("unit"), "tree", "rid"))
    return common.stored(units, "units"), pools, sizes


class _Unit:
    """Verifies the pairs of one unit that fall to it; sets are in order of size."""

    def __init__(self, pdf: pd.DataFrame, similarity: float, trees: int, depth: int, longest: int, first: bool, across: bool):
        self.rid, self.n, self.m, self.block = (pdf[c].to_numpy(np.int64) for c in ("rid", "n", "m", "block"))
        self.sets = [np.frombuffer(x, "<u8") for x in pdf["shingles"]]
        self.similarity, self.depth, self.first, self.across, self.longest = similarity, depth, first, across, longest
        self.tree = int(pdf["tree"].iloc[0])
        # whether pairs must be told apart by what they share
        self.told = not (first and self.tree < 0)
        self.pool = pdf["pool"].to_numpy(np.int64)
        if self.told:
            self.values = np.frombuffer(b"".join(pdf["labels"]), ">u2").astype(np.uint16).reshape(len(pdf), trees, longest)
        self.pools = None if first else np.array([list(x) for x in pdf["earlier"]], np.int64).reshape(len(pdf), -1)

    def falls(self, i: int, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) are this unit's and were not verified before."""
        ok = np.ones(len(j), bool)
        if self.across:  # the pairs within a block have a task of their own
            ok &= self.block[j] != self.block[i]
        if not self.told:
            return ok
        same = self.values[j, :, : self.depth] == self.values[i, None, :, : self.depth]
        shared = same.all(axis=2)
        if self.tree >= 0:
            ok &= shared.argmax(axis=1) == self.tree
            ok &= shared[:, self.tree]
            ok &= (self.pool[j] != self.pool[i]) | (self.pool[i] < 0)
        if not self.first:
            if self.depth < self.longest:
                more = shared & (self.values[j, :, self.depth] == self.values[i, None, :, self.depth])
                ok &= ~more.any(axis=1)
            ok &= ~((self.pools[j] == self.pools[i]) & (self.pools[i] >= 0)).any(axis=1)
        return ok

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links and the least linked representative of each, and the number of linked pairs by similarity."""
        n, s = self.n, self.similarity
        links, root = np.zeros(len(n), np.int64), np.arange(len(n))
        bins = np.zeros(_strata(s), np.int64)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        _, at = np.unique(np.concatenate(self.sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(n)])
        mark = np.zeros(int(at.max(initial=-1)) + 1, bool)
        # sizes of a linked pair differ at most by the similarity
        lasts = np.searchsorted(n, (n / s + 1e-9).astype(np.int64), "right")
        for i in range(len(n)):
            if lasts[i] <= i + 1:
                continue
            j = np.arange(i + 1, lasts[i])
            ok = self.falls(i, j)
            if not ok.any():
                continue
            own = at[starts[i] : starts[i + 1]]
            mark[own] = True
            if ok.all():
                both = np.add.reduceat(mark[at[starts[i + 1] : starts[lasts[i]]]], starts[i + 1 : lasts[i]] - starts[i + 1], dtype=np.int64)
            else:
                j = j[ok]
                size = n[j]
                ends = np.cumsum(size)
                both = np.add.reduceat(mark[at[np.repeat(starts[j] - (ends - size), size) + np.arange(ends[-1])]], ends - size, dtype=np.int64)
            mark[own] = False
            hit = both >= s * (n[i] + n[j] - both) - 1e-9
            j, both = j[hit], both[hit]
            links[i] += self.m[j].sum()
            links[j] += self.m[i]
            bins += np.bincount(np.clip(((both / (n[i] + n[j] - both) - s) / STRATUM).astype(int), 0, len(bins) - 1), minlength=len(bins))
            for k in j.tolist():
                a, b = find(i), find(k)
                if a != b:
                    root[max(a, b)] = min(a, b)
        return links, self.rid[[find(i) for i in range(len(n))]], bins


def _strata(similarity: float) -> int:
    return max(1, int(np.ceil((1 - similarity) / STRATUM - 1e-9)) + 1)


def _verify(similarity: float, trees: int, depth: int, longest: int, first: bool):
    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, bins = [], np.zeros(_strata(similarity), np.int64)
        pdf = pdf.drop_duplicates(["unit", "tree", "rid"]).sort_values(["tree", "unit", "n", "rid"]).reset_index(drop=True)
        change = np.flatnonzero((pdf["unit"].to_numpy()[1:] != pdf["unit"].to_numpy()[:-1]) | (pdf["tree"].to_numpy()[1:] != pdf["tree"].to_numpy()[:-1])) + 1
        edges = [0, *change.tolist(), len(pdf)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                unit = _Unit(pdf.iloc[a:b], similarity, trees, depth, longest, first, key[1] != key[2])
                links, root, found = unit.links()
                bins += found
                some = (links > 0) | (root != unit.rid)
                out.append(pd.DataFrame({"rid": unit.rid[some], "links": links[some], "root": root[some], "bins": None}))
        out.append(pd.DataFrame({"rid": [None], "links": [None], "root": [None], "bins": [bins.tolist()]}).astype({"rid": "Int64", "links": "Int64", "root": "Int64"}))
        return pd.concat([x.astype({"rid": "Int64", "links": "Int64", "root": "Int64"}) for x in out])

    return verify


def _shingled(docs: DataFrame, some: DataFrame, text_column: str, words: int) -> DataFrame:
    """some (__file, __row, rid, n, d1, d2, ...) with shingles, which docs, located(), is read for once."""
    wanted = common.small(some, some.count(), 512)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields if f.name not in ("__file", "__row"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = _Shingler(words)
        for pdf in common.trimmed(batches):
            texts = pdf["text"].tolist()
            for run in runs(texts):
                part = pdf.iloc[run].drop(columns="text").reset_index(drop=True)
                sets = shingler.sets(texts[run])
                found = np.array([_digest(s) for s in sets]).reshape(-1, 2)
                if not ((part["d1"].to_numpy() == found[:, 0]) & (part["d2"].to_numpy() == found[:, 1])).all():
                    raise ValueError("docs gives other rows each time it is read: write it first")
                part["shingles"] = [s.astype("<u8").tobytes() for s in sets]
                yield part

    rows = docs.select("__file", "__row", F.col(text_column).alias("text")).join(wanted, ["__file", "__row"]).drop("__file", "__row")
    return common.stored(rows.mapInPandas(again, f"{kinds}, shingles binary"), "shingles")


def _found(units: DataFrame, shingled: DataFrame, pools: DataFrame, earlier: list[DataFrame], similarity: float, trees: int, depth: int, longest: int) -> DataFrame:
    """rid, links and root of the links that units hold and no earlier depth did, and bins (rows without a rid): linked pairs by similarity."""
    sized = units.join(shingled.select("rid", "n"), "rid")
    per = sized.groupBy("unit", "tree").agg(F.sum("n").alias("all_n"), F.count("*").alias("sets"))
    fit = F.greatest(F.ceil(F.col("all_n") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_SETS), F.least(F.lit(SPREAD), F.ceil(F.col("sets") / LEAST_SETS))).cast("int")
    per = common.stored(per.select("unit", "tree", "sets", "all_n", fit.alias("blocks")), "unit-sizes")
    total = per.agg(F.sum("sets").alias("sets"), F.sum("all_n").alias("n")).first()
    tasks = int(max(1, (total["sets"] or 0) // TASK_SETS, (total["n"] or 0) // BLOCK_SHINGLES))
    rows = units.join(per.select("unit", "tree", "blocks"), ["unit", "tree"])
    block = F.pmod(F.xxhash64("rid"), "blocks").cast("int")
    # units of one block share tasks
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("unit", "tree"), F.lit(tasks))).otherwise(F.xxhash64("unit", "tree"))
    rows = rows.select("unit", "tree", "rid", task.alias("task"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("unit", "tree", "rid", "task", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # pools of this depth and the earlier ones; -1 for none
    for k, held in enumerate([pools, *earlier]):
        rows = rows.join(held.withColumnRenamed("pool", f"pool{k}"), "rid", "left").withColumn(f"pool{k}", F.coalesce(f"pool{k}", F.lit(-1).cast("long")))
    rows = rows.withColumn("earlier", F.array(*[f"pool{k + 1}" for k in range(len(earlier))]).cast("array<long>")).withColumnRenamed("pool0", "pool")
    rows = rows.select("unit", "tree", "rid", "task", "block", "i", "j", "pool", "earlier")
    rows = rows.join(shingled.drop("d1", "d2"), "rid")
    first = not earlier
    return rows.groupBy("task", "i", "j").applyInPandas(_verify(similarity, trees, depth, longest, first), "rid long, links long, root long, bins array<long>")


def join(docs: DataFrame, *, id_column="doc_id", text_column="text", words=WORDS, similarity=SIMILARITY, trees=TREES, depth=DEPTH, recall=RECALL) -> DataFrame:
    """One row per row of docs: doc_id, class_id, links.

    links: how many other rows have a Jaccard similarity of at least similarity with this
    one, equal texts among them.  class_id: the least doc_id of those reached over links.
    Texts without words (null, empty or white) have no shingles, so no links, and are
    classes of their own; a repeated row counts as a link.  Rows without a doc_id are
    compared as all others are; class_id is null only for a class without any doc_id.  An
    empty table gives no rows.
    """
    return _labelled(common.located(docs), id_column, text_column, words, similarity, trees, depth, recall).select("doc_id", "class_id", "links")


def _labelled(docs: DataFrame, id_column="doc_id", text_column="text", words=WORDS, similarity=SIMILARITY, trees=TREES, depth=DEPTH, recall=RECALL) -> DataFrame:
    """join() of docs, located(), with rid, __file, __row and label: a number for each class, null for rows without words."""
    floor = least_depth(similarity, trees, depth, recall)
    signed = common.stored(signatures(docs, id_column=id_column, text_column=text_column, words=words, trees=trees, depth=depth), "signed")
    some = signed.where("n > 0")
    reps = some.groupBy("d1", "d2").agg(F.count("*").alias("m"), F.min("doc_id").alias("doc_id"), F.min(F.struct("rid", "__file", "__row", "n", "labels")).alias("r"))
    reps = common.stored(reps.select("d1", "d2", "m", "doc_id", "r.*"), "representatives")
    forest = Forest(reps, trees, depth, floor)
    met_some = forest.at(floor).select("rid").distinct()
    shingled = _shingled(docs, reps.join(met_some, "rid").select("__file", "__row", "rid", "n", "m", "d1", "d2", "labels"), text_column, words)
    found, earlier, verified, bins = [], [], None, np.zeros(_strata(similarity), np.int64)
    least = np.minimum(similarity + STRATUM * np.arange(len(bins)), 1.0)
    for d in range(depth, floor - 1, -1):
        units, pools, sizes = _pools(forest.at(d), verified)
        new = common.stored(_found(units, shingled, pools, earlier, similarity, trees, d, depth), "links")
        found.append(new.where("rid IS NOT NULL").select("rid", "links", "root"))
        counts = new.where("bins IS NOT NULL").select(F.posexplode("bins").alias("k", "pairs")).groupBy("k").agg(F.sum("pairs").alias("pairs")).collect()
        for r in counts:  # a row for each stratum
            bins[r["k"]] += r["pairs"]
        earlier.append(pools)
        verified = sizes
        # the share of links that this depth finds, for each similarity that links have
        if bins.any() and (met(least, d, trees)[bins > 0] >= recall).all():
            break
    linked = found[0]
    for more in found[1:]:
        linked = linked.union(more)
    per = linked.groupBy("rid").agg(F.sum("links").alias("more"))
    tree = components(linked.select(F.col("rid").alias("u"), F.col("root").alias("v")).where("u <> v")).withColumnRenamed("id", "rid")
    known = reps.select("rid", "d1", "d2", "m", "doc_id").join(per, "rid", "left").join(tree, "rid", "left")
    known = common.stored(known.select("d1", "d2", "m", "doc_id", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("label", "rid").alias("label")), "known")
    classes = known.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    known = known.join(classes, "label").select("d1", "d2", (F.col("m") - 1 + F.col("more")).alias("links"), "class_id", "label")
    rows = some.join(known, ["d1", "d2"]).select("rid", "__file", "__row", "doc_id", "class_id", "links", "label")
    alone = signed.where("n = 0").select("rid", "__file", "__row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("label"))
    return rows.union(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each class the one with the least doc_id (null last, then the first) stays."""
    docs = common.located(docs)
    joined = common.stored(_labelled(docs, **options), "joined")
    # rows without words are classes of their own, each for itself
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    best = joined.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    dropped = joined.join(best, "label").where(F.col("rid") != F.col("best.rid")).select("__file", "__row")
    dropped = common.stored(dropped, "near-copies")
    return common.without(docs, dropped, dropped.count())
