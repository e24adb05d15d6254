"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

Training counts words and word pairs of all training texts.  Pair counts go, quantised,
into a log-frequency Bloom filter (Talbot and Osborne, 2007): a pair of level q is
inserted with each of the levels 1 to q, and a reader probes level after level until one
is missing.  A pair's probability is smoothed towards the word's own:

    p(w | h) = (c(h, w) + t(h) p(w)) / (c(h) + t(h)),   p(w) = (c(w) + 1) / (N + V + 1)

where t(h) is the number of different words after h (Witten and Bell).  It is not kept for
each word but taken as c(h) ** beta, with the one beta for which these numbers add up to
the number of different pairs.  Word counts are kept exactly, under 64-bit hashes.

The model is cut by hash into shards; every task merges counts that were summed map-side,
so no word, however frequent, makes a large shard.  Shards are packed into groups of at
most GROUP_BYTES, which workers hold one at a time.  A model of one group is applied in
one pass.  With more groups texts are read in runs, the different words and pairs of a run
go to the groups that know them, and what these answer comes back to the run: the corpus is
read once, whatever the size of the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .idfile import open_fs
from .tokens import runs

#: The end of a text, a token that no word equals.
END = b" end"
#: Most bytes of the model that a worker holds.
GROUP_BYTES = 256 << 20
#: Most bytes of text for each shard (what a shard counts, and the task that builds it holds, follows from that), and
#: least shards for each shuffle partition, so that tasks get about as many.
SHARD_TEXT, SHARDS_A_TASK = 32 << 20, 4
#: Runs of texts whose questions to one group share a task.
RUNS_A_TASK = 64
#: Bits of the filter for each inserted (pair, level), and probes of each.
BITS, PROBES = 8, 5
#: Words a worker remembers, and counts a task holds before it hands them on.
MEMO, HELD = 400_000, 3_000_000

_U = np.uint64


def levels() -> np.ndarray:
    """The least count of each level: 1, 2, 3, 4, then half as much again each time."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


LEVELS = levels()
#: The count a level stands for: the middle of its counts; index 0 is for none.
VALUES = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def pair_keys(hashes: np.ndarray, starts: np.ndarray, end: np.uint64) -> np.ndarray:
    """A key for each token and the one before it; before a text's first token comes the end."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts] = end
    with np.errstate(over="ignore"):
        return mix(before * _U(0xD6E8FEB86659FD93) + hashes)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards follow the order of keys, so that shards in turn hold keys in order."""
    return ((keys >> _U(32)) * _U(shards)) >> _U(32)


def positions(keys: np.ndarray, level: int, probe: int, size: np.ndarray) -> np.ndarray:
    """The bit, below size, of one probe."""
    with np.errstate(over="ignore"):
        a = mix(keys ^ (_U(level) * _U(0xA24BAED4963EE407)))
        b = (a >> _U(32)) | _U(1)
        return (((a + _U(probe) * b) & _U(0xFFFFFFFF)) * size) >> _U(32)


class Words:
    """Numbers for words, with their hashes; starts afresh when it holds MEMO of them."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        self.digest = xxh3_64_intdigest
        self.end = _U(xxh3_64_intdigest(END))
        self.reset()

    def reset(self):
        self.memo: dict[bytes, int] = _Numbers()
        self.hashes = np.zeros(0, np.uint64)

    def read(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens in a row, and how many each text has; every text ends with END."""
        if len(self.memo) > MEMO:
            self.reset()
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        for s in split:
            s.append(END)
        n = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        known = len(self.hashes)
        if len(self.memo) > known:
            it = reversed(self.memo)
            fresh = [next(it) for _ in range(len(self.memo) - known)][::-1]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(self.digest, fresh), np.uint64, len(fresh))])
        return numbers, n


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class _Held:
    """Counts of keys, summed when there are many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys, counts=None):
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts))
        self.size += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in self.parts]])
        counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in self.parts]])
        self.parts, self.size = [], 0
        return _sum(keys, counts)


def _counted(docs: DataFrame, text_column: str, shards: int) -> DataFrame:
    """shard, kind (0 words, 1 pairs), keys and counts (binary): counts summed within each task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, singles, pairs = Words(), _Held(), _Held()

        def rows():
            out = []
            for kind, held in enumerate((singles, pairs)):
                keys, counts = held.take()
                edges = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(edges)):
                    a, b = edges[s], edges[s + 1]
                    out.append((int(s), kind, keys[a:b].tobytes(), counts[a:b].astype("<u8").tobytes()))
            return pd.DataFrame(out, columns=["shard", "kind", "keys", "counts"])

        for pdf in common.trimmed(batches):
            texts = pdf[text_column].tolist()
            for run in runs(texts):
                numbers, n = words.read(texts[run])
                hashes = words.hashes[numbers]
                seen, counts = np.unique(numbers, return_counts=True)
                singles.add(words.hashes[seen], counts)
                pairs.add(pair_keys(hashes, np.cumsum(n) - n, words.end))
                if singles.size + pairs.size > HELD:
                    for held in (singles, pairs):
                        held.add(*held.take())
                    if singles.size + pairs.size > HELD // 2:
                        yield rows()
        if singles.parts or pairs.parts:
            yield rows()

    return docs.select(text_column).mapInPandas(count, "shard int, kind int, keys binary, counts binary")


@dataclass
class Model:
    """Where the groups are, and the sums that hold for the whole corpus."""

    files: list[str]
    shards: list[tuple[int, int]]  # of each group: first shard and the one after the last
    n_shards: int
    n: int  # training tokens
    v: int  # distinct ones
    beta: float  # a word seen c times has c ** beta different ones after it
    end: int = 0

    @property
    def log_base(self) -> float:
        return float(np.log10(self.n + self.v + 1))


def train(docs: DataFrame, *, text_column="text") -> Model:
    """Count all of docs' texts. Null texts are empty; an empty table gives a model that knows nothing."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_column).cast("long"))).first()[0] or 0
    shards = max(SHARDS_A_TASK * common.partitions(spark), -(-size // SHARD_TEXT))
    path = common.work_path(spark, "lm")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])

        def kind(k):
            some = pdf[pdf["kind"] == k]
            keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, "<u8") for x in some["keys"]]])
            counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, "<u8").astype(np.int64) for x in some["counts"]]])
            return _sum(keys, counts)

        words, word_counts = kind(0)
        pairs, pair_counts = kind(1)
        level = np.searchsorted(LEVELS, pair_counts, "right")
        bits = max(64, -(-int(level.sum()) * BITS // 64) * 64)
        flags = np.zeros(bits, bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            own = pairs[level >= q]
            for i in range(PROBES):
                flags[positions(own, q, i, _U(bits))] = True
        file = f"{path}/shard-{shard:06d}"
        _write(file, [words.tobytes(), word_counts.astype("<u8").tobytes(), np.packbits(flags, bitorder="little").tobytes()])
        bins = np.searchsorted(LEVELS, word_counts, "right")
        sums, numbers = np.bincount(bins, word_counts, len(LEVELS) + 1), np.bincount(bins, minlength=len(LEVELS) + 1)
        common.release()
        return pd.DataFrame(
            {
                "shard": [shard], "file": [file], "words": [len(words)], "bits": [bits], "n": [int(word_counts.sum())],
                "pairs": [len(pairs)], "sums": [sums.tolist()], "numbers": [numbers.astype(float).tolist()],
            }
        )

    built = _counted(docs, text_column, shards).groupBy("shard").applyInPandas(
        build, "shard int, file string, words long, bits long, n long, pairs long, sums array<double>, numbers array<double>"
    )
    built = common.stored(built, "lm-shards")
    totals = built.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "words", "pairs")]).first()
    # a row for each level of counts
    bins = built.select(F.posexplode(F.arrays_zip("sums", "numbers")).alias("bin", "b")).groupBy("bin").agg(F.sum("b.sums").alias("sums"), F.sum("b.numbers").alias("numbers")).collect()
    sums, numbers = (np.array([r[c] for r in bins] or [0.0]) for c in ("sums", "numbers"))
    # two numbers for each shard decide which shards make a group
    sizes = built.select("shard", (16 * F.col("words") + F.col("bits") / 8).alias("bytes")).toPandas().sort_values("shard")
    place = np.concatenate([[0], np.cumsum(sizes["bytes"].to_numpy(float))[:-1]]) // GROUP_BYTES if len(sizes) else np.zeros(0)
    starts = sizes["shard"].to_numpy()[np.flatnonzero(np.diff(place, prepend=-1.0))].tolist()
    groups = list(zip([0, *starts[1:]], [*starts[1:], shards], strict=True)) or [(0, shards)]
    files = [f"{path}/group-{i:06d}" for i in range(len(groups))]
    _pack(built, files, groups)
    from xxhash import xxh3_64_intdigest

    return Model(files, groups, shards, totals["n"], totals["words"], _beta(sums, numbers, totals["pairs"]), xxh3_64_intdigest(END))


def _beta(sums: np.ndarray, numbers: np.ndarray, pairs: int) -> float:
    """beta with the sum over contexts of c ** beta = different pairs; contexts in bins of like counts."""
    c, k = sums[numbers > 0] / numbers[numbers > 0], numbers[numbers > 0]
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (k * c**mid).sum() < pairs else (low, mid)
    return low


def _write(path: str, parts: list[bytes]) -> None:
    system, name = open_fs(path)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(part) as out:
        for x in parts:
            out.write(x)
    system.move(part, name)


def _pack(built: DataFrame, files: list[str], groups: list[tuple[int, int]]) -> None:
    """One file for each group: all words, all counts, all bits, and a table of bits by shard; a task writes a group from its shards' files."""
    spark = built.sparkSession
    starts = np.array([a for a, _ in groups])

    @F.pandas_udf("int")
    def group_of(shard: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, shard.to_numpy(), "right") - 1)

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["file"].notna()].sort_values("shard")
        system, name = open_fs(files[int(key[0])])
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        system.create_dir(name.rpartition("/")[0], recursive=True)
        words, bits = pdf["words"].astype("int64").to_numpy(), pdf["bits"].astype("int64").to_numpy()
        first, last = groups[int(key[0])]
        table = np.zeros((last - first, 2), "<u8")  # first bit and number of bits
        table[pdf["shard"].astype("int64").to_numpy() - first] = np.stack([np.cumsum(bits) - bits, bits], axis=1)
        with system.open_output_stream(part) as out:
            out.write(np.array([words.sum(), bits.sum(), len(table)], "<u8").tobytes())
            out.write(table.tobytes())
            for what in range(3):
                for file, w, b in zip(pdf["file"], words.tolist(), bits.tolist(), strict=True):
                    own, path = open_fs(file)
                    with own.open_input_file(path) as f:
                        f.seek((0, 8 * w, 16 * w)[what])
                        out.write(f.read((8 * w, 8 * w, b // 8)[what]))
        system.move(part, name)
        return pd.DataFrame({"g": [int(key[0])]})

    every = spark.createDataFrame([(i,) for i in range(len(files))], "g int")  # groups without a shard have a file too
    held = every.join(built.select(group_of("shard").alias("g"), "shard", "file", "words", "bits"), "g", "left")
    held.groupBy("g").applyInPandas(write, "g int").count()


class Group:
    """Part of the model, held by a worker: counts of words, and levels of pairs, of some shards."""

    def __init__(self, path: str, shards: tuple[int, int], n_shards: int):
        from pyarrow import fs

        system, name = open_fs(path)
        if isinstance(system, fs.LocalFileSystem):
            data = np.memmap(name, np.uint8, "r")  # workers of one machine share it
        else:
            with system.open_input_file(name) as f:
                data = np.frombuffer(f.read(), np.uint8)
        words, bits, n = (int(x) for x in data[:24].view("<u8"))
        self.first, self.last, self.n_shards = *shards, n_shards
        at = 24 + 16 * n
        self.table = data[24:at].view("<u8").reshape(n, 2).astype(np.uint64)
        self.words = data[at : at + 8 * words].view("<u8")
        self.counts = data[at + 8 * words : at + 16 * words].view("<u8")
        self.bits = data[at + 16 * words : at + 16 * words + bits // 8]

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Exact counts of words; 0 for those that other groups or none have."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], 0).astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels of pairs; 0 for those of other groups or none."""
        out = np.zeros(len(keys), np.uint8)
        shard = shard_of(keys, self.n_shards)
        own = (shard >= _U(self.first)) & (shard < _U(self.last))
        place = np.where(own, shard - _U(self.first), _U(0))
        first, size = self.table[place, 0], self.table[place, 1]
        alive = np.flatnonzero(own & (size > 0))
        level = 1
        while len(alive):
            for i in range(PROBES):
                own = keys[alive]
                at = first[alive] + positions(own, level, i, size[alive])
                alive = alive[(self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1]
                if not len(alive):
                    break
            out[alive] = level
            level += 1
        return out


@lru_cache(maxsize=1)
def _group(path: str, shards: tuple[int, int], n_shards: int) -> Group:
    return Group(path, shards, n_shards)


class _Reader:
    """Counts and levels of the tokens of texts, from a model of one group; counts of words are looked up once."""

    def __init__(self, group: Group):
        self.group, self.words, self.counts, self.at = group, Words(), np.zeros(0, np.int64), None

    def read(self, texts):
        numbers, n = self.words.read(texts)
        if self.at is not self.words.memo:
            self.at, self.counts = self.words.memo, np.zeros(0, np.int64)
        fresh = self.words.hashes[len(self.counts) :]
        if len(fresh):
            self.counts = np.concatenate([self.counts, self.group.count(fresh)])
        keys = pair_keys(self.words.hashes[numbers], np.cumsum(n) - n, self.words.end)
        return n, self.counts[numbers], self.group.level(keys)


def _finish(model: Model, end_count: int, n: np.ndarray, c: np.ndarray, level: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.cumsum(n) - n
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[starts] = end_count
    base = np.log10(c + 1.0) - model.log_base
    pair = np.minimum(VALUES[level], np.minimum(before, np.maximum(c, 0)))
    kinds = np.where(before > 0, np.maximum(before, 1.0) ** model.beta, 1.0)
    p = (pair + kinds * 10.0**base) / (before + kinds)
    total = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
    return {"n_tokens": n, "n_known": total((c > 0).astype(np.int64)), "train_tokens": np.full(len(n), model.n), "base_score": total(base), "score": total(np.log10(p))}


RESULTS = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, *, text_column="text") -> DataFrame:
    """docs, without text, with n_tokens, n_known, train_tokens, base_score and score (log10).

    A null or empty text has one token, the end.  Tokens that training did not see get
    the probability of count 0; with an empty training set that is 1 for every token.
    """
    own = {text_column, *(x.split()[0] for x in RESULTS.split(", "))}  # columns of these names give way to the results
    rest = [c for c in docs.columns if c not in own]
    ends = _end_count(docs.sparkSession, model)
    if len(model.files) > 1:
        docs = common.located(docs)
        return docs.select("__file", "__row", *rest).join(_from_groups(docs, model, text_column, ends), ["__file", "__row"]).drop("__file", "__row")
    known = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in rest)

    def one_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(_group(model.files[0], tuple(model.shards[0]), model.n_shards))
        for pdf in common.trimmed(batches):
            texts = pdf[text_column].tolist()
            for run in runs(texts):
                yield pdf.iloc[run][rest].reset_index(drop=True).assign(**_finish(model, ends, *reader.read(texts[run])))

    return docs.select(*rest, text_column).mapInPandas(one_pass, known + RESULTS)


def _from_groups(docs: DataFrame, model: Model, text_column: str, ends: int) -> DataFrame:
    """__file, __row and the results for each row of docs, located(), by a model of several groups.

    A run is about two million characters of neighbouring texts, so what is known of one
    fits a task however large the corpus is.
    """
    end = _U(model.end)
    edges = np.array([a for a, _ in model.shards] + [model.n_shards])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        run_number, words = TaskContext.get().partitionId() << 33, Words()
        for pdf in common.trimmed(batches):
            texts = pdf[text_column].tolist()
            for run in runs(texts):
                numbers, n = words.read(texts[run])
                seen, tokens = np.unique(numbers, return_inverse=True)
                yield pd.DataFrame([{
                    "run": run_number, "file": pdf["__file"].iloc[run].tolist(), "row": pdf["__row"].iloc[run].tolist(), "n": n.tolist(),
                    "words": np.sort(words.hashes[seen]).tobytes(), "tokens": np.argsort(np.argsort(words.hashes[seen]))[tokens].astype("<u4").tobytes(),
                }])
                run_number += 1

    def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The run's words in order, its tokens as places in them, texts' numbers of tokens, keys of the tokens' pairs."""
        words, tokens, n = np.frombuffer(row.words, "<u8"), np.frombuffer(row.tokens, "<u4"), np.array(row.n, np.int64)
        return words, tokens, n, pair_keys(words[tokens], np.cumsum(n) - n, end)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                words, _, _, keys = unpack(row)
                out = []
                for kind, some in enumerate((words, np.unique(keys))):
                    cut = np.searchsorted(shard_of(some, model.n_shards).astype(np.int64), edges)
                    out += [(row.run, g, kind, some[cut[g] : cut[g + 1]].tobytes()) for g in np.flatnonzero(np.diff(cut)).tolist()]
                yield pd.DataFrame(out, columns=["run", "group", "kind", "keys"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                group, keys = _group(model.files[row.group], tuple(model.shards[row.group]), model.n_shards), np.frombuffer(row.keys, "<u8")
                out.append((row.run, row.group, row.kind, (group.level(keys) if row.kind else group.count(keys)).tobytes()))
            yield pd.DataFrame(out, columns=["run", "group", "kind", "known"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                _, tokens, n, keys = unpack(row)
                known = sorted(row.answers, key=lambda a: (a["kind"], a["group"]))
                counts = np.frombuffer(b"".join(a["known"] for a in known if a["kind"] == 0), np.int64)
                levels = np.frombuffer(b"".join(a["known"] for a in known if a["kind"] == 1), np.uint8)
                _, at = np.unique(keys, return_inverse=True)
                yield pd.DataFrame({"__file": row.file, "__row": row.row} | _finish(model, ends, n, counts[tokens], levels[at]))

    held = docs.select("__file", "__row", text_column).mapInPandas(read, "run long, file array<long>, row array<long>, n array<long>, words binary, tokens binary")
    held = common.stored(held, "lm-runs")
    asked = held.mapInPandas(ask, "run long, `group` int, kind int, keys binary")
    # a group is read by as many tasks as its questions need, about RUNS_A_TASK runs each
    salts = max(1, -(-held.count() // RUNS_A_TASK))
    asked = asked.repartition(max(common.partitions(docs.sparkSession), min(salts * len(model.files), 20_000)), "group", F.pmod(F.xxhash64("run"), F.lit(salts))).sortWithinPartitions("group")
    answers = asked.mapInPandas(answer, "run long, `group` int, kind int, known binary").groupBy("run").agg(F.collect_list(F.struct("group", "kind", "known")).alias("answers"))
    return held.join(answers, "run").mapInPandas(finish, "__file long, __row long, " + RESULTS)


def _end_count(spark, model: Model) -> int:
    """How often the end was counted: looked up in the group that has its shard."""
    shard = int(shard_of(np.array([model.end], np.uint64), model.n_shards)[0])
    k = next(i for i, (a, b) in enumerate(model.shards) if a <= shard < b)

    def look(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": _group(model.files[k], tuple(model.shards[k]), model.n_shards).count(np.array([model.end], np.uint64))[: len(pdf)]})

    return spark.range(1, numPartitions=1).mapInPandas(look, "n long").first()[0]
