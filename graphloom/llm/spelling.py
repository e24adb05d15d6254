"""Grouping of spelling variants: a rare-first bigram prefix filter over the words of a corpus.

One inserted, deleted or replaced letter touches at most two of a word's bigrams, and
leaves the others in their order.  So of two words one edit apart, the first bigram that
both keep, with all bigrams of the corpus' words ordered from rare to frequent and then by
place, is among the three first of each, and its places differ by at most one.  Words are
joined on those three only.  An edit also leaves half of a word as it was: the first half,
or the last.  Which half is unknown, so both are tried, and the join key holds the bigram,
the half and its letters; without that, frequent bigrams would still meet in large groups.
Every joined pair is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Rows of words, and letters of them, that are turned into keys together.
BLOCK_LETTERS = 1 << 20
#: Bigrams that the filter joins for each word: 2 * edits + 1.
PREFIX = 3


def words(docs: DataFrame, min_length: int = 7, min_count: int = 2, misspell: int | None = None) -> DataFrame:
    """word, n: every run of letters of at least min_length, lower-cased (A-Z only), that occurs min_count times or more.

    misspell: where the crc32 of "doc_id:run" is divisible by it, the run loses the letter at
    that crc modulo its length.  A null text has no words; a null doc_id reads as empty.
    """
    # only what is long enough matters: a run never grows
    runs = F.regexp_extract_all("text", F.lit(f"(?<![{LETTERS}])[{LETTERS}]{{{min_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.explode(runs).alias("__run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = F.when(F.col("__run").rlike("[A-Z]"), F.translate("__run", upper, upper.lower())).otherwise(F.col("__run"))
    found = found.select("__id", word.alias("word"))
    if misspell:
        h = F.crc32(F.encode(F.concat("__id", F.lit(":"), "word"), "UTF-8"))
        at = (F.col("__h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        found = found.withColumn("__h", h).select(F.when(F.col("__h") % misspell == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bigram_order(vocabulary: DataFrame) -> dict[str, int]:
    """Each bigram's place from rare to frequent over the words; letters are of one byte's range, so there are at most 90 * 90."""
    grams = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))).alias("gram"))
    rows = grams.groupBy("gram").count().collect()
    return {r["gram"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["count"], r["gram"])))}


_KEYS = "key long, short boolean, pos int, odd long, word string, n long"


def _mixed(h: np.ndarray, gram: np.ndarray, half: int, length: int) -> np.ndarray:
    """64-bit keys of halves (their hashes), bigrams and lengths; equal ones only bring a pair to verification."""
    h = (h ^ (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + np.uint64((length * 2 + half) * 0xC2B2AE3D27D4EB4F % 2**64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _keys(order: np.ndarray, min_length: int):
    """Batches of (word, n) to their join keys; order: the place of bigram (a, b) at a * 256 + b."""
    base = np.uint64(0xD6E8FEB86659FD93)

    def one_length(some: pa.Table, length: int):
        names = some["word"].to_pylist()
        letters = np.array(names, f"U{length}").view(np.uint32).reshape(len(names), length)
        gram = letters[:, :-1].astype(np.int64) * 256 + letters[:, 1:]
        rank = order[gram] * np.int64(length) + np.arange(length - 1)
        top = np.sort(np.partition(rank, PREFIX - 1, axis=1)[:, :PREFIX], axis=1)
        pos = top % length
        kept = np.take_along_axis(gram, pos, axis=1)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(length, base)]))
        wide = letters.astype(np.uint64)
        odd = np.bitwise_xor.reduce(np.uint64(1) << (wide & np.uint64(63)), axis=1).view(np.int64)
        for short, of in ((True, length), (False, length - 1)):
            if of < min_length:
                continue  # no word is that short
            k = of // 2
            for half, part in ((0, wide[:, :k]), (1, wide[:, length - (of - k) :])):
                h = (part * power[: part.shape[1]]).sum(axis=1, dtype=np.uint64)
                for j in range(PREFIX):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_mixed(h, kept[:, j], half, of)), pa.array(np.full(len(names), short)), pa.array(pos[:, j].astype(np.int32)), pa.array(odd), some["word"].combine_chunks(), some["n"].combine_chunks()],
                        names=["key", "short", "pos", "odd", "word", "n"],
                    )

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = pc.utf8_length(table["word"]).to_numpy()
            for length in np.unique(lengths).tolist():
                some = table.take(np.flatnonzero(lengths == length))
                step = max(1, BLOCK_LETTERS // length)
                for i in range(0, len(some), step):
                    yield from one_length(some.slice(i, step).combine_chunks(), length)

    return run


def near_pairs(vocabulary: DataFrame, min_length: int = 7) -> DataFrame:
    """a, na, b, nb: every pair of words (word, n) one edit apart, once; vocabulary must be a written table, of words of min_length letters or more."""
    place = np.full(256 * 256, np.iinfo(np.int32).max, np.int64)
    for gram, i in bigram_order(vocabulary).items():
        place[ord(gram[0]) * 256 + ord(gram[1])] = i
    keys = common.stored(vocabulary.select("word", F.col("n").cast("long").alias("n")).mapInArrow(_keys(place, min_length), _KEYS), "bigram-keys")
    a = keys.where("short").select("key", F.col("pos").alias("pa"), F.col("odd").alias("oa"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = keys.select("key", F.col("short").alias("same"), F.col("pos").alias("pb"), F.col("odd").alias("ob"), F.col("word").alias("b"), F.col("n").alias("nb"))
    # of words as long as each other a bigram keeps its place; in a longer one it may come one later
    placed = F.expr("(same AND pa = pb AND a < b) OR (NOT same AND pb - pa BETWEEN 0 AND 1)")
    # odd has a bit for each letter that a word has an odd number of times; an edit turns two at most
    near = F.expr("bit_count(oa ^ ob) <= 2") & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, (a["key"] == b["key"]) & placed & near).select("a", "na", "b", "nb").distinct()


def variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, misspell: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus.

    form: of the words one edit apart the most frequent (ties: the least), if it is at least
    ratio times as frequent as the word; root: where forms lead to.  docs: doc_id, text; other
    columns are ignored.  Null, empty and short texts have no words; rows that repeat count
    again; an empty table gives no rows.
    """
    vocabulary = common.stored(words(docs, min_length, min_count, misspell), "words")
    pairs = near_pairs(vocabulary, min_length)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    sides = pairs.select(F.explode(both).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    rows = vocabulary.join(best, "word", "left")
    good = -F.col("best.m") >= ratio * F.col("n")
    rows = common.stored(
        rows.select("word", F.when(good, F.col("best.near")).alias("form"), F.col("n").cast("long").alias("n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.m")).alias("form_n")), "forms"
    )
    roots = _roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where links (word, root) lead to in the end, by pointer doubling; a count grows tenfold a link, so few rounds do."""
    links = common.stored(links, "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = common.stored(moved, "roots")
        common.drop(links)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        links = after.select("word", "root")
        links._stored_path = after._stored_path
