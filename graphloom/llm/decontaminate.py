"""Benchmark decontamination with a positional inverted index of the training tokens.

build() tokenises every document once and writes the index: a segment holds whole
documents, one after the other, and for each of its terms the places of all its tokens.
Rows are sorted by term in each file, so a search reads little of it but its own terms.
match() looks phrases up.  For each phrase the rarest terms, by their tokens in all
segments, say in which segments it can be at all; only there the lists of its other terms
are read.  In a segment the lists, each moved back by its term's place in the phrase, are
intersected from the rarest on; what is left are the phrase's starts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Consecutive words of an item that make a match; an item of fewer is matched whole.
WINDOW = 10
#: Tokens of a segment, unless one document has more.
SEGMENT = 1 << 22
#: Words between two documents of a segment that no document has, so that no stretch of words has parts of both.
GAP = 64
#: Phrases searched for at a time, and bytes of them; they and their terms are sent to every task.
BLOCK = 50_000
BLOCK_BYTES = 8 << 20
#: Terms of a phrase that must be in a segment before its other lists are read.
RAREST = 2

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _SEPARATORS else b for b in range(256))


def split(text: str | None) -> list[bytes]:
    """The words of a text: digits, letters (A-Z lower-cased) and everything beyond ASCII."""
    return (text or "").encode().translate(_WORDS).split()


_INDEX = "segment long, term string, n long, places array<int>, ordinal int, start long, n_words long"


class _Terms(dict):
    """term -> running number."""

    def __missing__(self, term):
        number = self[term] = len(self)
        return number


class _Segment:
    def __init__(self, number: int):
        self.number, self.terms, self.ids, self.at, self.documents = number, _Terms(), [], 0, []

    def add(self, doc_id, words: list[bytes]) -> None:
        self.ids.append(np.fromiter(map(self.terms.__getitem__, words), np.int32, len(words)))
        self.documents.append((doc_id, self.at, len(words)))
        self.at += len(words) + GAP

    def batches(self, id_type):
        """Rows of documents, then rows of terms; places are told as differences."""
        n = len(self.documents)
        doc_ids, start, n_words = zip(*self.documents, strict=True)
        yield _batch(id_type, self.number, ordinal=np.arange(n, dtype=np.int32), start=start, n_words=n_words, doc_id=doc_ids)
        lengths = np.array(n_words, np.int64)
        ids = np.concatenate(self.ids)
        self.ids = []
        place = np.arange(len(ids), dtype=np.int64) + np.repeat(np.arange(n, dtype=np.int64) * GAP, lengths)
        n_of = np.bincount(ids, minlength=len(self.terms))
        place |= ids.astype(np.int64) << 32  # one sort of numbers is faster than an order of ids
        place.sort()
        place &= (1 << 32) - 1
        ends = np.cumsum(n_of)
        gaps = np.diff(place, prepend=0)
        first = (ends - n_of)[n_of > 0]
        gaps[first] = place[first]
        gaps = gaps.astype(np.int32)
        names = list(self.terms)
        for i in range(0, len(names), 20_000):
            to = min(len(names), i + 20_000)
            begin = ends[i - 1] if i else 0
            offsets = np.concatenate([[0], ends[i:to] - begin]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(gaps[begin : ends[to - 1]]))
            yield _batch(id_type, self.number, term=pa.array(names[i:to], pa.binary()).cast(pa.string()), n=n_of[i:to], places=places)


def _batch(id_type, segment: int, **columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    kinds = {"segment": pa.int64(), "term": pa.string(), "n": pa.int64(), "places": pa.list_(pa.int32()), "ordinal": pa.int32(), "start": pa.int64(), "n_words": pa.int64(), "doc_id": id_type}
    columns["segment"] = np.full(rows, segment)
    held = {k: pa.nulls(rows, t) if k not in columns else columns[k] if isinstance(columns[k], pa.Array) else pa.array(columns[k], t) for k, t in kinds.items()}
    return pa.RecordBatch.from_arrays(list(held.values()), names=list(held))


def build(docs: DataFrame, path: str | None = None) -> str:
    """Write the index of docs (doc_id, text; other columns are ignored) and give its path.

    Every row is a document of its own, whatever its doc_id.  A null or empty text has no
    words.  A document lies in one segment, however long.
    """
    spark = docs.sparkSession
    path = path or common.work_path(spark, "postings")
    common.settle(spark)
    size = SEGMENT

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        kind = None
        segment = _Segment(base)
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = split(text.as_py())
                if segment.documents and segment.at + len(words) > size:
                    yield from segment.batches(kind)
                    segment = _Segment(segment.number + 1)
                segment.add(doc_id.as_py(), words)
        if segment.documents:
            yield from segment.batches(kind)
        del segment
        common.release()

    rows = docs.select("doc_id", "text").mapInArrow(run, f"{_INDEX}, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    rows.sortWithinPartitions("term").write.option("compression", "zstd").parquet(path)
    return path


def postings(spark: SparkSession, path: str) -> DataFrame:
    """segment, term, n, places (as differences) of an index."""
    return spark.read.parquet(path).where("term IS NOT NULL").select("segment", "term", "n", "places")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """segment, ordinal, start, n_words, doc_id of an index; segment and ordinal name a row."""
    return spark.read.parquet(path).where("term IS NULL").select("segment", "ordinal", "start", "n_words", "doc_id")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """phrase, terms, item_ids: the different windows of size words of items (item_id, text), and the items that have them, sorted as strings.

    An item of fewer words is one window; one without words has none.
    """

    def run(batches):
        for batch in batches:
            ids, terms = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w.decode() for w in split(text)]
                found = [words[k : k + size] for k in range(max(1, len(words) - size + 1))] if words else []
                ids += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.string()))], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL").mapInArrow(run, "item_id string, terms array<string>")
    per = rows.groupBy("terms").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return per.select(F.sha2(F.array_join("terms", " "), 256).alias("phrase"), "terms", "item_ids")


def _counted(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """term, total: each of the phrases' terms and its tokens in the whole index."""
    terms = phrases.select(F.explode("terms").alias("term")).distinct()
    return index.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("n").alias("total"))


def _starts(lists: dict[str, np.ndarray], terms: list[str]) -> np.ndarray:
    """Where the phrase begins: lists moved by their offsets, intersected from the shortest on."""
    order = sorted(range(len(terms)), key=lambda i: len(lists[terms[i]]))
    found = lists[terms[order[0]]] - order[0]
    for i in order[1:]:
        if not len(found):
            break
        other = lists[terms[i]]
        at = np.searchsorted(other, found + i)
        found = found[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == found + i)]
    return found


def _stretches(lists: dict[str, np.ndarray], terms: list[str], within: int) -> list[tuple[int, int]]:
    """The shortest stretches, of at most within words, that have every term as often as the phrase, in any order."""
    need = {t: terms.count(t) for t in terms}
    rarest = min(need, key=lambda t: len(lists[t]))
    near = lists[rarest]
    begins = np.unique(np.concatenate([lists[t] for t in need]))
    # a stretch has the rarest term: only begins with one of its tokens ahead, and near, count
    at = np.searchsorted(near, begins)
    begins = begins[(at < len(near)) & (near[np.minimum(at, len(near) - 1)] - begins < within)]
    last = np.zeros(len(begins), np.int64)
    for t, times in need.items():
        own = lists[t]
        at = np.searchsorted(own, begins) + times - 1
        last = np.maximum(last, np.where(at < len(own), own[np.minimum(at, len(own) - 1)], np.iinfo(np.int64).max))
    good = last - begins < within
    begins, last = begins[good], last[good]
    shortest = np.append(last[1:] != last[:-1], True)[: len(last)]
    return list(zip(begins[shortest].tolist(), last[shortest].tolist(), strict=True))


def match(spark: SparkSession, path: str, phrases: DataFrame, within: int | None = None) -> DataFrame:
    """segment, ordinal, phrase, kind, start, stop: where phrases (phrase, terms) occur in the documents of an index.

    kind exact: the terms one after the other, from word start to word stop - 1 of the
    document; kind near, if within is given (at most GAP): the shortest stretches of up to
    within words that have all terms in any order, exact ones among them.  Phrases are
    worked in blocks of BLOCK (or BLOCK_BYTES), and segment by segment, so memory follows the larger of the two.
    """
    if within and within > GAP:
        raise ValueError(f"within is at most {GAP}")
    phrases = common.stored(phrases.select("phrase", "terms"), "phrases")
    n, size = phrases.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("terms", " "))), F.lit(0))).first()
    # by hash, blocks hold that or a little more
    blocks = max(-(-n // BLOCK), -(-size // BLOCK_BYTES))
    found = None
    for i in range(blocks):
        some = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == i) if blocks > 1 else phrases
        part = _match_block(spark, path, some, within)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], _FOUND)


_FOUND = "segment long, ordinal int, phrase string, kind string, start long, stop long"


def _match_block(spark: SparkSession, path: str, phrases: DataFrame, within: int | None) -> DataFrame:
    index = postings(spark, path)
    total = common.stored(_counted(index, phrases), "totals")
    # each phrase's rarest terms; one with a term that no document has is out
    each = phrases.select("phrase", F.size(F.array_distinct("terms")).alias("terms"), F.explode(F.array_distinct("terms")).alias("term"))
    ranked = each.join(total, "term").withColumn("rank", F.row_number().over(Window.partitionBy("phrase").orderBy("total", "term")))
    ranked = ranked.withColumn("known", F.count("*").over(Window.partitionBy("phrase"))).where("known = terms")
    rare = ranked.where(F.col("rank") <= RAREST).groupBy("term").agg(F.collect_list("phrase").alias("phrases"))
    rare = common.stored(rare, "rare")
    need = F.least(F.lit(RAREST), F.size(F.array_distinct("terms")))
    sizes = phrases.select("phrase", need.alias("need"))
    # the segments that a phrase can be in: both its rarest terms are there; only segments and terms are read
    there = index.select("segment", "term").join(F.broadcast(rare), "term").select("segment", F.explode("phrases").alias("phrase"))
    alive = there.groupBy("segment", "phrase").agg(F.count("*").alias("n")).join(F.broadcast(sizes), "phrase").where("n = need").select("segment", "phrase")
    alive = common.stored(alive, "alive")
    wanted = alive.join(F.broadcast(each.select("phrase", "term")), "phrase").select("segment", "term").distinct()
    # a segment's lists of wanted terms, its live phrases and its documents' places meet
    lists = index.join(F.broadcast(total.select("term")), "term", "left_semi").join(wanted, ["segment", "term"], "left_semi").select("segment", "term", "places")
    live = alive.join(F.broadcast(phrases), "phrase")
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = lists.select("segment", F.lit(2).alias("what"), "term", "places", nothing("string").alias("phrase"), nothing("array<string>").alias("terms"), nothing("long").alias("start"))
    rows = rows.unionByName(live.select("segment", F.lit(1).alias("what"), nothing("string").alias("term"), nothing("array<int>").alias("places"), "phrase", "terms", nothing("long").alias("start")))
    begins = documents(spark, path).join(alive.select("segment").distinct(), "segment", "left_semi")
    rows = rows.unionByName(begins.select("segment", F.lit(0).alias("what"), nothing("string").alias("term"), nothing("array<int>").alias("places"), nothing("string").alias("phrase"), nothing("array<string>").alias("terms"), "start"))
    rows = rows.repartition("segment").sortWithinPartitions("segment", "what", "start")
    return rows.select("segment", "what", "start", "phrase", "terms", "term", "places").mapInArrow(_segments(within), _FOUND)


def _segments(within: int | None):
    """Rows sorted by segment, each segment's documents, phrases and lists in this order, to what is found."""

    def solve(segment: int, begins: list, phrases: list, lists: dict):
        begin = np.array(begins, np.int64)
        out = []
        for phrase, terms in phrases:
            if any(t not in lists for t in terms):
                continue
            spans = [("exact", s, s + len(terms)) for s in _starts(lists, terms).tolist()]
            if within:
                spans += [("near", a, b + 1) for a, b in _stretches(lists, terms, within)]
            if spans:
                at = np.searchsorted(begin, [s for _, s, _ in spans], "right") - 1
                out += [(segment, d, phrase, kind, a - int(begin[d]), b - int(begin[d])) for d, (kind, a, b) in zip(at.tolist(), spans, strict=True)]
        for i in range(0, len(out), 10_000):
            columns = list(zip(*out[i : i + 10_000], strict=True))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["segment", "ordinal", "phrase", "kind", "start", "stop"])

    def run(batches):
        held, begins, phrases, lists = None, [], [], {}
        for batch in batches:
            segments, whats = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(segments) != 0) | (np.diff(whats) != 0)) + 1).tolist(), len(segments)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if segments[a] != held:
                    if held is not None:
                        yield from solve(held, begins, phrases, lists)
                    held, begins, phrases, lists = int(segments[a]), [], [], {}
                some = batch.slice(a, b - a)
                if whats[a] == 0:
                    begins += some.column(2).to_pylist()
                elif whats[a] == 1:
                    phrases += zip(some.column(3).to_pylist(), some.column(4).to_pylist(), strict=True)
                else:
                    places = some.column(6)
                    gaps, offsets = places.flatten().to_numpy(), places.offsets.to_numpy() - places.offsets[0].as_py()
                    for k, term in enumerate(some.column(5).to_pylist()):
                        lists[term] = np.cumsum(gaps[offsets[k] : offsets[k + 1]], dtype=np.int64)
        if held is not None:
            yield from solve(held, begins, phrases, lists)

    return run


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated for every row of docs.

    n_hit: words inside any occurrence of a window of an item; item_ids: the items with such
    windows, as strings, sorted.  Null, empty and wordless texts have no words and no hits;
    an empty table of items hits nothing; items of one id count as one item, and those
    without an id are left out; repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    path = build(docs)
    sought = common.stored(windows(items, size), "windows")
    found = match(spark, path, sought)
    place = ["segment", "ordinal"]
    spans = common.stored(found.select(*place, "phrase", "start", "stop").distinct(), "spans")
    # hits: from each span only what no span before it, in the order of starts, has covered
    turn = Window.partitionBy(*place).orderBy("start", "stop")
    before = F.max("stop").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    places = spans.select(*place, "start", "stop").distinct()
    fresh = places.withColumn("fresh", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0)))))
    hits = fresh.groupBy(*place).agg(F.sum("fresh").alias("n_hit"))
    of = spans.select(*place, "phrase").distinct().join(sought.select("phrase", F.explode("item_ids").alias("item_id")), "phrase")
    by_item = of.groupBy(*place).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = documents(spark, path).join(hits, place, "left").join(by_item, place, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
