"""A kept inverted index for keyword search, which is read by term and grows by segments.

build() and add() write postings by term: for each term and block of documents the nodes,
how often they have the term and how long they are, and of the block the most of one and
the least of the other.  Files are laid out by the term's crc32, sorted by term.  A search
opens the folders of its terms; the blocks' figures bound every score in them, the blocks
with the greatest bounds are scored first, and of the rest only those whose bound reaches
the limit-th score so far.  Results are those of text.bm25 over the live documents.
"""

from __future__ import annotations

import math
from zlib import crc32

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, small
from .text import query_words, settled, tokens

#: Folders of postings, documents of a block (about), and blocks that are scored first.
PARTS, BLOCK, FIRST = 32, 4096, 16
COLUMNS = ("name", "qualified_name", "file_path")


def _words(docs: DataFrame):
    return F.concat(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in COLUMNS])


def _read(spark: SparkSession, path: str, what: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{path}/{what}")
    except AnalysisException:  # nothing of it was written
        return spark.createDataFrame([], schema)


_POSTINGS = "term string, block long, n long, nodes array<struct<node_id:long,tf:long,dl:int>>, max_tf long, min_dl int, segment int, part int"
_DOCUMENTS = "node_id long, name string, qualified_name string, file_path string, dl int, segment int"
_TOTALS = "n long, worded long, words long, segment int"
_DEAD = "node_id long, segment int, dl int, by int"


def build(docs: DataFrame, path: str) -> None:
    """Start an index of docs (node_id, name, qualified_name, file_path; node_id is a key) in path, which is new."""
    _write(docs, path, 0)


def add(docs: DataFrame, path: str) -> None:
    """A segment of further documents; those of an id that the index has replace it.  What is written follows docs."""
    spark = docs.sparkSession
    docs = cut(docs.select("node_id", *COLUMNS))
    number = 1 + _read(spark, path, "totals", _TOTALS).agg(F.max("segment")).first()[0]
    remove(docs, path, number)
    _write(docs, path, number)


def remove(ids: DataFrame, path: str, by: int = -1) -> None:
    """Documents with these ids (node_id) are no longer found."""
    spark = ids.sparkSession
    dead = _read(spark, path, "dead", _DEAD)
    gone = _read(spark, path, "documents", _DOCUMENTS).join(ids.select("node_id").distinct(), "node_id", "left_semi").join(dead, ["node_id", "segment"], "left_anti")
    cut(gone.select("node_id", "segment", "dl", F.lit(by).alias("by"))).write.mode("append").parquet(f"{path}/dead")


def _write(docs: DataFrame, path: str, segment: int) -> None:
    rows = cut(docs.select("node_id", *COLUMNS, _words(docs).alias("w")).withColumn("dl", F.size("w")))
    n = rows.count()
    # short documents score higher: blocks hold documents of like length, so that bounds tell them apart
    spread = max(1, n // (16 * BLOCK))
    block = F.least(F.floor(F.log2(F.col("dl") + 1) * 3), F.lit(15)) * spread + F.pmod(F.xxhash64("node_id"), F.lit(spread))
    each = rows.select("node_id", "dl", block.alias("block"), F.explode("w").alias("term")).groupBy("term", "block", "node_id", "dl").agg(F.count("*").alias("tf"))
    per = each.groupBy("term", "block").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("node_id", "tf", "dl"))).alias("nodes"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    per = per.withColumns({"segment": F.lit(segment), "part": (F.crc32(F.encode("term", "UTF-8")) % PARTS).cast("int")})
    per.repartition(PARTS, "part").sortWithinPartitions("part", "term", "block").write.mode("append").partitionBy("segment", "part").parquet(f"{path}/postings")
    rows.select("node_id", *COLUMNS, "dl").withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(f"{path}/documents")
    rows.agg(F.count("*").alias("n"), F.count_if(F.col("dl") > 0).alias("worded"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{path}/totals")


def postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The index's rows of these terms; only their folders are opened."""
    parts = sorted({crc32(t.encode()) % PARTS for t in terms})
    return _read(spark, path, "postings", _POSTINGS).where(F.col("part").isin(parts) & F.col("term").isin(terms))


def bm25(spark: SparkSession, path: str, query: str, limit: int = 50) -> DataFrame:
    """node_id, score as of text.bm25: documents with all words of query, least score best, ties to the lesser id."""
    phrases = query_words(query)
    terms = sorted({x for p in phrases for x in p})
    if not terms:
        return spark.createDataFrame([], "node_id long, score double")
    rows, dead = postings(spark, path, terms), cut(_read(spark, path, "dead", _DEAD).select("node_id", "segment", "dl"))
    gone, gone_words, gone_n = dead.agg(F.count_if(F.col("dl") > 0), F.coalesce(F.sum("dl"), F.lit(0)), F.count("*")).first()
    total = _read(spark, path, "totals", _TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("worded"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n, worded, words = total[0] - gone_n, total[1] - gone, total[2] - gone_words
    blocks = cut(rows.select("term", "segment", "block", "n", "max_tf", "min_dl"))  # a row for each term and block
    df = {r["term"]: r["n"] for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    alone = small(dead.select("node_id", "segment"), gone_n, 16)
    if gone_n:
        held = rows.select("term", "segment", F.explode("nodes.node_id").alias("node_id")).join(alone, ["node_id", "segment"], "left_semi")
        for r in held.groupBy("term").agg(F.count("*").alias("n")).collect():
            df[r["term"]] -= r["n"]
    if not worded or any(df.get(t, 0) == 0 for t in terms):
        return spark.createDataFrame([], "node_id long, score double")
    average = words / worded
    weight = {t: max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) for t in terms} if all(n - df[t] + 0.5 > 0 for t in terms) else {t: 1e-6 for t in terms}
    idf = F.element_at(F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(weight[t]))]), F.col("term"))
    part = lambda tf, dl: idf * F.col(tf) * 2.2 / (F.col(tf) + 1.2 * (0.25 + 0.75 * F.col(dl) / F.lit(average)))
    bounds = cut(blocks.groupBy("segment", "block").agg(F.count("*").alias("terms"), F.sum(part("max_tf", "min_dl")).alias("bound")).where(F.col("terms") == len(terms)).drop("terms"))

    def scored(some: DataFrame) -> DataFrame:
        near = rows.join(F.broadcast(some.select("segment", "block")), ["segment", "block"], "left_semi").select("term", "segment", F.explode("nodes").alias("d")).select("term", "segment", "d.*")
        per = near.groupBy("segment", "node_id").agg(F.count("*").alias("terms"), F.sum(part("tf", "dl")).alias("score")).where(F.col("terms") == len(terms))
        per = per.join(alone, ["node_id", "segment"], "left_anti") if gone_n else per
        for p in (p for p in phrases if len(p) > 1):  # a phrase is looked up where its words are
            flat = [F.coalesce(F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" ")).contains(" " + " ".join(p) + " "), F.lit(False)) for c in COLUMNS]
            per = per.join(_read(spark, path, "documents", _DOCUMENTS).where(flat[0] | flat[1] | flat[2]).select("node_id", "segment"), ["node_id", "segment"], "left_semi")
        return per.select("node_id", (-F.col("score")).alias("score")).orderBy(settled("score"), "node_id").limit(limit)

    first = cut(bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST))
    top = cut(scored(first))
    least = top.agg(F.count("*").alias("n"), F.max("score").alias("s")).first()
    rest = bounds.join(F.broadcast(first), ["segment", "block"], "left_anti")
    if least["n"] == limit:  # scores are told to nine digits
        rest = rest.where(F.col("bound") >= F.lit(-least["s"] - 1e-8))
    rest = cut(rest)
    if rest.isEmpty():
        return top.orderBy(settled("score"), "node_id")
    return top.unionByName(scored(rest)).orderBy(settled("score"), "node_id").limit(limit)
