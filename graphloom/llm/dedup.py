"""Exact deduplication by deterministic block naming; DataFrame functions only.

A normalised text is cut into blocks of BLOCK bytes.  Equal blocks get the same integer
name and different blocks different ones: blocks are dealt to places by a hash, sorted
there, and named by rank and place, so the hash only decides where blocks meet and no
two blocks share a name by collision.  Adjacent names are then named in pairs, and pairs
of pairs, until every text has one name.  Texts are equal when their byte length and
last name are equal.

A block that very many texts share (a copied page) would crowd one place.  The most
frequent block hashes, a fixed number for each shuffle partition, are counted first and
their rows dealt to several places each; the names from those places are then made one
by comparing the blocks themselves, one per place.  Only that table, a few rows for each
shuffle partition, is broadcast.  Texts are shuffled once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 4096
#: Block hashes watched as possibly hot, for each shuffle partition.
WATCHED = 4
#: Rows of one hot block that go to one place; larger groups of equal texts may be broadcast.
SPREAD = 200
#: Where a row lies, as common.located() says.
PLACE = ("__file", "__row")


def normalised(text: Column) -> Column:
    """The text without space and U+0009 to U+000D; null is the empty text."""
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), common.WS, F.coalesce(text, F.lit("")))


def _blocks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """rid, idx, block, h and, with a text's first block, what is known of the text; docs is located()."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), "__file", "__row",
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.char_length(text_column), F.lit(0)).alias("n_cp"),
        normalised(F.col(text_column)).alias("norm"),
    )
    raw = F.col("norm").cast("binary")
    rows = rows.select("rid", *PLACE, "doc_id", "n_cp", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("n_bytes"), raw.alias("raw"))
    rows = rows.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / BLOCK)).cast("long"))
    cut = F.transform(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int")), lambda i: F.substring(F.col("raw"), i * BLOCK + 1, F.lit(BLOCK)))
    rows = rows.select("rid", *PLACE, "doc_id", "n_cp", "sha", "n_bytes", "nb", F.posexplode(cut).alias("idx", "block"))
    first = F.col("idx") == 0
    return rows.select(
        "rid", "idx", "nb", "n_bytes", "block", F.xxhash64("block").alias("h"),
        *[F.when(first, F.col(c)).alias(c) for c in (*PLACE, "doc_id", "n_cp", "sha")],
    )


def names(docs: DataFrame, *, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per row of docs, located(): rid, __file, __row, doc_id, n_cp, sha, n_bytes, name.

    Texts are equal exactly if n_bytes and name are.  rid numbers the rows of this result,
    whose parts are written before they are used.
    """
    spark = docs.sparkSession
    n_parts = common.partitions(spark)
    places = 64 * n_parts
    blocks = _blocks(docs, id_column, text_column)
    often = blocks.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > SPREAD).orderBy(F.desc("n"), "h").limit(WATCHED * n_parts)
    often = common.fixed(often.select("h", F.ceil(F.col("n") / SPREAD).alias("salts")), "often")
    # at most WATCHED rows for each shuffle partition
    rows = blocks.join(F.broadcast(often), "h", "left")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("rid"), F.col("salts"))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("h", salt), F.lit(places)))
    sort = Window.partitionBy("place").orderBy("block")
    rank, before = F.dense_rank().over(sort).cast("long"), F.lag("block").over(sort)
    rows = rows.select("*", rank.alias("rank"), before.alias("before"))
    first = F.col("salts").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("block")))
    named = rows.select(
        "rid", "idx", "nb", "n_bytes", *PLACE, "doc_id", "n_cp", "sha",
        (F.col("rank") * places + F.col("place")).alias("local"), F.when(first, F.col("block")).alias("shown"),
    )
    named = common.stored(named, "block-names")
    shown = named.where(F.col("shown").isNotNull()).select("local", "shown")
    one = common.fixed(shown.groupBy("shown").agg(F.min("local").alias("name"), F.collect_set("local").alias("locals")).select("name", F.explode("locals").alias("local")), "hot-names")
    level = named.drop("shown").join(common.small(one, one.count(), 32), "local", "left").withColumn("name", F.coalesce("name", "local")).drop("local")
    deepest = named.agg(F.max("nb")).first()[0] or 1
    done = [level.where("nb = 1").select("rid", *PLACE, "doc_id", "n_cp", "sha", "n_bytes", "name")]
    if deepest > 1:
        many = level.where("nb > 1")
        known = many.where("idx = 0").select("rid", *PLACE, "doc_id", "n_cp", "sha", "n_bytes")
        last = _pair_names(many.select("rid", F.col("idx").cast("long").alias("idx"), "nb", "name"), places)
        done.append(known.join(last, "rid").select("rid", *PLACE, "doc_id", "n_cp", "sha", "n_bytes", "name"))
    return reduce(DataFrame.unionByName, done)


def _pair_names(rows: DataFrame, places: int) -> DataFrame:
    """rid and the one name of every text, by naming adjacent names in pairs; rows: rid, idx, nb, name."""
    finished = []
    while True:
        half = F.expr("idx div 2").alias("idx")
        left, right = F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))), F.max(F.when(F.col("idx") % 2 == 1, F.col("name")))
        pairs = rows.groupBy("rid", half, F.expr("(nb + 1) div 2").alias("nb")).agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b"))
        pairs = common.stored(pairs, "pairs")
        kinds = pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(places)).alias("place"))
        rank = F.row_number().over(Window.partitionBy("place").orderBy("a", "b")).cast("long")
        kinds = kinds.select("a", "b", (rank * places + F.col("place")).alias("name"))
        level = common.stored(pairs.join(kinds, ["a", "b"]).select("rid", "idx", "nb", "name"), "pair-names")
        finished.append(level.where("nb = 1").select("rid", "name"))
        rows = level.where("nb > 1")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, finished)


def decide(docs: DataFrame, *, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text stays, then
    the smallest doc_id (null last), then the first row.  Null and white texts are all
    equal to the empty text.  Repeated rows count each, and one of them stays.  An
    empty table gives no rows.
    """
    return _decided(common.located(docs), id_column, text_column).drop(*PLACE)


def _decided(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """decide() of docs, located(), with __file and __row."""
    named = common.stored(names(docs, id_column=id_column, text_column=text_column), "named")
    order = F.struct((-F.col("n_cp")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "rid")
    groups = common.stored(named.groupBy("n_bytes", "name").agg(F.count("*").alias("group_size"), F.min(order).alias("best")), "groups")
    # the largest groups, a fixed number for each shuffle partition, meet their rows by broadcast; no other is large
    most = WATCHED * common.partitions(docs.sparkSession)
    large = groups.where(F.col("group_size") > SPREAD).orderBy(F.desc("group_size"), "n_bytes", "name").limit(most)
    rows = named.join(F.broadcast(common.fixed(large, "large-groups")), ["n_bytes", "name"], "left")
    other = rows.where("group_size IS NULL").drop("group_size", "best").join(groups, ["n_bytes", "name"])
    rows = rows.where("group_size IS NOT NULL").unionByName(other)
    return rows.select(
        *PLACE, "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, **columns) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    docs = common.located(docs)
    dropped = common.stored(_decided(docs, **columns).where("NOT kept").select(*PLACE), "copies")
    return common.without(docs, dropped, dropped.count())
