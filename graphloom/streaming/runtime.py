"""Observed runtime edges from a feed of events: folding, upserts by Structured Streaming, rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.deltas import Deltas
from ..plans.lineage import scratch

KEY = ["session_id", "kind", "source_key", "target_key"]


def event_key(node_id: str = "node_id", symbol: str = "symbol", file: str = "file", line: str = "line"):
    """node:id, else sym:symbol, else loc:file:line, else null."""
    return (
        F.when(F.col(node_id) != "", F.concat(F.lit("node:"), F.col(node_id))).when(F.col(symbol) != "", F.concat(F.lit("sym:"), F.col(symbol)))
        .when((F.col(file) != "") & F.col(line).isNotNull(), F.concat_ws(":", F.lit("loc"), F.col(file), F.col(line)))
    )


def fold(events: DataFrame) -> DataFrame:
    """One row per edge: hit_count, and the timestamps of its first and last event in order of arrival (seq), not of time."""
    whole = events.where("source_key IS NOT NULL AND target_key IS NOT NULL")
    return whole.groupBy(*KEY).agg(
        F.count("*").alias("hit_count"), F.min_by("ts_ms", "seq").alias("first_seen_ms"), F.max_by("ts_ms", "seq").alias("last_seen_ms"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
    )


def combined(edges: DataFrame) -> DataFrame:
    """Rows of several folds as one of all their events."""
    return edges.groupBy(*KEY).agg(
        F.sum("hit_count").alias("hit_count"), F.min_by("first_seen_ms", "first_seq").alias("first_seen_ms"), F.max_by("last_seen_ms", "last_seq").alias("last_seen_ms"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
    )


def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored edges with those of a later fold added."""
    return combined(stored.unionByName(fresh))


def seen_since(edges: DataFrame, least_ms: int) -> DataFrame:
    return edges.where(F.col("last_seen_ms") >= least_ms)


def start(feed: DataFrame, table: str, checkpoint: str):
    """Keep the edges of a streamed feed under the path table; a batch writes its own edges, and a batch that comes again replaces itself."""
    kept = Deltas(feed.sparkSession, table, combined)
    return feed.writeStream.foreachBatch(lambda batch, epoch: kept.write(fold(batch), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_edges(spark: SparkSession, table: str) -> DataFrame | None:
    """The edges that start() keeps under table; None before the first batch."""
    return Deltas(spark, table, combined).read()


def stream_once(events: DataFrame, files: int = 3) -> DataFrame:
    """Write events as a few files, stream them one file a batch through start(), and return the edges."""
    spark: SparkSession = events.sparkSession
    base = scratch(spark)
    events.repartitionByRange(files, "seq").write.parquet(f"{base}/in")
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    start(feed, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return stored_edges(spark, f"{base}/table")


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and kind of a stream or table with ts (timestamp); late rows are dropped after late."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))


def rate_limit(requests: DataFrame, limit: int = 100, window_ms: int = 60_000) -> DataFrame:
    """key, seq, allowed: windows of window_ms begin at a key's first request after the last window ended, and let limit requests pass.

    The windows are anchored, so a key's requests are read in order; keys are dealt over
    tasks, and a task keeps only the window of the key it is reading.
    """
    kind = requests.schema["key"].dataType.simpleString()

    def run(batches):
        now, begin, used = None, None, 0
        for pdf in batches:
            out = []
            for key, ts in zip(pdf["key"].tolist(), pdf["ts_ms"].tolist(), strict=True):
                if begin is None or key != now or ts - begin >= window_ms:
                    now, begin, used = key, ts, 0
                used += 1
                out.append(used <= limit)
            yield pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "allowed": out})

    ordered = requests.select("key", "seq", "ts_ms").repartition("key").sortWithinPartitions("key", "ts_ms", "seq")
    return ordered.mapInPandas(run, f"key {kind}, seq long, allowed boolean")


def sessions(edges: DataFrame, limit: int = 20) -> DataFrame:
    """session_id, edges, hits and last seen, newest first; 1 to 100 rows."""
    rows = edges.groupBy("session_id").agg(F.count("*").alias("edges"), F.sum("hit_count").alias("hits"), F.max("last_seen_ms").alias("last_seen_ms"))
    return rows.orderBy(F.desc("last_seen_ms"), "session_id").limit(min(100, max(1, limit)))


#: Phases of an analysis; one that has not begun counts 0.
PHASES = 12


def progress(phases: DataFrame, total: int = PHASES) -> DataFrame:
    """job and overall progress: the mean over all phases, each held to 0 to 100 and 0 before it begins."""
    return phases.groupBy("job").agg((F.sum(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("percent")))) / total).alias("overall"))


def gaps(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Milliseconds from each event to the next of its key."""
    return events.withColumn("gap_ms", F.lead("ts_ms").over(Window.partitionBy(key).orderBy("ts_ms", "seq")) - F.col("ts_ms"))


def session_stats(sessions_: DataFrame, edges: DataFrame) -> DataFrame:
    """session_id, edges, observed, bootstrapped, hits of every session (session_id), 0 where it has no edges; edges: session_id, source_type, hit_count."""
    rows = sessions_.join(edges, "session_id", "left").groupBy("session_id")
    of = lambda kind: F.count_if(F.col("source_type") == kind).alias(kind)
    return rows.agg(F.count("hit_count").alias("edges"), of("observed"), of("bootstrapped"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))


#: Kinds of edges a session is begun from.
BOOTSTRAP = ("calls", "data_flow", "imports", "uses", "defines", "contains")


def bootstrap(edges: DataFrame, seeds: DataFrame, depth: int = 4, most: int = 400) -> DataFrame:
    """source, target, kind, hit_count of the first `most` edges from seeds (id, ord), breadth first; edges: src, dst, kind, ord.

    Nodes up to depth give their edges, in the order of a queue.  The search ends as soon as
    enough edges are found, so it never goes through more of the graph than it needs.
    """
    from functools import reduce

    from ..plans.lineage import cut

    some = cut(edges.where(F.col("kind").isin(*BOOTSTRAP)))
    frontier = cut(seeds.select("id", F.array(F.col("ord").cast("long")).alias("place")))
    rounds, got = [], 0
    seen = frontier.select("id")
    for level in range(depth + 1):
        made = cut(frontier.join(some, F.col("id") == F.col("src")).select(F.lit(level).alias("level"), "src", "dst", "kind", F.concat("place", F.array(F.col("ord").cast("long"))).alias("place")))
        rounds.append(made)
        got += made.count()
        if got >= most or level == depth:
            break
        new = made.join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.min("place").alias("place"))
        frontier = cut(new)
        seen = cut(seen.union(frontier.select("id")))
    first = reduce(DataFrame.unionByName, rounds).orderBy("level", "place").limit(most)
    return first.groupBy(F.col("src").alias("source"), F.col("dst").alias("target"), "kind").agg(F.count("*").alias("hit_count"))


def with_bootstrap(stored: DataFrame, made: DataFrame, now_ms: int) -> DataFrame:
    """stored edges with bootstrapped ones added: hits add up, observed stays observed; both: KEY columns, source_type, hit_count, first_seen_ms, last_seen_ms (not in made)."""
    fresh = made.withColumns({"source_type": F.lit("bootstrapped"), "first_seen_ms": F.lit(now_ms), "last_seen_ms": F.lit(now_ms)})
    rows = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    observed = F.bool_or(F.col("source_type") == "observed")
    return rows.groupBy(*KEY).agg(
        F.when(observed, "observed").otherwise("bootstrapped").alias("source_type"), F.sum("hit_count").alias("hit_count"), F.min_by("first_seen_ms", "__new").alias("first_seen_ms"), F.max_by("last_seen_ms", "__new").alias("last_seen_ms")
    )


def trace(edges: DataFrame, session, symbol: str, depth: int = 5, direction: str = "forward", since_ms: int | None = None, kinds: tuple[str, ...] | None = None, observed_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) and edges (src, dst, kind, weight, source) that a session saw from a symbol on.

    edges: KEY columns, hit_count, last_seen_ms and, where known, source_type.  The search
    begins at the keys whose symbol is symbol in any case, without white space around it.
    since_ms: older edges are left out; source is observed, bootstrapped or mixed.
    """
    from ..operators import traversal

    some = edges.where(F.col("session_id") == session)
    some = some if "source_type" in edges.columns else some.withColumn("source_type", F.lit("observed"))
    if since_ms is not None:
        some = seen_since(some, since_ms)
    if observed_only:
        some = some.where("source_type = 'observed'")
    ways = some.select(F.col("source_key").alias("src"), F.col("target_key").alias("dst"), "kind", "hit_count", "source_type")
    q = symbol.strip().lower()
    keys = ways.select(F.col("src").alias("id")).union(ways.select("dst")).distinct()
    seeds = keys.where(F.lower(F.trim(F.regexp_replace("id", "^(?:sym|node):", ""))) == q)
    nodes, used, _ = traversal.trace(ways.select("src", "dst", "kind"), seeds, depth, direction, kinds)
    weights = ways.groupBy("src", "dst", "kind").agg(F.sum("hit_count").alias("weight"), F.count_distinct("source_type").alias("__n"), F.min("source_type").alias("source"))
    return nodes, used.join(weights, ["src", "dst", "kind"]).select("src", "dst", "kind", "weight", F.when(F.col("__n") > 1, "mixed").otherwise(F.col("source")).alias("source"))
