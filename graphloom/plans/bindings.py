"""The property graph and its companions as projections of ordinary tables.

Each projection exists twice: as a DataFrame function here, and as DuckDB SQL in SQL,
a set of common table expressions from which oracle queries take what they need.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

class Tables:
    """The Parquet tables of a folder, read when asked for: Tables(spark, folder).orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


# parts: functions that call the part that follows them in an order


def part_nodes(t: Tables) -> DataFrame:
    """ord, id, kind, name, qualified_name, file_path, cyclomatic, exported, is_test, start_line, end_line."""
    test = F.col("p_partkey") % 10 == 3
    start = (F.col("p_partkey") * 7 % 400 + 1).cast("int")
    return t.part.select(
        F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 5 == 0, "class").when(F.col("p_partkey") % 5 == 1, "method").otherwise("function").alias("kind"),
        F.col("p_name").alias("name"), F.concat_ws(".", F.col("p_type"), F.col("p_name")).alias("qualified_name"),
        F.col("p_brand").alias("file_path"), F.col("p_size").alias("cyclomatic"), (F.col("p_partkey") % 3 != 0).alias("exported"), test.alias("is_test"),
        start.alias("start_line"), (start + F.col("p_size") * 3).cast("int").alias("end_line"),
    )


def _followed(t: Tables) -> DataFrame:
    """src, dst, confidence: each line's part and that of the next line of its order."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = t.lineitem.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(line).alias("dst"), F.round(F.col("l_discount") * 10, 1).alias("confidence"))
    return rows.where("dst IS NOT NULL AND src <> dst")


def part_edges(t: Tables) -> DataFrame:
    """src, dst, kind: distinct pairs of consecutive different parts of an order."""
    return _followed(t).select("src", "dst").distinct().withColumn("kind", F.when((F.col("src") + F.col("dst")) % 4 == 0, "imports").otherwise("calls"))


def part_calls(t: Tables) -> DataFrame:
    """src, dst, kind, confidence (0 to 1): the calls, with the best confidence they were resolved with."""
    rows = _followed(t).where("(src + dst) % 4 <> 0")
    return rows.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).withColumn("kind", F.lit("calls"))


def test_calls(t: Tables) -> DataFrame:
    """test, prod: who calls what, of the calls that tests make."""
    return part_edges(t).where("kind = 'calls' AND src % 10 = 3").select(F.col("src").alias("test"), F.col("dst").alias("prod"))


# orders of a customer: a chain of data flow


def order_nodes(t: Tables) -> DataFrame:
    """id, fn (customer), ord, status, priority, is_source, is_sink, is_sanitizer."""
    turn = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fn"), F.row_number().over(turn).alias("ord"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return rows.select(
        "*", (F.col("priority") == "1-URGENT").alias("is_source"), (F.col("priority") == "5-LOW").alias("is_sink"), (F.col("status") == "F").alias("is_sanitizer")
    )


def order_edges(t: Tables) -> DataFrame:
    """src, dst, fn: from each order to the customer's next."""
    turn = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(turn).alias("dst"), F.col("o_custkey").alias("fn"))
    return rows.where("dst IS NOT NULL")


# events: what a session observed


def runtime_events(t: Tables) -> DataFrame:
    """seq, session_id, ts_ms, kind, source_key, target_key: a user's event and the next."""
    turn = Window.partitionBy("user_id").orderBy("ts", "event_id")
    key = lambda c: F.concat(F.lit("sym:"), c)
    rows = t.events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.lit("runtime_call").alias("kind"),
        key(F.col("event_type")).alias("source_key"), key(F.lead("event_type").over(turn)).alias("target_key"),
    )
    return rows.where("target_key IS NOT NULL")


# suppliers as branches of change


def branch_items(t: Tables) -> DataFrame:
    """branch, item_kind, key, model: what each branch (a supplier) changed; distinct."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    files = rows.select(F.col("l_suppkey").alias("branch"), F.lit("file").alias("item_kind"), F.concat_ws("/", "p_brand", "p_type").alias("key"), F.lit(None).cast("string").alias("model"))
    label = F.when(F.col("l_returnflag") == "A", "symbol_added").when(F.col("l_returnflag") == "N", "symbol_modified").otherwise("signature_changed")
    symbols = rows.select(F.col("l_suppkey"), label, F.col("l_partkey").cast("string"), F.lit(None).cast("string"))
    schema = rows.where("l_quantity >= 49").select("l_suppkey", F.lit("schema_field"), F.concat_ws(".", "p_type", F.col("p_size").cast("string")), "p_type")
    summaries = rows.where("l_tax >= 0.07").select("l_suppkey", F.lit("summary_changed"), F.col("l_partkey").cast("string"), F.lit(None).cast("string"))
    return files.union(symbols).union(schema).union(summaries).distinct()


# orders as commits, their lines as files with line counts


def git_log(t: Tables) -> DataFrame:
    """hash, author_email, day, file, insertions, deletions: one row per file of a commit."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_orderkey").alias("hash"), F.concat(F.lit("c"), F.col("o_custkey"), F.lit("@x.org")).alias("author_email"), F.to_date("o_orderdate").alias("day"),
        F.concat(F.lit("f"), F.col("l_partkey") % 200).alias("file"), F.col("l_quantity").cast("long").alias("insertions"), F.floor(F.col("l_tax") * 100).cast("long").alias("deletions"),
    )


def findings(t: Tables) -> DataFrame:
    """repo, file_path, line, severity, rank (0 is worst), category: what a scan of suppliers might find."""
    k, n = F.col("s_suppkey") % 9, F.col("s_nationkey") % 6
    severity = F.when(k == 0, "critical").when(k == 1, "high").when(k == 2, "medium").otherwise("low")
    category = F.when(n == 0, "sql_injection").when(n == 1, "ssrf").when(n == 2, "path_traversal").otherwise("missing_auth")
    rows = t.supplier.select((F.col("s_suppkey") % 25).alias("repo"), F.concat(F.lit("f"), F.col("s_suppkey") % 50).alias("file_path"), F.col("s_nationkey").alias("line"), severity.alias("severity"), category.alias("category"), F.col("s_suppkey").alias("ord"))
    return rows.withColumn("rank", F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3))


def references(t: Tables, file_column: str | None = None) -> DataFrame:
    """field, ref_kind and, if asked for, a file: what code does with a field (a part)."""
    kind = F.when(F.col("l_returnflag") == "A", "read").when(F.col("l_returnflag") == "R", "query").otherwise("write")
    more = [F.col("l_suppkey").alias(file_column)] if file_column else []
    return t.lineitem.select(F.col("l_partkey").alias("field"), kind.alias("ref_kind"), *more)


def search_docs(t: Tables) -> DataFrame:
    """node_id, name, qualified_name, file_path: what search looks at."""
    return t.part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("qualified_name"), F.col("p_brand").alias("file_path"))


#: The same projections for DuckDB.
SQL = {
    "gp_nodes": """SELECT p_partkey AS ord, p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'class' WHEN p_partkey % 5 = 1 THEN 'method' ELSE 'function' END AS kind, p_name AS name,
        p_type || '.' || p_name AS qualified_name, p_brand AS file_path, p_size AS cyclomatic, p_partkey % 3 <> 0 AS exported, p_partkey % 10 = 3 AS is_test,
        CAST(p_partkey * 7 % 400 + 1 AS INTEGER) AS start_line, CAST(p_partkey * 7 % 400 + 1 + p_size * 3 AS INTEGER) AS end_line FROM part""",
    "gp_lead": """SELECT round(l_discount * 10, 1) AS confidence, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem""",
    "gp_edges": "SELECT DISTINCT src, dst, CASE WHEN (src + dst) % 4 = 0 THEN 'imports' ELSE 'calls' END AS kind FROM gp_lead WHERE dst IS NOT NULL AND src <> dst",
    "gp_calls": "SELECT src, dst, max(confidence) AS confidence FROM gp_lead WHERE dst IS NOT NULL AND src <> dst AND (src + dst) % 4 <> 0 GROUP BY src, dst",
    "gs_findings": """SELECT s_suppkey % 25 AS repo, 'f' || (s_suppkey % 50) AS file_path, s_nationkey AS line, CASE s_suppkey % 9 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
        CASE s_suppkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank, CASE s_nationkey % 6 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'ssrf' WHEN 2 THEN 'path_traversal' ELSE 'missing_auth' END AS category, s_suppkey AS ord FROM supplier""",
    "gc_nodes": """SELECT o_orderkey AS id, o_custkey AS fn, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord, o_orderstatus AS status, o_orderpriority AS priority,
        o_orderpriority = '1-URGENT' AS is_source, o_orderpriority = '5-LOW' AS is_sink, o_orderstatus = 'F' AS is_sanitizer FROM orders""",
    "gc_edges": "SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst, o_custkey AS fn FROM orders) WHERE dst IS NOT NULL",
    "rt_events": """SELECT * FROM (SELECT event_id AS seq, user_id AS session_id, epoch_us(ts) // 1000 AS ts_ms, 'runtime_call' AS kind, 'sym:' || event_type AS source_key,
        'sym:' || lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target_key FROM events) WHERE target_key IS NOT NULL""",
    "br_rows": "SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey",
    "br_items": """SELECT l_suppkey AS branch, 'file' AS item_kind, p_brand || '/' || p_type AS key, NULL AS model FROM br_rows
        UNION SELECT l_suppkey, CASE l_returnflag WHEN 'A' THEN 'symbol_added' WHEN 'N' THEN 'symbol_modified' ELSE 'signature_changed' END, CAST(l_partkey AS VARCHAR), NULL FROM br_rows
        UNION SELECT l_suppkey, 'schema_field', p_type || '.' || CAST(p_size AS VARCHAR), p_type FROM br_rows WHERE l_quantity >= 49
        UNION SELECT l_suppkey, 'summary_changed', CAST(l_partkey AS VARCHAR), NULL FROM br_rows WHERE l_tax >= 0.07""",
    "git_log": """SELECT o_orderkey AS hash, 'c' || o_custkey || '@x.org' AS author_email, CAST(o_orderdate AS DATE) AS day, 'f' || (l_partkey % 200) AS file, CAST(l_quantity AS BIGINT) AS insertions,
        CAST(floor(l_tax * 100) AS BIGINT) AS deletions FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "docs_search": "SELECT p_partkey AS node_id, p_name AS name, p_type || ' ' || p_brand AS qualified_name, p_brand AS file_path FROM part",
}


def with_ctes(sql: str, recursive: bool = False) -> str:
    """sql preceded by the projections it mentions, and those they mention."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(SQL[name])
                need.append(name)

    visit(sql)
    heads = [f"{name} AS ({SQL[name]})" for name in need]
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        recursive = recursive or bool(m[1])
        body = body[m.end() :]
        join = ", " if heads else ""
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(heads)}{join}{body}"
    return f"WITH {', '.join(heads)} {body}" if heads else body
