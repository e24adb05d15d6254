"""Every operator applied to the driver's tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import rules
from .operators import branches, flow, lookups, metrics, schema, search_index, text, traversal, vector_index, views
from .plans import bindings as B
from .plans.deltas import Deltas, last_wins
from .plans.lineage import scratch
from .registry import query

# lookups and filters


@query("p1_nodes_by_file", "SELECT id, name, kind FROM gp_nodes WHERE file_path = 'Brand#12'")
def _(t):
    return B.part_nodes(t).where("file_path = 'Brand#12'").select("id", "name", "kind")


@query("p2_find_by_name", "SELECT id, name FROM gp_nodes WHERE name = 'small ring' OR qualified_name = 'small ring'")
def _(t):
    return lookups.by_name(B.part_nodes(t), "small ring").select("id", "name")


@query("p3_at_line", "SELECT id, start_line, end_line FROM gp_nodes WHERE file_path = 'Brand#11' AND start_line <= 120 AND (end_line IS NULL OR end_line >= 120)")
def _(t):
    return lookups.at_line(B.part_nodes(t), "Brand#11", 120).select("id", "start_line", "end_line")


@query("p4_edges_by_kind", "SELECT src, dst FROM gp_edges WHERE kind = 'imports'")
def _(t):
    return B.part_edges(t).where("kind = 'imports'").select("src", "dst")


@query("p5_neighbours", "SELECT dst AS id FROM gp_edges WHERE src = 5 UNION SELECT src FROM gp_edges WHERE dst = 5")
def _(t):
    return lookups.neighbours(B.part_edges(t), 5)


@query("p6_count_by_kind", "SELECT kind, count(*) AS n, count(DISTINCT file_path) AS files FROM gp_nodes GROUP BY kind")
def _(t):
    return B.part_nodes(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


@query("p7_remove_node", "SELECT src, dst, kind FROM gp_edges WHERE src NOT IN (SELECT id FROM gp_nodes WHERE is_test) AND dst NOT IN (SELECT id FROM gp_nodes WHERE is_test)")
def _(t):
    nodes = B.part_nodes(t)
    return lookups.without_node(nodes, B.part_edges(t), nodes.where("is_test").select("id"))[1].select("src", "dst", "kind")


@query("p8_symbol_search", "SELECT id, name FROM gp_nodes WHERE contains(lower(name), 'l ring') OR contains(lower(qualified_name), 'l ring') ORDER BY ord LIMIT 50")
def _(t):
    return lookups.substring_search(B.part_nodes(t), "L Ring", 50).select("id", "name")


#: A third of the names as they are, a third with more behind, a third with more before them.
_VARIED = "CASE id % 3 WHEN 0 THEN name WHEN 1 THEN name || ' two' ELSE 'my ' || name END"


@query(
    "p9_suggest",
    f"""SELECT id, tier FROM (SELECT id, ord, CASE WHEN lower(n) = 'small ring' THEN 0 WHEN starts_with(lower(n), 'small ring') THEN 1
        WHEN contains(lower(n), 'small ring') OR contains(lower(qualified_name), 'small ring') THEN 2 END AS tier FROM (SELECT *, {_VARIED} AS n FROM gp_nodes)) WHERE tier IS NOT NULL ORDER BY tier, ord LIMIT 30""",
)
def _(t):
    return lookups.suggest(B.part_nodes(t).withColumn("name", F.expr(_VARIED)), "Small Ring", 30).select("id", "tier")


@query(
    "p11_severity_filter",
    "SELECT o_orderkey AS id, o_orderpriority AS severity FROM orders WHERE CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END >= 2 AND o_totalprice > 100000",
)
def _(t):
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    rows = t.orders.where((lookups.severity_rank(severity) >= 2) & (F.col("o_totalprice") > 100000))
    return rows.select(F.col("o_orderkey").alias("id"), p.alias("severity"))


@query("p14_repo_counts", "SELECT r_name, count(DISTINCT n_nationkey) AS files, count(DISTINCT c_custkey) AS classes FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def _(t):
    rows = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("files"), F.count_distinct("c_custkey").alias("classes"))


@query(
    "p16_definition_line",
    r"""SELECT doc_id, min(pos) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
        WHERE regexp_matches(line, '\bthe\b') GROUP BY doc_id""",
)
def _(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"\bthe\b")).groupBy("doc_id").agg((F.min("pos") + 1).cast("long").alias("line"))


@query("p17_snippet", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS snippet FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 3), "\n").alias("snippet"))


@query("s3_language", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'cpp' WHEN 3 THEN 'ruby' END AS language FROM part")
def _(t):
    end = F.element_at(F.array(*[F.lit(x) for x in ("a.TS", "b.py", "CMakeLists.txt", "Gemfile", "README.md")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), rules.language(F.concat_ws("/", F.lit("src"), end)).alias("language"))


@query("k1_upsert", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(t):
    half = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    newest = half.agg(F.max("o_orderkey").alias("top"))
    parts = half.crossJoin(newest)  # one row
    old, new = parts.where("o_orderkey <= top / 2").drop("top"), parts.where("o_orderkey > top / 2").drop("top")
    return lookups.upsert(old, new, ["o_custkey"], "o_orderkey")


@query("k1_batched_upserts", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(t):
    kept = Deltas(t.spark, scratch(t.spark), last_wins(["o_custkey"], ["batch", "o_orderkey"]))
    for i in range(5):
        kept.write(t.orders.where(F.col("o_orderkey") % 5 == i).select("o_custkey", "o_orderkey", "o_totalprice", F.lit(i).alias("batch")), i)
    return kept.read().drop("batch")


@query("k3_drop_unresolved", "SELECT kind, count(*) AS n FROM gp_edges WHERE dst % 3 <> 0 GROUP BY kind")
def _(t):
    edges = B.part_edges(t).withColumn("dst", F.when(F.col("dst") % 3 != 0, F.col("dst")))
    return lookups.resolved_edges(edges)[0].groupBy("kind").agg(F.count("*").alias("n"))


# joins


@query("j1_callers", "SELECT e.dst AS id, n.id AS caller, n.name FROM gp_edges e JOIN gp_nodes n ON n.id = e.src WHERE e.kind = 'calls'")
def _(t):
    edges = B.part_edges(t).where("kind = 'calls'")
    return edges.join(B.part_nodes(t).select(F.col("id").alias("caller"), "name"), F.col("src") == F.col("caller")).select(F.col("dst").alias("id"), "caller", "name")


@query("j4_session_stats", "SELECT c_custkey AS id, count(o_orderkey) AS edges, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS BIGINT) AS observed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    rows = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("id"))
    return rows.agg(F.count("o_orderkey").alias("edges"), F.coalesce(F.sum((F.col("o_orderstatus") == "F").cast("int")), F.lit(0)).alias("observed"))


@query("j5_first_match", "SELECT s_suppkey AS ref, (SELECT min(id) FROM gp_nodes n WHERE n.file_path = 'Brand#' || (10 + s_suppkey % 50)) AS target FROM supplier")
def _(t):
    refs = t.supplier.select(F.col("s_suppkey").alias("ref"), F.concat(F.lit("Brand#"), 10 + F.col("s_suppkey") % 50).alias("q"))
    nodes = B.part_nodes(t).select("id", "ord", F.col("file_path").alias("name"))
    return lookups.first_match(refs, "q", nodes).select("ref", "target")


@query(
    "j6_enclosing_symbol",
    """SELECT p.point, (SELECT n.id FROM gp_nodes n WHERE n.file_path = p.file_path AND n.kind IN ('function', 'method', 'class', 'module') AND p.line BETWEEN n.start_line AND n.end_line
            ORDER BY n.end_line - n.start_line, n.ord LIMIT 1) AS symbol_id
        FROM (SELECT p_partkey AS point, p_brand AS file_path, CAST(p_partkey * 13 % 500 AS INTEGER) AS line FROM part) p""",
)
def _(t):
    points = t.part.select(F.col("p_partkey").alias("point"), F.col("p_brand").alias("file_path"), (F.col("p_partkey") * 13 % 500).cast("int").alias("line"))
    return lookups.enclosing(points, B.part_nodes(t)).select("point", "symbol_id")


@query(
    "j7_call_resolution",
    """WITH calls AS (SELECT p_partkey AS call, p_brand AS file_path, 'F' || (p_partkey * 7 % 40) AS callee FROM part),
        fns AS (SELECT id, ord, kind, exported, file_path, 'F' || (id % 60) AS name FROM gp_nodes WHERE kind IN ('function', 'method', 'constructor')),
        same AS (SELECT file_path, name, arg_min(id, ord) AS id FROM fns GROUP BY ALL),
        everywhere AS (SELECT name, coalesce(arg_min(id, ord) FILTER (WHERE exported), arg_min(id, ord)) AS id FROM fns GROUP BY name)
        SELECT call, coalesce(s.id, g.id) AS target, CASE WHEN s.id IS NOT NULL THEN 'same_file' WHEN g.id IS NOT NULL THEN 'global' END AS tier,
            CASE WHEN s.id IS NOT NULL THEN 0.95::DOUBLE WHEN g.id IS NOT NULL THEN 0.5::DOUBLE END AS confidence
        FROM calls c LEFT JOIN same s ON s.file_path = c.file_path AND s.name = c.callee LEFT JOIN everywhere g ON g.name = c.callee""",
)
def _(t):
    calls = t.part.select(F.col("p_partkey").alias("call"), F.col("p_brand").alias("file_path"), F.concat(F.lit("F"), F.col("p_partkey") * 7 % 40).alias("callee"))
    nodes = B.part_nodes(t).withColumn("name", F.concat(F.lit("F"), F.col("id") % 60))
    none = nodes.where("false").select("file_path", "name", "qualified_name")
    return lookups.resolve_calls(calls, nodes, none).select("call", "target", "tier", "confidence")


@query("j17_uncovered", "SELECT n.id FROM gp_nodes n WHERE NOT n.is_test AND n.id NOT IN (SELECT dst FROM gp_edges WHERE kind = 'calls' AND src % 10 = 3)")
def _(t):
    nodes = B.part_nodes(t)
    return metrics.uncovered(nodes, B.test_calls(t)).select("id")


@query("j18_orphan_entries", "SELECT id FROM gp_nodes WHERE kind IN ('function', 'method', 'constructor') AND id NOT IN (SELECT dst FROM gp_calls WHERE confidence >= 0.8)")
def _(t):
    return lookups.orphans(B.part_nodes(t), lookups.confident(B.part_calls(t), 0.8)).select("id")


@query(
    "j19_arguments_to_parameters",
    """WITH a AS (SELECT l_orderkey AS call, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, l_partkey AS arg FROM lineitem),
        p AS (SELECT l_suppkey AS call, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos, l_partkey AS param FROM lineitem)
        SELECT a.call, a.pos, arg, param FROM a JOIN p USING (call, pos)""",
)
def _(t):
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    a = t.lineitem.select(F.col("l_orderkey").alias("call"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*line)).cast("long").alias("pos"), F.col("l_partkey").alias("arg"))
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")).cast("long")
    p = t.lineitem.select(F.col("l_suppkey").alias("call"), rank.alias("pos"), F.col("l_partkey").alias("param"))
    return a.join(p, ["call", "pos"])


@query(
    "j20_node_detail",
    """WITH c AS (SELECT src, dst FROM gp_edges WHERE kind = 'calls'), s AS (SELECT file_path, count(*) - 1 AS siblings FROM gp_nodes GROUP BY file_path)
        SELECT n.id, s.siblings, coalesce(i.c, 0) AS callers, coalesce(o.c, 0) AS callees, coalesce(m.name, '?') AS first_callee, coalesce(m.kind, 'unknown') AS first_kind FROM gp_nodes n JOIN s USING (file_path)
        LEFT JOIN (SELECT dst, count(*) AS c FROM c GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c, min(dst) AS d FROM c GROUP BY src) o ON o.src = n.id LEFT JOIN gp_nodes m ON m.id = o.d""",
)
def _(t):
    return lookups.node_detail(B.part_nodes(t), B.part_edges(t))


@query(
    "j21_runtime_node",
    "SELECT s_suppkey AS ref, coalesce((SELECT min(id) FROM gp_nodes WHERE id = s_suppkey), (SELECT min(id) FROM gp_nodes WHERE lower(name) = lower(s_name))) AS node FROM supplier",
)
def _(t):
    nodes = B.part_nodes(t)
    by_id = nodes.select(F.col("id").alias("s_suppkey"), F.col("id").alias("a"))
    by_name = nodes.groupBy(F.lower("name").alias("n")).agg(F.min("id").alias("b"))
    rows = t.supplier.join(by_id, "s_suppkey", "left").join(by_name, F.lower("s_name") == F.col("n"), "left")
    return rows.select(F.col("s_suppkey").alias("ref"), F.coalesce("a", "b").alias("node"))


# aggregations


@query(
    "a2_coupling",
    """SELECT n.id, coalesce(i.c, 0) AS ca, coalesce(o.c, 0) AS ce, CASE WHEN coalesce(i.c, 0) + coalesce(o.c, 0) > 0 THEN round(coalesce(o.c, 0)::DOUBLE / (coalesce(i.c, 0) + coalesce(o.c, 0)), 9) ELSE 0 END AS instability
        FROM gp_nodes n LEFT JOIN (SELECT dst, count(*) AS c FROM gp_edges GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM gp_edges GROUP BY src) o ON o.src = n.id""",
)
def _(t):
    return metrics.coupling(B.part_nodes(t), B.part_edges(t)).select("id", "ca", "ce", F.round("instability", 9).alias("instability"))


@query(
    "a3_file_coupling",
    """WITH per AS (SELECT n.file_path, n.kind, coalesce(i.c, 0) AS ca, coalesce(o.c, 0) AS ce FROM gp_nodes n LEFT JOIN (SELECT dst, count(*) AS c FROM gp_edges GROUP BY dst) i ON i.dst = n.id
        LEFT JOIN (SELECT src, count(*) AS c FROM gp_edges GROUP BY src) o ON o.src = n.id)
        SELECT file_path, CAST(sum(ca) AS BIGINT) AS ca, CAST(sum(ce) AS BIGINT) AS ce, round(sum(ce)::DOUBLE / (sum(ca) + sum(ce)), 9) AS instability FROM per GROUP BY file_path HAVING sum(ca) + sum(ce) > 0""",
)
def _(t):
    rows = metrics.file_coupling(metrics.coupling(B.part_nodes(t), B.part_edges(t)))
    return rows.where("ca + ce > 0").select("file_path", "ca", "ce", F.round("instability", 9).alias("instability"))


@query(
    "a4_churn",
    """SELECT file, count(DISTINCT hash) AS commits, count(DISTINCT author_email) AS authors, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(max(day) AS VARCHAR) AS last_day,
        count(DISTINCT CASE WHEN day > DATE '2001-08-01' - 300 THEN hash END) AS recent_commits
        FROM git_log WHERE day >= DATE '2001-08-01' - 900 AND day <= DATE '2001-08-01' GROUP BY file""",
)
def _(t):
    return metrics.churn(B.git_log(t), "2001-08-01", 900, 300).withColumn("last_day", F.col("last_day").cast("string"))


@query(
    "a5_cyclomatic",
    "SELECT n.fn, greatest(1, coalesce(e.c, 0) - n.c + 2) AS cyclomatic FROM (SELECT fn, count(*) AS c FROM gc_nodes GROUP BY fn) n LEFT JOIN (SELECT fn, count(*) AS c FROM gc_edges GROUP BY fn) e USING (fn)",
)
def _(t):
    return metrics.cyclomatic(B.order_nodes(t), B.order_edges(t))


@query(
    "a7_cognitive",
    """SELECT fn, CAST(sum(CASE WHEN nests THEN 1 + before ELSE 0 END) AS BIGINT) AS cognitive FROM (SELECT fn, status <> 'P' AS nests,
        coalesce(sum(CASE WHEN status <> 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY fn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM gc_nodes) GROUP BY fn""",
)
def _(t):
    kind = F.when(F.col("status") == "F", "branch").when(F.col("status") == "O", "loop_header").otherwise("statement")
    return metrics.cognitive(B.order_nodes(t).select("fn", "ord", kind.alias("kind")))


@query(
    "a8_halstead",
    r"""WITH tok AS (SELECT p_brand AS fn, unnest(regexp_split_to_array(p_name || ' = (' || p_type || ' + ' || p_size || ')', '\s+|[(){}\[\],;]')) AS token FROM part),
        k AS (SELECT fn, count(DISTINCT CASE WHEN regexp_matches(token, '^[+\-*/=<>!&|^~%?:]') THEN token END) AS n1, count(DISTINCT CASE WHEN NOT regexp_matches(token, '^[+\-*/=<>!&|^~%?:]') THEN token END) AS n2 FROM tok WHERE token <> '' GROUP BY fn)
        SELECT fn, round(n * log2(greatest(n1, 1) + greatest(n2, 1)), 6) AS volume FROM k JOIN (SELECT p_brand AS fn, count(*) AS n FROM part GROUP BY p_brand) USING (fn)""",
)
def _(t):
    rows = t.part.select(F.col("p_brand").alias("fn"), F.format_string("%s = (%s + %d)", "p_name", "p_type", "p_size").alias("text"))
    return metrics.halstead(rows).select("fn", F.round("volume", 6).alias("volume"))


@query("a11_findings_by_severity", "SELECT v.severity, count(f.severity) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) v(severity) LEFT JOIN gs_findings f USING (severity) GROUP BY v.severity")
def _(t):
    return metrics.by_severity(B.findings(t)).select("severity", "n")


_FINDINGS = "SELECT repo, severity, category FROM gs_findings"


@query(
    "a12_security_score",
    f"""WITH f AS ({_FINDINGS}), s AS (SELECT repo, greatest(0, least(100, 100 - count(*) FILTER (severity = 'critical') * 20 - count(*) FILTER (severity = 'high') * 8 - count(*) FILTER (severity = 'medium') * 3 - count(*) FILTER (severity = 'low'))) AS taint,
        greatest(0, 100 - 12 * count(*) FILTER (category = 'sql_injection')) AS inputs, greatest(0, 100 - 15 * count(*) FILTER (category = 'ssrf')) AS dependencies, greatest(0, 100 - 10 * count(*) FILTER (category = 'path_traversal')) AS flows FROM f GROUP BY repo),
        o AS (SELECT *, CAST(floor(taint * 0.4::DOUBLE + inputs * 0.25::DOUBLE + dependencies * 0.2::DOUBLE + flows * 0.15::DOUBLE + 0.5) AS BIGINT) AS overall FROM s)
        SELECT *, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END AS grade FROM o""",
)
def _(t):
    return metrics.security_score(B.findings(t).select("repo", "severity", "category"), "repo")


@query(
    "a15_coverage",
    """SELECT file_path, count(*) AS total, count(c.dst) AS covered, round(count(c.dst) * 100.0::DOUBLE / count(*), 6) AS percent FROM gp_nodes n
        LEFT JOIN (SELECT DISTINCT dst FROM gp_edges WHERE kind = 'calls' AND src % 10 = 3) c ON c.dst = n.id WHERE NOT n.is_test GROUP BY file_path""",
)
def _(t):
    nodes = B.part_nodes(t)
    links = B.part_edges(t).where("kind = 'calls'").join(nodes.where("is_test").select(F.col("id").alias("src")), "src").select(F.col("dst").alias("prod"))
    return metrics.coverage(nodes, links).withColumn("percent", F.round("percent", 6))


@query("a17_community_sizes", "SELECT file_path AS community, count(*) AS size, string_agg(id, ',' ORDER BY ord) AS members FROM gp_nodes GROUP BY file_path HAVING count(*) >= 2")
def _(t):
    rows = B.part_nodes(t).select(F.col("file_path").alias("community"), "id", "ord")
    return metrics.community_sizes(rows).select("community", "size", F.array_join("members", ",").alias("members"))


@query(
    "a18_field_usage",
    "SELECT l_partkey AS field, CAST(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END) AS BIGINT) AS reads, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS writes, count(*) AS total FROM lineitem GROUP BY 1",
)
def _(t):
    return schema.usage(B.references(t))


@query("a22_ahead_behind", "SELECT count(*) FILTER (a AND NOT b) AS ahead, count(*) FILTER (b AND NOT a) AS behind FROM (SELECT l_orderkey, bool_or(l_suppkey = 1) AS a, bool_or(l_suppkey = 2) AS b FROM lineitem GROUP BY l_orderkey)")
def _(t):
    sides = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_suppkey") == 1).alias("a"), F.bool_or(F.col("l_suppkey") == 2).alias("b"))
    return sides.agg(F.count_if(F.expr("a AND NOT b")).alias("ahead"), F.count_if(F.expr("b AND NOT a")).alias("behind"))


# windows, ranking, top-k


@query("w2_latest_metrics", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def _(t):
    return lookups.latest(t.orders, ["o_custkey"], "o_orderkey", 3).select("o_custkey", "o_orderkey")


@query("w3_trend", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) AS change FROM orders")
def _(t):
    turn = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(turn), 4).alias("change"))


@query("w4_worst_first", "SELECT o_custkey, arg_max(o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END) * 100000000 - o_orderkey) AS id FROM orders GROUP BY o_custkey")
def _(t):
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    rows = t.orders.select(F.col("o_custkey").alias("file_path"), F.lit(0).alias("line"), F.lit("x").alias("category"), severity.alias("severity"), F.col("o_orderkey").alias("ord"))
    return text.worst_first(rows).select(F.col("file_path").alias("o_custkey"), F.col("ord").alias("id"))


@query("w5_keep_first", "SELECT l_orderkey, l_returnflag, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL")
def _(t):
    return lookups.keep_first(t.lineitem, ["l_orderkey", "l_returnflag"], ["l_partkey"]).select("l_orderkey", "l_returnflag", "l_partkey")


@query("w6_ssa_versions", "SELECT id, row_number() OVER (PARTITION BY fn, status ORDER BY ord) AS version FROM gc_nodes")
def _(t):
    return flow.ssa_versions(B.order_nodes(t).withColumn("name", F.col("status"))).select("id", F.col("version").cast("long").alias("version"))


@query("t3_newest_snapshots", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))


@query("t6_riskiest_in_diff", "SELECT l_orderkey, arg_max(l_linenumber, l_extendedprice * 1000 - l_linenumber) AS line FROM lineitem GROUP BY l_orderkey")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct(F.col("l_extendedprice"), -F.col("l_linenumber"))).alias("line"))


# traversals

_REACH = "WITH RECURSIVE r(id, depth) AS ({seed} UNION SELECT {to}, r.depth + 1 FROM r JOIN {edges} e ON e.{at} = r.id {where} {bound}) SELECT id, min(depth) AS depth FROM r {keep} GROUP BY id"


def _seed(t, value=7):
    return t.part.where(F.col("p_partkey") == value).select(F.col("p_partkey").alias("id"))


@query(
    "g1_trace",
    _REACH.format(seed="SELECT CAST(7 AS BIGINT), 0", to="e.dst", at="src", edges="(SELECT src, dst FROM gp_edges UNION SELECT dst, src FROM gp_edges)", where="", bound="WHERE r.depth < 3", keep=""),
)
def _(t):
    return traversal.trace(B.part_edges(t), _seed(t), 2, "both")[0].select("id", F.col("depth").cast("int").alias("depth"))


@query("g2_transitive_callers", _REACH.format(seed="SELECT CAST(7 AS BIGINT), 0", to="e.src", at="dst", edges="gp_edges", where="AND e.kind = 'calls'", bound="WHERE r.depth < 9", keep="WHERE id <> 7"))
def _(t):
    return traversal.transitive_callers(B.part_edges(t), _seed(t)).select("id", F.col("depth").cast("int").alias("depth"))


@query(
    "g3_count_callers",
    "WITH RECURSIVE r(root, id) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.root, e.src FROM r JOIN gp_edges e ON e.dst = r.id AND e.kind = 'calls') SELECT root AS id, count(*) - 1 AS callers FROM r GROUP BY root",
)
def _(t):
    return traversal.count_callers(B.part_edges(t), t.part.select(F.col("p_partkey").alias("id")))


@query("g4_impact", _REACH.format(seed="SELECT CAST(7 AS BIGINT), 0", to="e.src", at="dst", edges="gp_edges", where="", bound="WHERE r.depth < 2", keep=""))
def _(t):
    return traversal.impact(B.part_edges(t), _seed(t), 2).select("id", F.col("depth").cast("int").alias("depth"))


@query(
    "g5_context",
    """WITH RECURSIVE s AS (SELECT *, src * 4294967296 + dst AS ord FROM gp_edges), b AS (SELECT src AS here, dst AS "to", kind AS relation, 0 AS way, ord FROM s UNION ALL SELECT dst, src, 'inverse_' || kind, 1, ord FROM s),
        d1 AS (SELECT "to" AS id, 1 AS depth, arg_min(relation, row(way, ord)) AS relation, min(row(way, ord)) AS place FROM b WHERE here = 7 AND "to" <> 7 GROUP BY "to"),
        d2 AS (SELECT "to" AS id, 2 AS depth, arg_min(b.relation, row(d1.place, way, ord)) AS relation FROM d1 JOIN b ON b.here = d1.id WHERE "to" <> 7 AND "to" NOT IN (SELECT id FROM d1) GROUP BY "to")
        SELECT CAST(7 AS BIGINT) AS id, 0 AS depth, 'self' AS relation UNION ALL SELECT id, depth, relation FROM d1 UNION ALL SELECT id, depth, relation FROM d2""",
)
def _(t):
    return traversal.context(B.part_edges(t).withColumn("ord", F.col("src") * 4294967296 + F.col("dst")), 7)


@query("g6_flow_paths", "SELECT fn AS root, string_agg(id, '>' ORDER BY ord) AS path FROM gc_nodes GROUP BY fn HAVING max(ord) <= 6")
def _(t):
    edges = B.order_edges(t).withColumn("kind", F.lit("data_flow")).withColumn("ord", F.col("dst"))
    found = traversal.flow_paths(edges, B.order_nodes(t).where("ord = 1").select(F.col("fn").alias("root"), "id"), 5)
    return found.select("root", F.array_join("path", ">").alias("path"))


@query("g9_processes")
def _(t):
    edges = B.part_edges(t).withColumn("ord", F.xxhash64("src", "dst"))
    entries = B.part_nodes(t).where("exported AND kind = 'function'").select("id")
    return traversal.processes(edges, entries).select("entry", "step", "id", "depth", "is_branch")


_LINKS = """calls AS (SELECT src, dst FROM gp_edges WHERE kind = 'calls'), direct AS (SELECT src AS test, dst AS prod FROM calls WHERE src % 10 = 3 AND dst % 10 <> 3),
    links AS (SELECT test, prod, 'direct' AS link, NULL::BIGINT AS via FROM direct UNION ALL SELECT d.test, c.dst, 'transitive', min(c.src) FROM direct d JOIN calls c ON c.src = d.prod WHERE c.dst % 10 <> 3 GROUP BY d.test, c.dst)"""


@query("g12_test_links", f"WITH {_LINKS} SELECT * FROM links")
def _(t):
    return traversal.test_links(B.part_edges(t), B.part_nodes(t))


@query(
    "g13_test_impact",
    f"""WITH {_LINKS}, changed AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 = 2), own AS (SELECT test, 0 AS rank, link FROM links JOIN changed ON prod = id),
        callers AS (SELECT DISTINCT src FROM calls WHERE dst IN (SELECT id FROM changed) AND dst IN (SELECT prod FROM links)), more AS (SELECT test, 1, 'transitive' FROM links WHERE prod IN (SELECT src FROM callers))
        SELECT test, arg_min(link, rank * 10 + CASE link WHEN 'direct' THEN 0 ELSE 1 END) AS reason FROM (SELECT * FROM own UNION ALL SELECT * FROM more) GROUP BY test""",
)
def _(t):
    edges = B.part_edges(t)
    return traversal.test_impact(traversal.test_links(edges, B.part_nodes(t)), edges, t.part.where("p_partkey % 7 = 2").select(F.col("p_partkey").alias("id")))


@query("g14_shortest_path")
def _(t):
    return traversal.shortest_path(B.part_edges(t), 7, 11)


@query(
    "g14_path_lengths",
    """WITH RECURSIVE b AS (SELECT src AS at, dst AS n FROM gp_edges UNION SELECT dst, src FROM gp_edges), r(id, depth) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT b.n, r.depth + 1 FROM r JOIN b ON b.at = r.id WHERE r.depth < 8)
        SELECT id, min(depth) AS depth FROM r GROUP BY id""",
)
def _(t):
    return traversal.reach(B.part_edges(t), _seed(t).select(F.lit(0).alias("root"), "id"), None, "both").select("id", "depth")


@query("g18_reaching_definitions", "SELECT a.fn, a.id AS definition, b.id FROM gc_nodes a JOIN gc_nodes b ON a.fn = b.fn AND b.ord >= a.ord WHERE a.status = 'P'")
def _(t):
    return flow.reaching(B.order_nodes(t).withColumn("is_def", F.col("status") == "P"), B.order_edges(t))


@query("g19_use_def", "SELECT dst, string_agg(src, ',' ORDER BY src) AS definitions FROM gp_edges GROUP BY dst")
def _(t):
    return flow.use_def(B.part_edges(t)).select("dst", F.array_join("definitions", ",").alias("definitions"))


@query("g20_phi", "SELECT dst, count(*) AS incoming FROM gp_edges GROUP BY dst HAVING count(*) > 1")
def _(t):
    return flow.phi(B.part_edges(t))


@query(
    "g22_taint",
    """WITH p AS (SELECT a.fn, a.id AS source, b.id AS sink, b.ord - a.ord + 1 AS length, (SELECT bool_or(m.is_sanitizer) FROM gc_nodes m WHERE m.fn = a.fn AND m.ord > a.ord AND m.ord <= b.ord) AS sanitized,
            (SELECT count(*) FROM gc_nodes m WHERE m.fn = a.fn AND m.ord > a.ord AND m.ord < b.ord AND m.is_sink) AS between_ FROM gc_nodes a JOIN gc_nodes b ON a.fn = b.fn AND b.ord > a.ord WHERE a.is_source AND b.is_sink)
        SELECT fn, source, sink, sanitized, CAST(length AS INTEGER) AS length, CASE WHEN NOT sanitized THEN 'critical' WHEN length > 5 THEN 'warning' ELSE 'info' END AS severity FROM p WHERE between_ = 0""",
)
def _(t):
    return flow.taint(B.order_nodes(t), B.order_edges(t))


@query(
    "g24_side_effects",
    """WITH RECURSIVE e(fn, target, d) AS (SELECT p_partkey, p_type, 0 FROM part WHERE p_size > 40 UNION SELECT c.src, e.target, e.d + 1 FROM e JOIN gp_edges c ON c.dst = e.fn AND c.kind = 'calls' WHERE e.d < 3)
        SELECT DISTINCT fn, target FROM e""",
)
def _(t):
    own = t.part.where("p_size > 40").select(F.col("p_partkey").alias("fn"), F.lit("db_write").alias("kind"), F.col("p_type").alias("target"))
    return flow.side_effects(B.part_edges(t).where("kind = 'calls'"), own).select("fn", "target").distinct()


@query(
    "g26_graph_stats",
    """WITH n AS (SELECT id FROM gp_nodes WHERE kind = 'function' AND NOT is_test), e AS (SELECT count(*) AS e FROM gp_edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)), v AS (SELECT count(*) AS v FROM n)
        SELECT v AS nodes, e AS edges, round(2.0::DOUBLE * e / (v * (v - 1)), 9) AS density, round(2.0::DOUBLE * e / v, 9) AS degree FROM e, v""",
)
def _(t):
    nodes = B.part_nodes(t).where("kind = 'function' AND NOT is_test").select("id")
    edges = B.part_edges(t).join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    v, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    density = F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1))
    return v.crossJoin(e).select("nodes", "edges", F.round(density, 9).alias("density"), F.round(F.try_divide(2.0 * F.col("edges"), F.col("nodes")), 9).alias("degree"))


@query("g10_label_propagation")
def _(t):
    edges = B.part_edges(t).select("src", "dst", F.when(F.col("kind") == "calls", 1.0).otherwise(2.0).alias("weight"))
    return flow.label_propagation(edges)


@query("g10_local_moving")
def _(t):
    edges = B.part_edges(t).select(F.lit(0).cast("long").alias("repo"), "src", "dst", F.when(F.col("kind") == "calls", 1.0).otherwise(2.0).alias("weight"))
    nodes = B.part_nodes(t).select(F.lit(0).cast("long").alias("repo"), "id", "ord")
    return flow.local_moving(edges, nodes)


# search

_BM25 = """WITH tok AS (SELECT node_id, unnest(list_filter(regexp_split_to_array(lower(name || ' ' || qualified_name || ' ' || file_path), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM docs_search),
    post AS (SELECT node_id, term, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT node_id, count(*) AS dl FROM tok GROUP BY node_id), facts AS (SELECT avg(dl) AS avgdl FROM len), nd AS (SELECT count(*) AS n FROM docs_search),
    q AS (SELECT unnest(['small', 'brand']) AS term), df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
    bm AS (SELECT node_id, -sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score, count(*) AS c
        FROM post JOIN df USING (term) JOIN len USING (node_id), facts, nd GROUP BY node_id HAVING count(*) = 2)"""


@query("r1_bm25", f"{_BM25} SELECT node_id, round(score, 9) AS score FROM bm ORDER BY round(bm.score, 9), node_id LIMIT 50")
def _(t):
    return text.bm25(B.search_docs(t), "small brand").select("node_id", F.round("score", 9).alias("score"))


@query("r1_indexed", f"{_BM25} SELECT node_id, round(score, 9) AS score FROM bm ORDER BY round(bm.score, 9), node_id LIMIT 50")
def _(t):
    path = scratch(t.spark)
    search_index.build(B.search_docs(t), path)
    return search_index.bm25(t.spark, path, "small brand").select("node_id", F.round("score", 9).alias("score"))


_TFIDF = """tf AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest(regexp_split_to_array(regexp_replace(lower(name || ' ' || coalesce(qualified_name, 'null')), '[^a-z0-9_]', ' ', 'g'), '[\\s_]+')) AS term FROM docs_search) WHERE length(term) > 1 GROUP BY ALL),
    n AS (SELECT count(*) AS n FROM docs_search), idf AS (SELECT term, ln((n + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM tf, n GROUP BY term, n), w AS (SELECT node_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
    nm AS (SELECT node_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY node_id), qs AS (SELECT term, idf AS qw FROM idf WHERE term IN ('small', 'brand')), qn AS (SELECT sqrt(sum(qw * qw)) AS qnorm FROM qs),
    cs AS (SELECT node_id, sum(w * qw) / (any_value(norm) * any_value(qnorm)) AS score FROM w JOIN qs USING (term) JOIN nm USING (node_id), qn GROUP BY node_id)"""


@query("r4_tfidf", f"WITH {_TFIDF} SELECT node_id, round(score, 9) AS score FROM cs WHERE score > 0.01")
def _(t):
    return text.tfidf(B.search_docs(t), "small brand", 10_000_000).select("node_id", F.round("score", 9).alias("score"))


@query(
    "r5_hybrid",
    f"""{_BM25}, {_TFIDF}, a AS (SELECT node_id, row_number() OVER (ORDER BY round(bm.score, 9), node_id) AS bm25_rank FROM bm ORDER BY bm25_rank LIMIT 60),
        b AS (SELECT node_id, row_number() OVER (ORDER BY round(cs.score, 9) DESC, node_id) AS semantic_rank FROM cs WHERE cs.score > 0.01 ORDER BY semantic_rank LIMIT 60)
        SELECT coalesce(a.node_id, b.node_id) AS node_id, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0), 9) AS score FROM a FULL JOIN b ON a.node_id = b.node_id
        ORDER BY coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) DESC, bm25_rank NULLS LAST, semantic_rank LIMIT 20""",
)
def _(t):
    return text.hybrid(B.search_docs(t), "small brand", 20).select("node_id", F.round("score", 9).alias("score"))


_VECTORS = """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 6) AS score
        FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) DESC, vec_id LIMIT 10"""


@query("r7_vector_search", _VECTORS)
def _(t):
    probe = t.embeddings.where("vec_id = 3").select("embedding").first()[0]  # one vector
    return text.cosine_top(t.embeddings, probe, 10).select("vec_id", F.round("score", 6).alias("score"))


@query("r7_indexed", _VECTORS)
def _(t):
    path = scratch(t.spark)
    vector_index.build(t.embeddings, path)
    probe = t.embeddings.where("vec_id = 3").select("embedding").first()[0]  # one vector
    return vector_index.search(t.spark, path, probe, 10).select("vec_id", F.round("score", 6).alias("score"))


# rules


@query(
    "x5_line_scan",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        c AS (SELECT doc_id, pos, line FROM l WHERE NOT regexp_matches(ltrim(line, ' ' || chr(9)), '^(//|\*|#)'))
        SELECT doc_id, pos AS line, 'hardcoded_secret' AS category, 'high' AS severity FROM c WHERE regexp_matches(line, '(?:password|passwd|pwd)\s*[:=]\s*["''][^"'']{8,}["'']') OR regexp_matches(line, '(?:api[_-]?key|apiKey)\s*[:=]\s*["''][A-Za-z0-9_\-]{16,}["'']')
            OR regexp_matches(line, '(?:secret|token|auth[_-]?token)\s*[:=]\s*["''][A-Za-z0-9_\-/.+=]{16,}["'']')""",
)
def _(t):
    files = t.documents.select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    return text.scan_lines(files).select(F.col("file_path").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), "category", "severity")


@query(
    "x2_sinks",
    r"""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'command_injection' WHEN 2 THEN 'xss' END AS category FROM part""",
)
def _(t):
    code = F.element_at(F.array(*[F.lit(x) for x in ("cursor.execute(q)", "os.system(c)", "el.innerHTML = h", "x = 1")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), rules.first_of(code, rules.SINKS, 1).alias("category"))


@query("x1_sources", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'ssrf' END AS category FROM part")
def _(t):
    code = F.element_at(F.array(*[F.lit(x) for x in ("req.body.id", "os.environ['A']", "y = 2")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), rules.first_of(code, rules.SOURCES, 1).alias("category"))


@query("x3_sanitizers", "SELECT p_partkey AS id, p_partkey % 2 = 0 AS safe FROM part")
def _(t):
    code = F.when(F.col("p_partkey") % 2 == 0, "z = parseInt(v)").otherwise("z = v")
    return t.part.select(F.col("p_partkey").alias("id"), rules.any_of(code, rules.SANITIZERS).alias("safe"))


@query("x6_entry_points", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'http_handler' WHEN 1 THEN 'event_listener' WHEN 2 THEN 'main_function' END AS type FROM part")
def _(t):
    name = F.element_at(F.array(*[F.lit(x) for x in ("userHandler", "onClick", "main", "compute")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), rules.entry_type(name, F.lit("")).alias("type"))


@query("x7_test_frameworks", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'pytest' WHEN 1 THEN 'jest' WHEN 2 THEN 'go_test' END AS framework FROM part")
def _(t):
    k = (F.col("p_partkey") % 4 + 1).cast("int")
    path = F.element_at(F.array(*[F.lit(x) for x in ("a/test_x.py", "a/x.test.ts", "a/x_test.go", "a/x.rs")]), k)
    name = F.element_at(F.array(*[F.lit(x) for x in ("test_it", "describe", "TestIt", "run")]), k)
    return t.part.select(F.col("p_partkey").alias("id"), rules.test_framework(path, name, F.lit(False)).alias("framework"))


@query("x8_reference_kinds", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'fixture' WHEN 1 THEN 'migration' WHEN 2 THEN 'write' WHEN 3 THEN 'query' ELSE 'read' END AS kind FROM part")
def _(t):
    name = F.element_at(F.array(*[F.lit(x) for x in ("userFixture", "migrateUser", "saveUser", "findUser", "user")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), rules.reference_kind(name).alias("kind"))


@query("x9_orm", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'prisma' WHEN 1 THEN 'typeorm' WHEN 2 THEN 'django' END AS orm FROM part")
def _(t):
    k = (F.col("p_partkey") % 4 + 1).cast("int")
    path = F.element_at(F.array(*[F.lit(x) for x in ("s.prisma", "u.ts", "m.py", "z.py")]), k)
    content = F.element_at(F.array(*[F.lit(x) for x in ("", "@Entity()", "class A(models.Model)", "pass")]), k)
    return t.part.select(F.col("p_partkey").alias("id"), rules.orm(path, content).alias("orm"))


# scores


_RISK = """c AS (SELECT dst, count(*) AS n FROM gp_edges WHERE kind = 'calls' GROUP BY dst), f AS (SELECT n.id, n.name, n.file_path,
            CASE WHEN cyclomatic > 50 THEN 10 WHEN cyclomatic > 30 THEN 8 WHEN cyclomatic > 15 THEN 6 WHEN cyclomatic > 8 THEN 4 ELSE 2 END AS complexity,
            CASE WHEN d.n >= 3 THEN 1 WHEN d.n >= 1 THEN 3 ELSE 10 END AS tests, CASE WHEN coalesce(c.n, 0) > 100 THEN 10 WHEN c.n > 50 THEN 8 WHEN c.n > 20 THEN 6 WHEN c.n > 5 THEN 4 WHEN c.n > 0 THEN 2 ELSE 0 END AS blast,
            CASE WHEN cyclomatic > 10 THEN 7 WHEN cyclomatic > 5 THEN 4 ELSE 2 END AS errors
        FROM gp_nodes n LEFT JOIN c ON c.dst = n.id LEFT JOIN (SELECT dst, count(*) AS n FROM gp_edges WHERE kind = 'calls' AND src % 10 = 3 GROUP BY dst) d ON d.dst = n.id),
        z AS (SELECT *, CAST(floor((complexity * 0.15::DOUBLE + tests * 0.25::DOUBLE + 0 * 0.2::DOUBLE + blast * 0.15::DOUBLE + 5 * 0.1::DOUBLE + errors * 0.15::DOUBLE) * 10 + 0.5) AS BIGINT) AS score FROM f),
        lv AS (SELECT *, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level,
            concat_ws('; ', CASE WHEN tests >= 7 THEN 'Add test coverage for this code' END, CASE WHEN complexity >= 7 THEN 'Consider refactoring to reduce complexity' END,
                CASE WHEN blast >= 7 THEN 'High blast radius — consider adding integration tests' END) AS advice FROM z)"""


@query("z1_risk", f"WITH {_RISK} SELECT id, score FROM z")
def _(t):
    return _scored(t).select("id", "score")


def _scored(t):
    """Parts with their risk, by direct callers, tests that call them, and size."""
    nodes, calls = B.part_nodes(t), B.part_edges(t).where("kind = 'calls'")
    callers = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    tests = calls.where("src % 10 = 3").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("tests"))
    n = F.coalesce("callers", F.lit(0))
    cc = F.col("cyclomatic")
    rows = nodes.join(callers, "id", "left").join(tests, "id", "left").select(
        "id", "file_path", "name", metrics.complexity_bucket(cc).alias("complexity"), metrics.test_bucket(F.coalesce("tests", F.lit(0)), F.lit(0), F.lit(True)).alias("testCoverage"),
        metrics.sensitivity(F.col("name"), F.lit(0), F.lit(0)).alias("dataSensitivity"),
        F.when(n > 100, 10).when(n > 50, 8).when(n > 20, 6).when(n > 5, 4).when(n > 0, 2).otherwise(0).alias("blastRadius"),
        metrics.velocity_bucket(F.lit(None).cast("int")).alias("changeVelocity"), metrics.error_bucket(cc).alias("errorHandling"),
    )
    return metrics.risk(rows)


@query(
    "t1_hotspots",
    f"""WITH {_RISK} SELECT id, name, score, level, CASE WHEN advice <> '' THEN advice WHEN level = 'low' THEN 'Low risk — no action needed' ELSE 'Review before merging' END AS recommendation
        FROM lv ORDER BY score DESC, id LIMIT 20""",
)
def hotspots(t):
    return _scored(t).orderBy(F.desc("score"), "id").limit(20).select("id", "name", "score", "level", "recommendation")


@query(
    "a14_file_risk",
    f"""WITH {_RISK}, g AS (SELECT file_path, round(avg(score), 6) AS mean, max(score) AS worst, count(*) AS n FROM z GROUP BY file_path)
        SELECT *, CASE WHEN worst >= 75 THEN 'critical' WHEN worst >= 50 THEN 'high' WHEN worst >= 25 THEN 'medium' ELSE 'low' END AS level FROM g ORDER BY worst DESC, file_path LIMIT 30""",
)
def _(t):
    return metrics.file_risk(_scored(t)).withColumn("mean", F.round("mean", 6))


# branches


_CONFLICTS = """it AS (SELECT DISTINCT * FROM br_items), f AS (SELECT DISTINCT branch, key FROM it WHERE item_kind = 'file'), s AS (SELECT DISTINCT branch, key FROM it WHERE item_kind IN ('symbol_added', 'symbol_modified')),
        g AS (SELECT branch, count(DISTINCT key) AS n FROM it WHERE item_kind = 'signature_changed' GROUP BY branch), act AS (SELECT DISTINCT branch FROM s), adds AS (SELECT DISTINCT branch FROM it WHERE item_kind = 'symbol_added'), d AS (SELECT branch, model, count(*) AS n FROM it WHERE item_kind = 'schema_field' GROUP BY ALL),
        cf AS (SELECT a.branch AS branch_a, b.branch AS branch_b, 1 AS level, 'low' AS severity, count(*) AS n FROM f a JOIN f b USING (key) WHERE a.branch < b.branch GROUP BY ALL
        UNION ALL SELECT a.branch, b.branch, 2, 'medium', count(*) FROM s a JOIN s b USING (key) WHERE a.branch < b.branch GROUP BY ALL
        UNION ALL SELECT least(g.branch, act.branch), greatest(g.branch, act.branch), 3, 'high', CAST(sum(n) AS BIGINT) FROM g JOIN act ON g.branch <> act.branch GROUP BY ALL
        UNION ALL SELECT a.branch, b.branch, 4, 'critical', a.n FROM (SELECT branch, count(DISTINCT key) AS n FROM it WHERE item_kind = 'summary_changed' GROUP BY branch) a JOIN adds b ON a.branch < b.branch
        UNION ALL SELECT a.branch, b.branch, 4, 'critical', count(*) FROM (SELECT DISTINCT branch, key FROM it WHERE item_kind = 'summary_changed') a JOIN (SELECT DISTINCT branch, key FROM it WHERE item_kind = 'symbol_modified') b USING (key)
            WHERE a.branch < b.branch AND b.branch NOT IN (SELECT branch FROM adds) GROUP BY ALL
        UNION ALL SELECT a.branch, b.branch, 5, 'critical', CAST(sum(a.n * b.n) AS BIGINT) FROM d a JOIN d b USING (model) WHERE a.branch < b.branch GROUP BY ALL)"""


@query("b1_b5_conflicts", f"WITH {_CONFLICTS} SELECT * FROM cf")
def _(t):
    return branches.detect(B.branch_items(t))


@query("b12_matrix", f"WITH {_CONFLICTS} SELECT branch_a, branch_b, max(level) AS worst, CAST(sum(n) AS BIGINT) AS n FROM cf GROUP BY ALL")
def _(t):
    return branches.matrix(branches.detect(B.branch_items(t)))


@query(
    "b12_worst_pairs",
    f"""WITH {_CONFLICTS}, top AS (SELECT branch_a, branch_b FROM cf WHERE level = 2 AND n >= 3 ORDER BY n DESC, branch_a, branch_b LIMIT 200)
        SELECT branch_a, branch_b, {", ".join(f"CAST(coalesce(sum(n) FILTER (level = {i}), 0) AS BIGINT) AS {c}" for i, c in enumerate(("files", "symbols", "signatures", "summaries", "fields"), 1))}
        FROM cf JOIN top USING (branch_a, branch_b) GROUP BY ALL""",
)
def _(t):
    return branches.worst(B.branch_items(t), 200, 3)


_SOURCE = "'f(' || o_orderstatus || ')' || repeat(chr(10) || 'x', CAST(o_custkey % 4 AS INTEGER))"


@query(
    "b7_fingerprint",
    f"""WITH a AS (SELECT o_orderkey AS name, o_orderstatus AS sig, o_custkey % 4 AS extra, {_SOURCE} AS source FROM orders WHERE o_orderkey % 3 <> 0),
        b AS (SELECT o_orderkey AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS sig, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey % 4 END AS extra FROM orders WHERE o_orderkey % 4 <> 0)
        SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.sig IS NULL THEN 'added' WHEN b.sig IS NULL THEN 'removed' ELSE 'modified' END AS change,
            CAST(greatest(0, coalesce(b.extra + 1, 0) - coalesce(a.extra + 1, 0)) AS INTEGER) AS lines_added, CAST(greatest(0, coalesce(a.extra + 1, 0) - coalesce(b.extra + 1, 0)) AS INTEGER) AS lines_removed,
            coalesce(a.sig <> b.sig, false) AS signature_changed FROM a FULL JOIN b ON a.name = b.name WHERE a.sig IS NULL OR b.sig IS NULL OR a.sig <> b.sig OR a.extra <> b.extra""",
)
def _(t):
    def side(where, sig, extra):
        source = F.concat(F.lit("f("), sig, F.lit(")"), F.expr(f"repeat('\\nx', cast({extra} AS int))"))
        return t.orders.where(where).select(F.col("o_orderkey").alias("name"), source.alias("source"))

    base = side("o_orderkey % 3 <> 0", F.col("o_orderstatus"), "o_custkey % 4")
    changed = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    return branches.fingerprint(base, side("o_orderkey % 4 <> 0", changed, "CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey % 4 END"))


# client-side views


@query(
    "c1_graph_filter",
    """WITH n AS (SELECT id FROM gp_nodes WHERE kind IN ('function', 'method') AND NOT is_test AND cyclomatic >= 10 AND (contains(lower(name), 'ring') OR contains(lower(file_path), 'ring') OR contains(lower(qualified_name), 'ring')))
        SELECT src, dst, kind FROM gp_edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""",
)
def _(t):
    nodes = B.part_nodes(t).withColumn("risk", F.col("cyclomatic"))
    return views.graph_filter(nodes, B.part_edges(t), kinds=("function", "method"), tests=False, least_risk=10, text="Ring")[1].select("src", "dst", "kind")


@query("c3_threat_map", "SELECT file_path, min(rank) AS worst, count(*) AS n, count(DISTINCT category) AS categories FROM gs_findings GROUP BY file_path")
def _(t):
    return views.threat_map(B.findings(t), "file_path", "category").select("file_path", "worst", "n", F.size("categories").cast("long").alias("categories"))


@query("c10_models_by_directory", "SELECT p_brand AS directory, count(*) AS models FROM part GROUP BY 1")
def _(t):
    models = t.part.select(F.col("p_name").alias("name"), F.format_string("%s/m%d.ts", "p_brand", "p_partkey").alias("file_path"))
    return views.by_directory(models).select("directory", "models")


# streaming twins


@query(
    "q1_runtime_edges",
    """SELECT session_id, source_key, target_key, count(*) AS hit_count, arg_min(ts_ms, seq) AS first_seen_ms, arg_max(ts_ms, seq) AS last_seen_ms FROM rt_events GROUP BY ALL""",
)
def _(t):
    from .streaming import runtime

    return runtime.fold(B.runtime_events(t)).select("session_id", "source_key", "target_key", "hit_count", "first_seen_ms", "last_seen_ms")


@query("q2_lookback", "SELECT DISTINCT session_id, source_key, target_key FROM rt_events GROUP BY session_id, source_key, target_key HAVING arg_max(ts_ms, seq) >= 1706000000000")
def _(t):
    from .streaming import runtime

    return runtime.seen_since(runtime.fold(B.runtime_events(t)), 1706000000000).select("session_id", "source_key", "target_key")


@query(
    "q4_rate_limit",
    """WITH RECURSIVE e AS (SELECT session_id AS key, seq, ts_ms FROM rt_events), r(key, start) AS (SELECT key, min(ts_ms) FROM e GROUP BY key
            UNION ALL SELECT n.key, n.start FROM (SELECT r.key, (SELECT min(e.ts_ms) FROM e WHERE e.key = r.key AND e.ts_ms >= r.start + 86400000) AS start FROM r) n WHERE n.start IS NOT NULL),
        w AS (SELECT e.key, e.seq, e.ts_ms, max(r.start) AS start FROM e JOIN r ON r.key = e.key AND r.start <= e.ts_ms GROUP BY ALL)
        SELECT key, seq, row_number() OVER (PARTITION BY key, start ORDER BY ts_ms, seq) <= 2 AS allowed FROM w""",
)
def _(t):
    from .streaming import runtime

    return runtime.rate_limit(B.runtime_events(t).select(F.col("session_id").alias("key"), "seq", "ts_ms"), limit=2, window_ms=86_400_000)


@query("q1_streamed", "SELECT session_id, source_key, target_key, count(*) AS hit_count FROM rt_events GROUP BY ALL")
def _(t):
    from .streaming import runtime

    return runtime.stream_once(B.runtime_events(t)).select("session_id", "source_key", "target_key", "hit_count")
