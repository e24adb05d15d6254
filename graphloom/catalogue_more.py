"""Further operators on the driver's tables: modules, schema, control flow, files, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _BM25, _RISK, _TFIDF, _scored
from .engine import Engine
from .operators import control, lookups, metrics, modules, schema, text, views
from .plans import bindings as B
from .registry import query
from .sources import files, git, python_ast
from .streaming import runtime


def _pick(key, *values):
    """The value at key modulo the number of values; None stays null."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


# joins and modules


@query("j2_tests_of_node", "SELECT e.dst AS id, n.id AS test, n.name FROM gp_edges e JOIN gp_nodes n ON n.id = e.src WHERE e.kind = 'calls' AND n.is_test")
def _(t):
    tests = B.part_nodes(t).where("is_test").select(F.col("id").alias("test"), "name")
    return B.part_edges(t).where("kind = 'calls'").join(tests, F.col("src") == F.col("test")).select(F.col("dst").alias("id"), "test", "name")


@query(
    "j8_import_map",
    """WITH s AS (SELECT p_partkey AS ord, 'd/f' || (p_partkey % 30) || '.ts' AS file_path, 'S' || (p_partkey % 7) AS name, 'q' || p_partkey AS qn, p_partkey % 3 <> 0 AS exported FROM part),
        i AS (SELECT p_partkey AS k, 'd/f' || (p_partkey % 30) || '.ts' AS from_file, 'd/f' || (p_partkey * 7 % 40) || '.ts' AS resolved, CASE p_partkey % 4 WHEN 0 THEN 'default' WHEN 1 THEN '*' ELSE 'S' || (p_partkey % 7) END AS name, 'L' || p_partkey AS alias FROM part)
        SELECT * FROM (SELECT from_file, alias AS local, CASE WHEN name = 'default' THEN (SELECT arg_min(qn, ord) FROM s WHERE s.file_path = i.resolved AND exported) WHEN name = '*' THEN '__namespace__:' || resolved
            ELSE (SELECT arg_min(qn, ord) FROM s WHERE s.file_path = i.resolved AND s.name = i.name AND exported) END AS qualified_name FROM i) WHERE qualified_name IS NOT NULL""",
)
def _(t):
    k = F.col("p_partkey")
    path = lambda x: F.concat(F.lit("d/f"), x, F.lit(".ts"))
    symbols = t.part.select(k.alias("ord"), path(k % 30).alias("file_path"), F.concat(F.lit("S"), k % 7).alias("name"), F.concat(F.lit("q"), k).alias("qualified_name"), (k % 3 != 0).alias("exported"))
    name = F.when(k % 4 == 0, "default").when(k % 4 == 1, "*").otherwise(F.concat(F.lit("S"), k % 7))
    imports = t.part.select(path(k % 30).alias("from_file"), path(k * 7 % 40).alias("resolved"), name.alias("name"), F.concat(F.lit("L"), k).alias("alias"))
    return modules.import_map(imports, symbols)


@query(
    "j9_module_paths",
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'src/a/x.ts' WHEN 1 THEN 'src/lib/index.js' WHEN 2 THEN 'src/none' ELSE 'react' END AS resolved FROM part""",
)
def _(t):
    k = F.col("p_partkey")
    imports = t.part.select(k.alias("k"), F.lit("src/a/b.ts").alias("from_file"), _pick(k, "./x", "../lib", "./.././none", "react").alias("source"))
    known = t.part.select(_pick(k, "src/a/x.ts", "src/a/x.py", "src/lib/index.js", "src/a/b.ts").alias("file_path"))
    return modules.resolve_paths(imports, known).select("k", "resolved")


@query(
    "j11_symbol_resolution",
    """WITH s AS (SELECT p_partkey AS ord, p_brand AS file_path, 'C' || (p_partkey % 40) AS name, p_partkey AS qn, p_partkey % 3 <> 0 AS exported FROM part), i AS (SELECT DISTINCT p_brand AS file_path, 'C' || (p_partkey * 3 % 97) AS local, min(p_partkey) OVER (PARTITION BY p_brand, p_partkey * 3 % 97) AS qn FROM part WHERE p_partkey % 4 = 1),
        same AS (SELECT file_path, name, arg_min(qn, ord) AS qn FROM s GROUP BY ALL), every AS (SELECT name, count(*) FILTER (exported) AS n, max(qn) FILTER (exported) AS only_, arg_min(qn, ord) AS first FROM s GROUP BY name)
        SELECT p.p_partkey AS k, coalesce(i.qn, same.qn, CASE WHEN n = 1 THEN only_ END, first) AS resolved FROM (SELECT p_partkey, p_brand, 'C' || (p_partkey * 7 % 120) AS name FROM part) p
        LEFT JOIN i ON i.file_path = p_brand AND i.local = p.name LEFT JOIN same ON same.file_path = p_brand AND same.name = p.name LEFT JOIN every ON every.name = p.name""",
)
def _(t):
    k = F.col("p_partkey")
    symbols = t.part.select(k.alias("ord"), F.col("p_brand").alias("file_path"), F.concat(F.lit("C"), k % 40).alias("name"), k.alias("qualified_name"), (k % 3 != 0).alias("exported"))
    imported = t.part.where(k % 4 == 1).groupBy(F.col("p_brand").alias("from_file"), F.concat(F.lit("C"), k * 3 % 97).alias("local")).agg(F.min(k).alias("qualified_name"))
    refs = t.part.select(k.alias("k"), F.col("p_brand").alias("file_path"), F.concat(F.lit("C"), k * 7 % 120).alias("name"))
    found = modules.resolve_symbols(refs.select("file_path", "name").distinct(), imported, symbols)
    return refs.join(found, ["file_path", "name"], "left").select("k", F.col("qualified_name").alias("resolved"))


@query(
    "j13_schema_references",
    r"""WITH f AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS field FROM part)
        SELECT DISTINCT field, p_partkey AS node FROM f JOIN part ON regexp_matches(lower(p_type || ' ' || p_name), '\b' || field || '\b')""",
)
def _(t):
    fields = t.part.select(F.lower(F.substring_index("p_name", " ", 1)).alias("field")).distinct().select("field", F.col("field").alias("name"))
    code = t.part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_name").alias("signature"))
    return schema.link_fields(fields, code).select("field", "node").distinct()


@query(
    "j14_model_relationships",
    """SELECT 'n::M' || n_nationkey AS "from", 'n::M' || ((n_nationkey + 1) % 25) AS "to", 'f' AS field, 'has_many' AS type FROM nation
        UNION ALL SELECT 'n::M' || n_nationkey, 'n::M' || ((n_nationkey + 2) % 25), 'm' || ((n_nationkey + 2) % 25) || 'Id', 'foreign_key' FROM nation""",
)
def _(t):
    n = F.col("n_nationkey")
    m = lambda x, p="n::M": F.concat(F.lit(p), x)
    models = t.nation.select(m(n).alias("name"))
    typed = t.nation.select(m(n).alias("model_name"), F.lit("f").alias("name"), F.concat(m((n + 1) % 25, "M"), F.lit("[]")).alias("field_type"))
    named = t.nation.select(m(n).alias("model_name"), F.concat(m((n + 2) % 25, "m"), F.lit("Id")).alias("name"), F.lit("string").alias("field_type"))
    return schema.relationships(models, typed.union(named))


@query(
    "p10_runtime_suggest",
    """WITH r AS (SELECT source_key AS symbol, 0 AS tier, max(seq) AS place FROM rt_events WHERE contains(lower(source_key), 'i') GROUP BY source_key),
        s AS (SELECT name AS symbol, 1 AS tier, min(ord) AS place FROM gp_nodes WHERE contains(lower(name), 'i') OR contains(lower(qualified_name), 'i') GROUP BY name)
        SELECT symbol, tier FROM (SELECT symbol, tier, place FROM r UNION ALL SELECT symbol, tier, place FROM s WHERE symbol NOT IN (SELECT symbol FROM r)) ORDER BY tier, CASE tier WHEN 0 THEN -place ELSE place END LIMIT 30""",
)
def _(t):
    return lookups.runtime_suggest(runtime.fold(B.runtime_events(t)), B.part_nodes(t), "i", 30).select("symbol", "tier")


@query("p13_confident_calls", "SELECT src, dst, confidence FROM gp_calls WHERE confidence >= 0.8")
def _(t):
    return lookups.confident(B.part_calls(t), 0.8).select("src", "dst", "confidence")


# rules and schema


@query("x10_services", "SELECT p_partkey AS k, p_partkey % 3 = 0 AS service FROM part")
def _(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("k"), schema.is_service(_pick(k, "UserService", "User", "Servant")).alias("service"))


@query(
    "x11_models",
    """SELECT r_regionkey AS model, count(*) AS fields FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey HAVING count(*) >= 2""",
)
def _(t):
    blank = F.lit(None).cast("string")
    owners = t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit("class").alias("kind"), F.col("r_name").alias("name"), F.lit("m.ts").alias("file_path"), blank.alias("signature"))
    held = t.nation.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.lit("property").alias("kind"), F.col("n_name").alias("name"), F.lit("m.ts").alias("file_path"), F.lit("x: string").alias("signature"))
    edges = t.nation.select(F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 1000).cast("long").alias("dst"), F.lit("contains").alias("kind"))
    return schema.extract_models(owners.union(held), edges)[0].select(F.col("model").cast("int").alias("model"), "fields")


@query("x13_throw_types", "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'ValueError' ELSE 'Error' END AS type FROM part")
def _(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("k"), control.throw_type(_pick(k, "throw new TypeError(x)", "raise ValueError(y)", "throw e")).alias("type"))


@query("x14_literal_types", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'array' END AS type FROM part")
def _(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("k"), control.literal_type(_pick(k, "template_string", "float", "list", "call")).alias("type"))


@query("x15_fixes", "SELECT p_partkey AS k, CASE p_partkey % 2 WHEN 0 THEN 'Validate and allowlist target URLs; avoid user-controlled URL construction' ELSE 'Review and validate untrusted input before use' END AS fix FROM part")
def _(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("k"), control.suggest_fix(_pick(k, "ssrf", "other")).alias("fix"))


@query(
    "x16_migration_steps",
    """WITH c AS (SELECT s_suppkey AS m, CASE s_suppkey % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'rename' ELSE 'analyze' END AS a, s_nationkey % 2 AS w FROM supplier), s AS (
            SELECT m, a, 0 AS step, CASE a WHEN 'drop' THEN 'drop_column' WHEN 'rename' THEN 'rename_column' ELSE 'review_references' END AS type, a = 'drop' AS breaking FROM c
            UNION ALL SELECT m, a, 1, 'update_code', a = 'drop' AND w = 1 FROM c WHERE a <> 'analyze' UNION ALL SELECT m, a, 1, 'review_writes', false FROM c WHERE a = 'analyze' AND w = 1) SELECT m AS model, step, type, breaking FROM s""",
)
def _(t):
    k = F.col("s_suppkey")
    changes = t.supplier.select(k.alias("model"), F.lit("f").alias("field"), _pick(k, "drop", "rename", "analyze").alias("action"), F.lit(2).alias("refs"), (F.col("s_nationkey") % 2).alias("writes"), F.lit(0).alias("relations"))
    return schema.migration_steps(changes).select("model", "step", "type", "breaking")


@query(
    "a16_resolution_stats",
    """WITH r AS (SELECT CASE WHEN confidence >= 0.95 THEN 'same_file' WHEN confidence >= 0.9 THEN 'import_scoped' WHEN confidence >= 0.5 THEN 'global' END AS tier, confidence FROM gp_calls)
        SELECT coalesce(tier, 'unresolved') AS tier, count(*) AS n, round(avg(CASE WHEN tier IS NOT NULL THEN confidence END), 6) AS mean FROM r GROUP BY 1""",
)
def _(t):
    c = F.col("confidence")
    calls = B.part_calls(t).withColumn("tier", F.when(c >= 0.95, "same_file").when(c >= 0.9, "import_scoped").when(c >= 0.5, "global"))
    return metrics.resolution_stats(calls).select("tier", "n", F.round("mean", 6).alias("mean"))


@query(
    "a20_document_frequency",
    r"""SELECT term, count(DISTINCT node_id) AS df FROM (SELECT node_id, unnest(regexp_split_to_array(regexp_replace(lower(name || ' ' || coalesce(qualified_name, 'null')), '[^a-z0-9_]', ' ', 'g'), '[\s_]+')) AS term FROM docs_search) WHERE length(term) > 1 GROUP BY term""",
)
def _(t):
    return text.document_frequency(B.search_docs(t))


# control flow


@query("g15_branch_points", "SELECT src AS block, count(*) AS ways FROM gp_edges GROUP BY src HAVING count(*) > 1")
def _(t):
    return control.branch_points(B.part_edges(t).withColumn("fn", F.lit(0))).select("block", "ways")


@query("g15_simple_paths", "SELECT fn, count(*) AS length FROM gc_nodes GROUP BY fn")
def _(t):
    nodes, edges = B.order_nodes(t), B.order_edges(t)
    ends = nodes.groupBy("fn").agg(F.min_by("id", "ord").alias("entry"), F.max_by("id", "ord").alias("exit"))
    return control.simple_paths(edges, ends).select("fn", F.size("path").cast("long").alias("length"))


@query("a6_block_depths", "SELECT n.fn, n.id AS block, (SELECT count(*) FROM gc_nodes m WHERE m.fn = n.fn AND m.ord < n.ord AND m.status = 'F') AS depth FROM gc_nodes n")
def _(t):
    nodes, edges = B.order_nodes(t), B.order_edges(t)
    entries = nodes.where("ord = 1").select("fn", F.col("id").alias("block"))
    nesting = nodes.where("status = 'F'").select("fn", F.col("id").alias("block"))
    return control.block_depths(edges, entries, nesting).select("fn", "block", F.col("depth").cast("long").alias("depth"))


@query(
    "g23_param_flows",
    """SELECT a.fn, a.id AS param, b.id, count(*) FILTER (m.status = 'F') > 0 AS sanitized FROM gc_nodes a JOIN gc_nodes b ON a.fn = b.fn AND b.ord > a.ord JOIN gc_nodes m ON m.fn = a.fn AND m.ord > a.ord AND m.ord <= b.ord
        WHERE a.ord = 1 GROUP BY a.fn, a.id, b.id""",
)
def _(t):
    nodes = B.order_nodes(t)
    marked = nodes.select(F.col("id").alias("dst"), F.when(F.col("status") == "F", "escapeHtml(v)").otherwise("trim(v)").alias("transform"))
    return control.param_flows(B.order_edges(t).join(marked, "dst"), nodes.where("ord = 1")).select("fn", "param", "id", "sanitized")


@query("g25_effects", "SELECT p_partkey AS fn, CASE p_partkey % 4 WHEN 0 THEN 'db_write' WHEN 1 THEN 'log' WHEN 2 THEN 'env_read' END AS kind FROM part WHERE p_partkey % 4 <> 3")
def _(t):
    k = F.col("p_partkey")
    return control.effects(t.part.select(k.alias("fn"), _pick(k, "user.save()", "console.warn(x)", "process.env.A", "y = 1").alias("code"))).select("fn", "kind")


@query("g11_community_labels", "SELECT p_brand AS community, 'Src' AS label FROM part GROUP BY p_brand")
def _(t):
    nodes = B.part_nodes(t)
    members = nodes.select(F.col("file_path").alias("community"), "id", "ord", "kind", "name", F.concat(F.lit("src/"), "file_path").alias("file_path"))
    return control.community_labels(members)


@query(
    "g11_labels_by_rule",
    """WITH m AS (SELECT p_size AS c, chr(CAST(65 + p_partkey % 26 AS INTEGER)) AS l, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r FROM part), g AS (SELECT c, count(*) AS n, min(l) AS lo, max(l) AS hi, min(l) FILTER (r = 1) AS first FROM m GROUP BY c)
        SELECT c AS community, CASE c % 5 WHEN 0 THEN 'Lib' || c WHEN 1 THEN CASE WHEN n = 1 THEN 'Shape' || lo WHEN lo = hi THEN 'Shape' || lo || '*' ELSE 'Shape*' END WHEN 2 THEN 'K' || first
            WHEN 3 THEN CASE WHEN n = 1 THEN 'Function Group (1)' WHEN lo = hi THEN 'Load_' || lo || '*' ELSE 'Load_*' END ELSE 'Function Group (' || n || ')' END AS label FROM g""",
)
def _(t):
    c, letter = F.col("p_size"), F.expr("chr(65 + p_partkey % 26)")
    rows = t.part.withColumn("r", F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")))
    kind = F.when((c % 5 == 1) | ((c % 5 == 2) & (F.col("r") == 1)), "class").otherwise("function")
    name = F.when(c % 5 == 1, F.concat(F.lit("Shape"), letter)).when((c % 5 == 2) & (F.col("r") == 1), F.concat(F.lit("K"), letter)).when(c % 5 == 3, F.concat(F.lit("load_"), letter)).otherwise(F.concat(letter, F.lit("x")))
    path = F.when(c % 5 == 0, F.concat(F.lit("src/lib"), c, F.lit("/a.py"))).otherwise("a.py")
    members = rows.select(c.alias("community"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), kind.alias("kind"), name.alias("name"), path.alias("file_path"))
    return control.community_labels(members)


@query(
    "b8_summary_differences",
    """WITH a AS (SELECT DISTINCT l_suppkey AS s, l_returnflag || l_linenumber AS e FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT DISTINCT l_suppkey AS s, l_returnflag || l_linenumber AS e FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3)
        SELECT coalesce(a.s, b.s) AS name, count(*) FILTER (a.e IS NULL) AS added, count(*) FILTER (b.e IS NULL) AS removed FROM a FULL JOIN b ON a.s = b.s AND a.e = b.e
        WHERE coalesce(a.s, b.s) IN (SELECT s FROM a) AND coalesce(a.s, b.s) IN (SELECT s FROM b) GROUP BY 1 HAVING count(*) FILTER (a.e IS NULL OR b.e IS NULL) > 0""",
)
def _(t):
    def side(where):
        return t.lineitem.where(where).groupBy(F.col("l_suppkey").alias("name")).agg(F.collect_set(F.concat("l_returnflag", "l_linenumber")).alias("effects")).withColumn("can_return_null", F.lit(False))

    rows = control.compare_summaries(side("l_linenumber <= 2"), side("l_linenumber BETWEEN 2 AND 3"))
    return rows.select("name", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"))


# sessions


@query(
    "g7_runtime_trace",
    """WITH RECURSIVE e AS (SELECT DISTINCT source_key, target_key FROM rt_events WHERE session_id = 3), r(id, depth) AS (SELECT 'sym:view', 0 UNION SELECT e.target_key, r.depth + 1 FROM r JOIN e ON e.source_key = r.id WHERE r.depth < 6) SELECT id, min(depth) AS depth FROM r GROUP BY id""",
)
def _(t):
    return runtime.trace(runtime.fold(B.runtime_events(t)), 3, " VIEW ")[0].select("id", F.col("depth").cast("int").alias("depth"))


@query(
    "g7_runtime_edges",
    """WITH RECURSIVE w AS (SELECT source_key AS src, target_key AS dst, count(*) AS weight FROM rt_events WHERE session_id = 3 GROUP BY ALL), r(id, depth) AS (SELECT 'sym:view', 0 UNION SELECT w.dst, r.depth + 1 FROM r JOIN w ON w.src = r.id WHERE r.depth < 5)
        SELECT src, dst, weight, 'observed' AS source FROM w WHERE src IN (SELECT id FROM r)""",
)
def _(t):
    return runtime.trace(runtime.fold(B.runtime_events(t)), 3, "view")[1].select("src", "dst", "weight", "source")


@query("q3_sessions", "SELECT session_id, count(*) AS edges, CAST(sum(n) AS BIGINT) AS hits, max(l) AS last_seen_ms FROM (SELECT session_id, source_key, target_key, count(*) AS n, arg_max(ts_ms, seq) AS l FROM rt_events GROUP BY ALL) GROUP BY session_id ORDER BY last_seen_ms DESC, session_id LIMIT 20")
def _(t):
    return runtime.sessions(runtime.fold(B.runtime_events(t)))


@query("q5_progress", "SELECT c_custkey // 10 AS job, round(sum(least(100.0, greatest(0.0, c_acctbal / 50))) / 12, 6) AS overall FROM customer GROUP BY 1")
def _(t):
    phases = t.customer.select(F.expr("c_custkey div 10").alias("job"), (F.col("c_acctbal") / 50).alias("percent"))
    return runtime.progress(phases).withColumn("overall", F.round("overall", 6))


# files


@query(
    "s4_chunks",
    """WITH RECURSIVE f AS (SELECT doc_id AS ord, strlen(text)::BIGINT AS length, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE strlen(text) <= 15000),
        r(i, ord, length, used, chunk) AS (SELECT i, ord, length, length, 0::BIGINT FROM f WHERE i = 1 UNION ALL SELECT f.i, f.ord, f.length, CASE WHEN r.used + f.length > 20000 AND r.used > 0 THEN f.length ELSE r.used + f.length END,
            CASE WHEN r.used + f.length > 20000 AND r.used > 0 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN f ON f.i = r.i + 1) SELECT ord, length, chunk FROM r""",
)
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("ord"), F.octet_length("text").cast("long").alias("length"))
    return files.chunks(rows, 20_000, 15_000)


@query("s2_scannable", "SELECT p_partkey AS k, p_partkey % 5 IN (0, 3) AS scanned FROM part")
def _(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("k"), files.scannable(_pick(k, "src/a.ts", "node_modules/a.ts", "src/a.md", "cfg/.env", "src/.hidden.js")).alias("scanned"))


@query(
    "s14_branch_scan",
    """SELECT 'b' || o_custkey AS branch, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, count(*) AS commits FROM orders WHERE o_custkey % 50 <> 1 GROUP BY o_custkey HAVING max(CAST(o_orderdate AS DATE)) >= DATE '2001-08-01' - 400""",
)
def _(t):
    name = F.when(F.col("o_custkey") % 50 == 1, F.concat(F.lit("release/"), "o_custkey")).otherwise(F.concat(F.lit("b"), "o_custkey"))
    commits = t.orders.select(name.alias("branch"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("hash"), F.lit("f").alias("file"))
    return files.branch_scan(commits, "2001-08-01", 400).select("branch", F.col("last_day").cast("string").alias("last_day"), "commits")


@query("s16_external_findings", "SELECT 'p' || p_partkey AS file_path, CAST(p_size AS INTEGER) AS line, CASE p_partkey % 2 WHEN 0 THEN 'critical' ELSE 'high' END AS severity, CASE p_partkey % 3 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'xss' ELSE 'security' END AS category FROM part")
def _(t):
    k = F.col("p_partkey")
    one = F.format_string('{"check_id": "%s", "path": "p%d", "start": {"line": %d}, "extra": {"severity": "%s", "message": "m"}}', _pick(k, "sql-injection", "a.xss", "other"), k, "p_size", _pick(k, "ERROR", "WARNING"))
    # a report for each file
    return files.external_findings(t.part.select(F.concat(F.lit('{"results": ['), one, F.lit("]}")).alias("text")))


@query("g28_file_tree", "SELECT p_brand || '/' || p_type AS path, 2 AS depth FROM part GROUP BY ALL UNION SELECT p_brand, 1 FROM part")
def _(t):
    return files.file_tree(t.part.select(F.concat_ws("/", "p_brand", "p_type").alias("file_path"))).select("path", "depth")


_FOUND = r"""SELECT doc_id, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
    WHERE NOT regexp_matches(ltrim(line, ' ' || chr(9)), '^(//|\*|#)') AND (regexp_matches(line, '(?:password|passwd|pwd)\s*[:=]\s*["''][^"'']{8,}["'']') OR regexp_matches(line, '(?:api[_-]?key|apiKey)\s*[:=]\s*["''][A-Za-z0-9_\-]{16,}["'']')
        OR regexp_matches(line, '(?:secret|token|auth[_-]?token)\s*[:=]\s*["''][A-Za-z0-9_\-/.+=]{16,}["'']'))"""


@query("k8_sarif", f"""SELECT '{{"ruleId":"hardcoded_secret","level":"error","locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || doc_id || '"}},"region":{{"startLine":' || pos || '}}}}}}]}}' AS result FROM ({_FOUND})""")
def _(t):
    rows = text.scan_lines(t.documents.select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content")))
    return files.sarif(rows)


@query("s10_git_log", "SELECT o_orderkey AS k, 'fix ' || o_orderkey AS message, 'src/a.py' AS file, CAST(o_custkey AS BIGINT) AS insertions, CAST(0 AS BIGINT) AS deletions FROM orders")
def _(t):
    k = F.col("o_orderkey")
    body = F.format_string("%040x|%x|Ann|a@x|2024-01-01T00:00:00Z|fix %d\n\n%d\t-\tsrc/a.py", k, k, k, "o_custkey")
    rows = git.parse_log(git.lines(t.orders.select(k.alias("source"), body.alias("text"))))
    return rows.select(F.conv("hash", 16, 10).cast("long").alias("k"), "message", "file", "insertions", "deletions")


@query(
    "s12_diff",
    "SELECT o_orderkey AS source, 'add' AS type, CAST(NULL AS INTEGER) AS old_line, CAST(5 AS INTEGER) AS new_line FROM orders UNION ALL SELECT o_orderkey, 'delete', 4, NULL FROM orders UNION ALL SELECT o_orderkey, 'context', 3, 4 FROM orders",
)
def _(t):
    body = F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,2 +4,2 @@\n same\n-old\n+new")
    rows = git.parse_diff(git.lines(t.orders.select(F.col("o_orderkey").alias("source"), body.alias("text"))))
    return rows.select("source", "type", "old_line", "new_line")


_PY = "import os\\nfrom a.b import c as d\\n\\nclass K(Base):\\n    def m(self, x):\\n        if x:\\n            y = os.getenv(x)\\n            return y\\n        return d(x)\\n"


@query("s5_python_symbols", "SELECT 'p' || s_suppkey || '.py' AS file_path, 'K' AS qualified_name, 'class' AS kind FROM supplier UNION ALL SELECT 'p' || s_suppkey || '.py', 'K.m', 'method' FROM supplier")
def _(t):
    source = t.supplier.select(F.format_string("p%d.py", "s_suppkey").alias("file_path"), F.lit(_PY.replace("\\n", "\n")).alias("content"))
    return python_ast.symbols(python_ast.facts(source)).select("file_path", "qualified_name", "kind")


@query("g16_python_cfg", "SELECT 'p' || s_suppkey || '.py:K.m' AS fn, CAST(2 AS BIGINT) AS cyclomatic FROM supplier")
def _(t):
    source = t.supplier.select(F.format_string("p%d.py", "s_suppkey").alias("file_path"), F.lit(_PY.replace("\\n", "\n")).alias("content"))
    return metrics.cyclomatic(*python_ast.blocks(python_ast.facts(source)))


# views


@query("r2_bm25_in_file", "SELECT p_partkey AS node_id FROM part WHERE p_brand IN ('Brand#12', 'Brand#21', 'Brand#3') AND contains(lower(' ' || p_name || ' ' || p_type || ' ' || p_brand || ' '), ' small ') ORDER BY 1 LIMIT 100000")
def _(t):
    return text.bm25(B.search_docs(t), "small", 10_000_000, F.col("file_path").isin("Brand#12", "Brand#21", "Brand#3")).select("node_id")


@query("c2_findings_by_category", "SELECT category, min(rank) AS worst, count(*) AS n FROM gs_findings WHERE rank <= 2 AND (contains(lower(file_path), '1') OR contains(lower(category), '1')) GROUP BY category")
def _(t):
    return views.findings_by_category(B.findings(t), severities=("critical", "high", "medium"), text="1").select("category", "worst", "n")


@query("c4_repo_totals", "SELECT r_name AS repo, count(DISTINCT n_nationkey) AS files, count(c_custkey) AS functions FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey WHERE contains(lower(r_name), 'a') GROUP BY r_name")
def _(t):
    nodes = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return views.repo_totals(nodes.select(F.col("r_name").alias("repo"), F.col("n_nationkey").alias("file_path"), F.when(F.col("c_custkey").isNotNull(), "function").alias("kind")), "A")


@query("c5_references_by_file", "SELECT l_suppkey AS file_path, count(*) AS n, count(*) FILTER (l_returnflag IN ('A', 'R')) AS reads, count(*) FILTER (l_returnflag = 'N') AS writes FROM lineitem GROUP BY l_suppkey")
def _(t):
    return views.references_by_file(B.references(t, "file_path"))


@query(
    "c6_siblings",
    """SELECT a.id, a.kind, count(b.id) AS before FROM gp_nodes a LEFT JOIN gp_nodes b ON a.file_path = b.file_path AND (b.start_line, b.ord) < (a.start_line, a.ord) GROUP BY a.id, a.kind""",
)
def _(t):
    return views.siblings(B.part_nodes(t)).select("id", "kind", (F.col("place") - 1).cast("long").alias("before"))


@query(
    "a13_overall_risk",
    f"""WITH {_RISK}, ff AS (SELECT unnest(['complexity', 'testCoverage', 'dataSensitivity', 'blastRadius', 'changeVelocity', 'errorHandling']) AS name, unnest([complexity, tests, 0, blast, 5, errors]) AS score FROM z),
        m AS (SELECT name, floor(avg(score) * 10 + 0.5) / 10 AS value FROM ff GROUP BY name)
        SELECT 'factor' AS part, name, value::DOUBLE AS value FROM m UNION ALL SELECT 'level', v.name, count(l.level)::DOUBLE FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) v(name) LEFT JOIN lv l ON l.level = v.name GROUP BY v.name
        UNION ALL SELECT 'mean', 'score', floor(avg(score) * 10 + 0.5) / 10 FROM z""",
)
def _(t):
    return metrics.overall_risk(_scored(t)).where("part <> 'top'")


@query(
    "b10_branch_groups",
    """WITH b AS (SELECT 'feat/' || (o_custkey % 40) AS name, o_orderdate AS last, o_custkey % 2 = 1 AS remote, o_orderkey = 7 AS current FROM orders)
        SELECT name, CAST(max(last) AS VARCHAR) AS last_day, bool_or(NOT remote) AS local, bool_or(remote) AS remote, bool_or(current) AS current FROM b WHERE contains(lower(name), '1') GROUP BY name""",
)
def _(t):
    remote = F.col("o_custkey") % 2 == 1
    listed = t.orders.select(F.concat(F.when(remote, "origin/").otherwise(""), F.lit("feat/"), F.col("o_custkey") % 40).alias("name"), F.col("o_orderdate").alias("day"), remote.alias("remote"), (F.col("o_orderkey") == 7).alias("current"))
    return views.branch_groups(listed, "1").select("name", F.date_format("last_day", "yyyy-MM-dd HH:mm:ss").alias("last_day"), "local", "remote", "current")


@query("b11_diff_totals", "SELECT hash, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions FROM git_log GROUP BY hash")
def _(t):
    return B.git_log(t).groupBy("hash").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))


@query("k4_cascade_delete", "SELECT n.id FROM gp_nodes n WHERE n.file_path <> 'Brand#11'")
def _(t):
    nodes = B.part_nodes(t)
    return lookups.without_node(nodes, B.part_edges(t), nodes.where("file_path = 'Brand#11'").select("id"))[0].select("id")


@query("p15_code_lines", r"SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 7 <> 3) WHERE NOT regexp_matches(ltrim(line, ' ' || chr(9) || chr(13)), '^(//|\*|#)') GROUP BY doc_id")
def _(t):
    path = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("src/tests/d"), "doc_id")).otherwise(F.concat(F.lit("src/d"), "doc_id"))
    lines = text.code_lines(t.documents.select(path.alias("file_path"), F.col("text").alias("content")))
    return lines.groupBy(F.regexp_extract("file_path", r"(\d+)$", 1).cast("long").alias("doc_id")).agg(F.count("*").alias("lines"))


@query("x12_sensitivity", "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 9 WHEN 2 THEN 6 ELSE 0 END AS score FROM part")
def _(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("k"), metrics.sensitivity(_pick(k, "loginUser", "chargePassword", "hashEmail", "run"), F.lit(0), F.lit(0)).alias("score"))


_ASKED = "ds AS (SELECT id AS node_id, name, qualified_name, file_path FROM gp_nodes)"


@query(
    "r6_search_modes",
    f"""WITH {_ASKED}, {(_BM25.removeprefix("WITH ") + ", " + _TFIDF).replace("docs_search", "ds")}
        SELECT 'keyword' AS mode, node_id FROM (SELECT node_id FROM bm ORDER BY round(bm.score, 9), node_id LIMIT 20) UNION ALL SELECT 'semantic', node_id FROM (SELECT node_id FROM cs WHERE cs.score > 0.01 ORDER BY round(cs.score, 9) DESC, node_id LIMIT 20)""",
)
def _(t):
    graph = Engine(B.part_nodes(t), B.part_edges(t))
    found = [graph.search("small brand", 20, mode).select(F.lit(mode).alias("mode"), F.col("id").alias("node_id")) for mode in ("keyword", "semantic")]
    return found[0].unionByName(found[1])
