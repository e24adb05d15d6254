"""Further operators: rules one by one, code flow, resolution, repositories, branches and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _RISK, _scored
from .catalogue_more import _pick
from .functions import rules
from .operators import branches, control, flow, lookups, merge, metrics, modules, schema, text, traversal, views
from .plans import bindings as B
from .plans.lineage import cut
from .registry import query
from .sources import brace_code, brace_flow, files, git, line_symbols, python_ast
from .streaming import runtime

# Each rule with a text that it decides, and texts that none does (null).

SOURCE_SAMPLES = [
    ("req.body.id", "sql_injection"), ("req.query", "sql_injection"), ("request.params.x", "sql_injection"), ("req.headers", "ssrf"), ("req.cookies", "xss"), ("request.form['a']", "sql_injection"),
    ("request.args", "sql_injection"), ("request.GET", "sql_injection"), ("process.env.A", "ssrf"), ("os.environ['A']", "ssrf"), ('System.getenv("A")', "ssrf"), ("os.Getenv(a)", "ssrf"), ("Users.findOne(x)", "xss"),
    ("db.query(s)", "xss"), ("db.select(s)", "xss"), ("fs.readFileSync(p)", "path_traversal"), ("open(p)", "path_traversal"), ("f.read()", "path_traversal"), ("rl = readline", "command_injection"),
    ("input(x)", "command_injection"), ("new Scanner x", "command_injection"), ("window.location", "open_redirect"), ("document.location", "open_redirect"), ("document.cookie", "xss"),
    ("localStorage.getItem(k)", "xss"), ("JSON.parse(s)", "insecure_deserialization"), ("pickle.loads(b)", "insecure_deserialization"), ("yaml.load(s)", "insecure_deserialization"),
    ("y = 2", None), ("request_id", None), ("opened", None), ("env", None),
]
SINK_SAMPLES = [
    ("db.query(`a ${x}`)", "sql_injection"), ("knex.raw(s)", "sql_injection"), ("cursor.execute(q)", "sql_injection"), ("c.executeSql(q)", "sql_injection"), ("db.run(q)", "sql_injection"), ("exec(c)", "command_injection"),
    ("spawn(c)", "command_injection"), ("child_process", "command_injection"), ("subprocess", "command_injection"), ("os.system(c)", "command_injection"), ("Runtime.exec(c)", "command_injection"), ("el.innerHTML = h", "xss"),
    ("dangerouslySetInnerHTML", "xss"), ("document.write(h)", "xss"), ("$(x).html(h)", "xss"), ("render(`${x}`)", "xss"), ("fs.writeFile(p)", "path_traversal"), ("fs.readFile(p)", "path_traversal"), ("fs.unlink(p)", "path_traversal"),
    ("s.createWriteStream(p)", "path_traversal"), ("eval(x)", "command_injection"), ("new Function(x)", "command_injection"), ("vm.runInContext(x)", "command_injection"), ("fetch(u)", "ssrf"), ("axios.get(u)", "ssrf"), ("http.get(u)", "ssrf"),
    ("requests.post(u)", "ssrf"), ("res.redirect(u)", "open_redirect"), ("window.location = u", "open_redirect"), ("location.href = u", "open_redirect"), ("console.log(user.email)", "pii_leak"), ("logger.info(token)", "pii_leak"),
    ("x = 1", None), ("medieval x", None), ("spawned", None), ("redirect", None),
]
SANITIZER_SAMPLES = [
    ("schema.parse(x)", True), ("joi.validate(x)", True), ("validationResult", True), ("escapeHtml(x)", True), ("encodeURIComponent(x)", True), ("DOMPurify.clean", True), ("WHERE a = $1", True), ("db.prepare(q)", True), ("parseInt(x)", True),
    ("String(x)", True), ("Boolean(x)", True), ("path.normalize p", True), ("p.replace('..', x)", True), ("new URL(u)", True), ("bcrypt", True), ("allowlist", True), ("z = v", False), ("x + y", False), ("path", False), ("parser", False),
]
LINE_SAMPLES = [
    ("db.query(`a ${x}`)", "sql_injection", "critical"), ("db.query('a' + x)", "sql_injection", "critical"), ("knex.raw (s)", "sql_injection", "high"), ("c.executeSql (s)", "sql_injection", "high"),
    ("db.run(`a ${x}`)", "sql_injection", "critical"), ("exec(`ls ${x}`)", "command_injection", "critical"), ("exec('ls ' + x)", "command_injection", "critical"), ("require('child_process').exec", "command_injection", "high"),
    ("spawn(`ls ${x}`)", "command_injection", "critical"), ("eval (x)", "command_injection", "critical"), ("new Function (x)", "command_injection", "critical"), ("el.innerHTML = h", "xss", "critical"), ("dangerouslySetInnerHTML", "xss", "critical"),
    ("document.write (h)", "xss", "critical"), ("$(x).html(h)", "xss", "medium"), ("fs.readFile(`${p}`)", "path_traversal", "critical"), ("fs.unlink(path, cb)", "path_traversal", "medium"), ("createWriteStream(p)", "path_traversal", "high"),
    ("fetch(`http://${h}`)", "ssrf", "high"), ("axios.get(`${u}`)", "ssrf", "high"), ("http.get(`${u}`)", "ssrf", "high"), ("res.redirect(req.query.u)", "open_redirect", "high"), ("window.location = u", "open_redirect", "medium"),
    ('password = "hunter2hunter2"', "hardcoded_secret", "high"), ('apiKey = "abcdefghijklmnop"', "hardcoded_secret", "high"), ('secret: "abcdefghijklmnop"', "hardcoded_secret", "high"), ('AWS_SECRET_KEY = "abc"', "hardcoded_secret", "critical"),
    ("-----BEGIN RSA PRIVATE KEY-----", "hardcoded_secret", "critical"), ("Bearer abc.def", "hardcoded_secret", "high"), ("console.log(user.email)", "pii_leak", "medium"), ("logger.info(token)", "pii_leak", "medium"),
    ("JSON.parse(req.raw)", "insecure_deserialization", "medium"), ("yaml.load (s)", "insecure_deserialization", "high"), ("pickle.loads (b)", "insecure_deserialization", "critical"), ("Object.assign({}, req.x)", "prototype_pollution", "medium"),
    ("m[body.key]", "prototype_pollution", "medium"), ("new RegExp(user)", "unsafe_regex", "medium"), ("cors()", "missing_auth", "medium"), ("helmet({contentSecurityPolicy: false})", "missing_auth", "medium"),
    ("x = 1", None, None), ("query(x)", None, None), ("// eval(x)", None, None), ("  * eval(x)", None, None), ("# eval(x)", None, None), ("password = 'short'", None, None),
]
ENTRY_SAMPLES = [
    ("userHandler", "", "http_handler"), ("x", "(req: Request, res: Response)", "http_handler"), ("onClick", "", "event_listener"), ("x", "bus.subscribe(y)", "event_listener"), ("cleanupCron", "", "cron_job"), ("mailTask", "", "cron_job"),
    ("cmd_build", "", "cli_command"), ("x", "program.command(y)", "cli_command"), ("main", "", "main_function"), ("x", "func main ()", "main_function"), ("test_it", "", "test_function"), ("x", "describe(y)", "test_function"),
    ("UserResolver", "", "graphql_resolver"), ("resolveUser", "", "graphql_resolver"), ("ChatSocket", "", "websocket_handler"), ("mailConsumer", "", "queue_consumer"), ("x", "q.consume(y)", "queue_consumer"), ("compute", "", None), ("mainly", "", None),
]
FRAMEWORK_SAMPLES = [
    ("a/x.test.ts", "describe", False, "jest"), ("a/test_x.py", "test_it", False, "pytest"), ("a/x_test.py", "TestCase", False, "unittest"), ("src/AbcTest.java", "testIt", False, "junit"), ("a/x_test.go", "TestIt", False, "go_test"),
    ("a/x_spec.rb", "describe", False, "rspec"), ("a/XTest.php", "testIt", False, "phpunit"), ("a/x.rs", "run", False, None), ("a/conf.py", "helper", True, "pytest"), ("b/y.tsx", "helper", True, "vitest"), ("b/y.go", "helper", True, "go_test"), ("b/y.go", "helper", False, None),
]


def _values(rows: list[tuple], *columns: str) -> str:
    """The rows as a SQL table."""
    say = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) v({', '.join(columns)})"


def _samples(t, rows: list[tuple], schema_: str):
    """The samples, for every supplier's file."""
    held = t.spark.createDataFrame(rows, schema_)  # a row for each rule
    return t.supplier.select(F.col("s_suppkey").alias("file")).crossJoin(F.broadcast(held))


@query("x1_every_source", f"SELECT s_suppkey AS file, code, category FROM supplier, {_values(SOURCE_SAMPLES, 'code', 'category')}")
def _(t):
    return _samples(t, [r[:1] for r in SOURCE_SAMPLES], "code string").withColumn("category", rules.first_of(F.col("code"), rules.SOURCES, 1))


@query("x2_every_sink", f"SELECT s_suppkey AS file, code, category FROM supplier, {_values(SINK_SAMPLES, 'code', 'category')}")
def _(t):
    return _samples(t, [r[:1] for r in SINK_SAMPLES], "code string").withColumn("category", rules.first_of(F.col("code"), rules.SINKS, 1))


@query("x3_every_sanitizer", f"SELECT s_suppkey AS file, code, safe FROM supplier, {_values(SANITIZER_SAMPLES, 'code', 'safe')}")
def _(t):
    return _samples(t, [r[:1] for r in SANITIZER_SAMPLES], "code string").withColumn("safe", rules.any_of(F.col("code"), rules.SANITIZERS))


@query(
    "x4_custom_patterns",
    """SELECT p_partkey AS id, CASE WHEN contains(p_name, 'ring') THEN 'jewel' WHEN contains(p_name, 'gear') OR contains(p_name, 'bolt') THEN 'machine' END AS category FROM part""",
)
def _(t):
    own = rules.added(rules.SOURCES, ("ring$", "jewel"), ("gear|bolt", "machine"))
    return t.part.select(F.col("p_partkey").alias("id"), rules.first_of(F.col("p_name"), own, 1).alias("category"))


@query("x5_every_line", f"SELECT 'src/f' || s_suppkey || '.ts' AS file_path, text, category, severity FROM supplier, {_values(LINE_SAMPLES, 'text', 'category', 'severity')} WHERE category IS NOT NULL AND s_suppkey % 3 <> 0")
def _(t):
    folder = F.when(F.col("s_suppkey") % 3 == 0, "src/__tests__/f").otherwise("src/f")
    source = t.supplier.select(F.concat(folder, "s_suppkey", F.lit(".ts")).alias("file_path"), F.lit("\n".join(r[0] for r in LINE_SAMPLES)).alias("content"))
    found = text.scan_lines(source)
    lines = F.array(*[F.lit(r[0]) for r in LINE_SAMPLES])
    return found.select("file_path", F.element_at(lines, F.col("line").cast("int")).alias("text"), "category", "severity")


@query("x6_every_entry", f"SELECT s_suppkey AS file, name, signature, type FROM supplier, {_values(ENTRY_SAMPLES, 'name', 'signature', 'type')}")
def _(t):
    return _samples(t, [r[:2] for r in ENTRY_SAMPLES], "name string, signature string").withColumn("type", rules.entry_type(F.col("name"), F.col("signature")))


@query("x7_every_framework", f"SELECT s_suppkey AS file, path, name, is_test, framework FROM supplier, {_values(FRAMEWORK_SAMPLES, 'path', 'name', 'is_test', 'framework')}")
def _(t):
    rows = _samples(t, [r[:3] for r in FRAMEWORK_SAMPLES], "path string, name string, is_test boolean")
    return rows.withColumn("framework", rules.test_framework(F.col("path"), F.col("name"), F.col("is_test")))


@query("s3b_language_or_text", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'text' WHEN 2 THEN 'go' ELSE 'text' END AS language FROM part")
def _(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), rules.language_or_text(_pick(k, "a/b.tsx", "README.md", "m.go", "LICENSE")).alias("language"))


@query("s15_repository_address", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'a.b' END AS owner, CASE p_partkey % 4 WHEN 0 THEN 'repo-' || p_partkey WHEN 1 THEN 'r' END AS name FROM part")
def _(t):
    k = F.col("p_partkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://github.com/own/repo-"), k, F.lit(".git"))).when(k % 4 == 1, "git@github.com:a.b/r.git").when(k % 4 == 2, "https://example.org/own/repo").otherwise("https://github.com/own/repo/tree/main")
    return t.part.select(k.alias("id"), rules.repository(url).alias("r")).select("id", "r.owner", "r.name")


# lookups and resolution


@query("p12_flow_filter", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O') AND starts_with('src/c' || o_custkey || '/a.ts', 'src/c1')")
def _(t):
    severity = F.when(F.col("o_orderstatus") == "F", "critical").when(F.col("o_orderstatus") == "O", "warning").otherwise("info")
    flows = t.orders.select(F.col("o_orderkey").alias("id"), severity.alias("severity"), F.concat(F.lit("src/c"), "o_custkey", F.lit("/a.ts")).alias("first_path"))
    return lookups.flow_filter(flows, "warning", "src/c1").select("id")


@query("p11_path_filter", "SELECT ord AS id FROM gs_findings WHERE severity IN ('critical', 'high', 'medium') AND (contains(file_path, '1') OR contains('t' || line, '1'))")
def _(t):
    rows = B.findings(t).select(F.col("ord").alias("id"), "severity", F.col("file_path").alias("source_path"), F.concat(F.lit("t"), "line").alias("sink_path"))
    return lookups.finding_filter(rows, "medium", "1").select("id")


@query(
    "p16_definition_block",
    """SELECT s_suppkey AS source, CAST(CASE s_suppkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 END AS INTEGER) AS line, CAST(CASE s_suppkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 END AS INTEGER) AS end_line FROM supplier WHERE s_suppkey % 3 <> 2""",
)
def _(t):
    k = F.col("s_suppkey")
    body = _pick(k, "a\nrun(1)\n\nfunction run() {\n  if (x) {\n  } y\n}\nz", "let q = 1\nconst run = () => {\n  }\n}", "runner()\nrunning\n")
    found = files.definition(git.lines(t.supplier.select(k.alias("source"), body.alias("text"))), "run", "function")
    return found.select("source", F.col("line").cast("int").alias("line"), F.col("end_line").cast("int").alias("end_line"))


@query("p17_source_snippet", "SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'l7' || chr(10) || 'l8' || chr(10) || 'l9' WHEN 1 THEN 'l1' || chr(10) || 'l2' || chr(10) || 'l3' || chr(10) || 'l4' ELSE 'l9' END AS snippet FROM supplier")
def _(t):
    k = F.col("s_suppkey")
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("l"), i)), "\n")
    cut_ = F.when(k % 4 == 0, files.snippet(lines, 10)).when(k % 4 == 1, files.snippet(lines, 2, 3, 2)).otherwise(files.snippet(lines, 9, 0, 4))
    return t.supplier.select(k.alias("k"), cut_.alias("snippet"))


@query("s17_source_slice", "SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'b' || chr(10) || 'c' WHEN 1 THEN NULL WHEN 2 THEN 'b' || chr(10) || 'c' WHEN 3 THEN NULL ELSE 'b' || chr(10) || 'c' END AS content FROM supplier")
def _(t):
    k = F.col("s_suppkey")
    path = _pick(k, "src/a.ts", "../etc/passwd", "src/../src/a.ts", "/etc/passwd", "./a/./b.ts")
    return t.supplier.select(k.alias("k"), files.source_slice(path, F.lit("a\nb\nc"), F.lit(2), F.lit(9)).alias("content"))


@query("s18_repo_stats", "SELECT n.k AS repo, count(*) AS nodes, count(DISTINCT file_path) AS files, count(*) FILTER (kind IN ('function', 'method')) AS functions, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (is_test) AS tests, any_value(e.edges) AS edges FROM (SELECT *, ord % 7 AS k FROM gp_nodes) n JOIN (SELECT src % 7 AS k, count(*) AS edges FROM gp_edges GROUP BY 1) e ON e.k = n.k GROUP BY n.k")
def _(t):
    nodes = B.part_nodes(t).select("*", (F.col("ord") % 7).alias("repo"), rules.language(_pick(F.col("ord"), "a.ts", "b.py")).alias("language"))
    return views.repo_stats(nodes, B.part_edges(t).withColumn("repo", F.col("src") % 7)).drop("languages")


@query("s13_branches", "SELECT o_custkey AS source, 'b' || o_orderkey AS name, o_orderkey % 2 = 1 AS remote, o_orderkey % 5 = 0 AS current FROM orders")
def _(t):
    k = F.col("o_orderkey")
    line = F.concat(F.when(k % 5 == 0, "* ").otherwise("  "), F.when(k % 2 == 1, "remotes/origin/").otherwise(""), F.lit("b"), k, F.lit("   "), F.lpad(F.lower(F.hex(k)), 8, "0"), F.lit(" message"))
    body = t.orders.groupBy(F.col("o_custkey").alias("source")).agg(F.array_join(F.collect_list(line), "\n").alias("text")).withColumn("text", F.concat("text", F.lit("\n  remotes/origin/HEAD -> origin/main")))
    return git.parse_branches(git.lines(body)).select("source", "name", "remote", "current")


@query("s11_blame", "SELECT o_custkey AS source, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS line_no, 'A' || (o_orderkey % 3) AS author, 'l' || o_orderkey AS content FROM orders")
def _(t):
    k = F.col("o_orderkey")
    turn = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    # a commit says its author with its first line only
    first = F.row_number().over(Window.partitionBy("o_custkey", k % 3).orderBy("o_orderkey")) == 1
    rows = t.orders.select("o_custkey", "o_orderkey", F.row_number().over(turn).alias("n"), first.alias("first"))
    line = F.format_string("%040x %d %d\n%s\tl%d", k % 3, "n", "n", F.when(F.col("first"), F.format_string("author A%d\nauthor-mail <a@x>\nauthor-time 5\n", k % 3)).otherwise(""), k)
    body = rows.groupBy(F.col("o_custkey").alias("source")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("x")))), lambda s: s["x"]), "\n").alias("text"))
    return git.parse_blame(git.lines(body)).select("source", "line_no", "author", "content")


@query("b9_merge_conflicts", "SELECT 'f' || s_suppkey AS file_path, CAST(2 AS INTEGER) AS start_line, CAST(6 AS INTEGER) AS end_line FROM supplier UNION ALL SELECT 'f' || s_suppkey, 7, 9 FROM supplier")
def _(t):
    body = F.concat(F.lit("CONFLICT (content): Merge conflict in f"), "s_suppkey", F.lit("\n<<<<<<< ours\na\n=======\nb\n>>>>>>> theirs\n<<<<<<< ours\n=======\n>>>>>>> theirs\nrest"))
    return files.merge_conflicts(git.lines(t.supplier.select(F.col("s_suppkey").alias("source"), body.alias("text")))).select("file_path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


def _revisions(t):
    """Each customer's orders as a text, and two versions of it: lines removed, changed (some alike in both) and added."""
    k, line = F.col("o_orderkey"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority"))
    rows = t.orders.select(F.col("o_custkey").alias("source"), k.alias("k"), line.alias("line"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("k", "part")) - 1

    def version(removed, changed, added, word):
        lines = F.concat(F.when(removed, F.array().cast("array<string>")).otherwise(F.array(changed)), F.when(added, F.array(F.concat(F.lit(word), F.col("k").cast("string")))).otherwise(F.array().cast("array<string>")))
        return rows.select("source", "k", F.posexplode(lines).alias("part", "line")).select("source", place.alias("pos"), "line")

    k, line, never = F.col("k"), F.col("line"), F.lit(False)
    return (
        version(never, line, never, ""),
        version(k % 7 == 0, F.when(k % 11 == 3, F.concat(line, F.lit("!"))).otherwise(line), k % 13 == 5, "note "),
        version(k % 5 == 0, F.when(k % 11 == 3, F.concat(line, F.when(k % 2 == 0, "!").otherwise("?"))).otherwise(line), k % 17 == 4, "memo "),
    )


_MERGED = """b AS (SELECT o_custkey AS source, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey || ' ' || o_orderpriority AS line, NOT (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 3) AS stable FROM orders),
    c AS (SELECT *, sum(stable::INTEGER) OVER (PARTITION BY source ORDER BY pos) AS chunk FROM b),
    i AS (SELECT source, chunk, 'b' AS side, pos, 0 AS part, line FROM c WHERE NOT stable UNION ALL SELECT source, chunk, 'o', pos, 0, CASE WHEN k % 11 = 3 THEN line || '!' ELSE line END FROM c WHERE NOT stable AND k % 7 <> 0
        UNION ALL SELECT source, chunk, 'o', pos, 1, 'note ' || k FROM c WHERE k % 13 = 5 UNION ALL SELECT source, chunk, 't', pos, 0, CASE WHEN k % 11 = 3 THEN line || CASE WHEN k % 2 = 0 THEN '!' ELSE '?' END ELSE line END FROM c WHERE NOT stable AND k % 5 <> 0
        UNION ALL SELECT source, chunk, 't', pos, 1, 'memo ' || k FROM c WHERE k % 17 = 4),
    g AS (SELECT source, chunk, list(line ORDER BY pos, part) FILTER (WHERE side = 'b') AS b, list(line ORDER BY pos, part) FILTER (WHERE side = 'o') AS o, list(line ORDER BY pos, part) FILTER (WHERE side = 't') AS t FROM i GROUP BY ALL),
    h AS (SELECT source, chunk, coalesce(b, []) AS b, coalesce(o, []) AS o, coalesce(t, []) AS t FROM g),
    m AS (SELECT h.*, coalesce(c.pos + 1, 0) AS base_start, CASE WHEN o = t THEN 'both' WHEN t = b THEN 'ours' WHEN o = b THEN 'theirs' ELSE 'conflict' END AS kind FROM h LEFT JOIN c ON c.source = h.source AND c.chunk = h.chunk AND c.stable)"""


@query(
    "b9_merge",
    f"""WITH {_MERGED} SELECT source, CAST(chunk AS BIGINT) AS chunk, kind, CAST(base_start AS BIGINT) AS base_start, CAST(len(b) AS BIGINT) AS base_lines, CAST(len(o) AS BIGINT) AS ours_lines, CAST(len(t) AS BIGINT) AS theirs_lines,
        array_to_string(CASE kind WHEN 'theirs' THEN t WHEN 'conflict' THEN list_concat(list_concat(list_concat(['<<<<<<< ours'], o), list_concat(['======='], t)), ['>>>>>>> theirs']) ELSE o END, '|') AS result FROM m""",
)
def _(t):
    rows = merge.chunks(*_revisions(t))
    sizes = [F.size(f"{n}_lines").cast("long").alias(f"{n}_lines") for n in ("base", "ours", "theirs")]
    result = F.array_join(merge.resolved(F.col("kind"), F.col("ours_lines"), F.col("theirs_lines")), "|").alias("result")
    return rows.select("source", F.col("chunk").cast("long").alias("chunk"), "kind", F.col("base_start").cast("long").alias("base_start"), *sizes, result)


@query("b9_merge_outcome", f"WITH {_MERGED} SELECT source, count(*) AS changes, count(*) FILTER (WHERE kind = 'conflict') AS conflicts, bool_and(kind <> 'conflict') AS clean FROM m GROUP BY source")
def _(t):
    return merge.outcome(*_revisions(t))


_CALLS = """calls AS (SELECT p_partkey AS call, p_brand AS file_path, 'F' || (p_partkey * 7 % 120) AS callee, CASE p_partkey % 3 WHEN 0 THEN 'r' || (p_partkey % 11) END AS receiver, CAST(p_partkey % 4 AS INTEGER) AS n_args FROM part),
    n AS (SELECT id, ord, kind, exported AND id % 4 = 1 AS exported, file_path, 'F' || (id % 100) AS name, 'Q' || id AS qn, 'F' || (id // 5 * 5 % 100) AS owner, CAST(id % 5 AS INTEGER) AS n_params FROM gp_nodes),
    fns AS (SELECT * FROM n WHERE kind IN ('function', 'method', 'constructor')), same AS (SELECT file_path, name, arg_min(id, ord) AS id FROM fns GROUP BY ALL),
    imp AS (SELECT p_brand AS file_path, 'F' || (p_partkey * 11 % 120) AS name, max('Q' || (p_partkey * 3 % 150)) AS qn FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL UNION ALL SELECT p_brand, 'r' || (p_partkey % 11), max('Q' || (p_partkey * 5 % 150)) FROM part WHERE p_partkey % 6 = 3 GROUP BY ALL),
    loc AS (SELECT i.file_path, i.name, n.id, n.name AS q_name, n.file_path AS q_file FROM imp i JOIN n ON n.qn = i.qn), method AS (SELECT file_path, owner, name, arg_min(id, ord) AS id FROM n WHERE kind IN ('method', 'function') GROUP BY ALL),
    thru AS (SELECT l.file_path, l.name AS receiver, m.name AS callee, min(m.id) AS id FROM loc l JOIN method m ON m.file_path = l.q_file AND m.owner = l.q_name GROUP BY ALL),
    typ AS (SELECT p_brand AS file_path, 'r' || (p_partkey % 11) AS receiver, max('F' || (p_partkey * 13 % 20 * 5)) AS type FROM part WHERE p_partkey % 5 = 2 GROUP BY ALL),
    nar AS (SELECT o.name AS type, m.name AS callee, arg_min(m.id, o.ord) AS id FROM n o JOIN method m ON m.file_path = o.file_path AND m.owner = o.name WHERE o.kind = 'class' GROUP BY ALL),
    ex AS (SELECT name, count(*) AS c, arg_min(id, ord) AS id FROM fns WHERE exported GROUP BY name), fit AS (SELECT n.name, n_params, arg_min(n.id, ord) AS id FROM n LEFT JOIN ex USING (name) WHERE ex.c IS NULL OR (exported AND kind <> 'class') GROUP BY n.name, n_params),
    any_ AS (SELECT name, arg_min(id, ord) AS id FROM fns GROUP BY name),
    r AS (SELECT c.call, s.id AS a, coalesce(l.id, th.id) AS b, na.id AS c, coalesce(CASE WHEN ex.c = 1 THEN ex.id END, fit.id, ex.id, any_.id) AS d FROM calls c LEFT JOIN same s ON s.file_path = c.file_path AND s.name = c.callee LEFT JOIN loc l ON l.file_path = c.file_path AND l.name = c.callee
        LEFT JOIN thru th ON th.file_path = c.file_path AND th.receiver = c.receiver AND th.callee = c.callee LEFT JOIN typ ON typ.file_path = c.file_path AND typ.receiver = c.receiver LEFT JOIN nar na ON na.type = typ.type AND na.callee = c.callee
        LEFT JOIN ex ON ex.name = c.callee LEFT JOIN fit ON fit.name = c.callee AND fit.n_params = c.n_args LEFT JOIN any_ ON any_.name = c.callee)"""


@query(
    "j7_call_tiers",
    f"""WITH {_CALLS} SELECT call, coalesce(a, b, c, d) AS target, CASE WHEN a IS NOT NULL THEN 'same_file' WHEN b IS NOT NULL THEN 'import_scoped' WHEN c IS NOT NULL THEN 'type_narrowed' WHEN d IS NOT NULL THEN 'global' END AS tier,
        CASE WHEN a IS NOT NULL THEN 0.95::DOUBLE WHEN b IS NOT NULL THEN 0.9::DOUBLE WHEN c IS NOT NULL THEN 0.85::DOUBLE WHEN d IS NOT NULL THEN 0.5::DOUBLE END AS confidence FROM r""",
)
def _(t):
    return lookups.resolve_calls(*_code(t)).select("call", "target", "tier", "confidence")


def _code(t):
    """Calls, nodes, imports and receivers' types, so that every tier decides some calls."""
    k, file = F.col("p_partkey"), F.col("p_brand").alias("file_path")
    f = lambda x, p="F": F.concat(F.lit(p), x.cast("long"))
    calls = t.part.select(k.alias("call"), file, f(k * 7 % 120).alias("callee"), F.when(k % 3 == 0, f(k % 11, "r")).alias("receiver"), (k % 4).cast("int").alias("n_args"))
    i = F.col("id")
    nodes = B.part_nodes(t).select("id", "ord", "kind", (F.col("exported") & (i % 4 == 1)).alias("exported"), "file_path", f(i % 100).alias("name"), f(i, "Q").alias("qualified_name"), f(F.floor(i / 5) * 5 % 100).alias("owner"), (i % 5).cast("int").alias("n_params"))
    named = t.part.where(k % 2 == 0).select(file, f(k * 11 % 120).alias("name"), f(k * 3 % 150, "Q").alias("qualified_name"))
    imports = named.union(t.part.where(k % 6 == 3).select(file, f(k % 11, "r"), f(k * 5 % 150, "Q")))
    types = t.part.where(k % 5 == 2).select(file, f(k % 11, "r").alias("receiver"), f(k * 13 % 20 * 5).alias("type"))
    return calls, nodes, imports, types


@query("j3_search_in_file", "SELECT n.id, n.file_path FROM docs_search d JOIN gp_nodes n ON n.id = d.node_id WHERE d.file_path IN ('Brand#12', 'Brand#21') AND contains(' ' || d.name || ' ', ' small ')")
def _(t):
    found = text.match(B.search_docs(t), "Small").where(F.col("name").contains("small")).select("node_id")
    nodes = B.part_nodes(t).where("file_path IN ('Brand#12', 'Brand#21')")
    return nodes.join(found, F.col("id") == F.col("node_id")).select("id", "file_path")


@query("r3_match", "SELECT node_id FROM docs_search WHERE contains(' ' || lower(name) || ' ', ' small ') OR contains(' ' || lower(qualified_name) || ' ', ' small ')")
def _(t):
    return text.match(B.search_docs(t), "small").select("node_id")


@query("j22_symbol_table", "SELECT qualified_name, arg_max(id, ord) AS id FROM gp_nodes GROUP BY qualified_name")
def _(t):
    return lookups.symbol_table(B.part_nodes(t))[0]


@query(
    "j10_export_chain",
    """WITH RECURSIVE s AS (SELECT 'x' || (p_partkey % 50) AS file, 'N' || (p_partkey % 9) AS name, arg_min('q' || p_partkey, p_partkey) AS qn FROM part GROUP BY ALL), r(name, start, file, n) AS (SELECT DISTINCT 'N' || (p_partkey % 9), 'x' || (p_partkey * 3 % 60), 'x' || (p_partkey * 3 % 60), 1 FROM part
            UNION ALL SELECT name, start, 'x' || ((CAST(substr(file, 2) AS INTEGER) * 7 + 1) % 60), n + 1 FROM r WHERE n < 5), f AS (SELECT name, start, file, min(n) AS n FROM r GROUP BY ALL)
        SELECT f.name, f.start, arg_min(s.qn, f.n) AS qualified_name FROM f JOIN s ON s.file = f.file AND s.name = f.name GROUP BY ALL""",
)
def _(t):
    k = F.col("p_partkey")
    x = lambda v: F.concat(F.lit("x"), v)
    symbols = t.part.select(x(k % 50).alias("file_path"), F.concat(F.lit("N"), k % 9).alias("name"), F.concat(F.lit("q"), k).alias("qualified_name"), k.alias("ord"))
    wanted = t.part.select(F.concat(F.lit("N"), k % 9).alias("name"), x(k * 3 % 60).alias("start"))
    onward = t.spark.range(60).select(x(F.col("id")).alias("file"), x((F.col("id") * 7 + 1) % 60).alias("target"), F.lit(0).alias("ord"))
    return modules.export_chain(wanted, symbols, onward)


@query(
    "j12_receiver_types",
    """WITH c AS (SELECT p_partkey AS call, p_brand AS file_path, 'v' || (p_partkey % 90) AS receiver FROM part), env AS (SELECT p_brand AS file_path, 'v' || (p_partkey * 3 % 90) AS receiver, max('T' || (p_partkey % 5)) AS type FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
        cls AS (SELECT file_path, 'v' || (id % 40) AS name FROM gp_nodes WHERE kind = 'class'), note AS (SELECT file_path, 'v' || (id % 90) AS receiver, arg_min('A' || (id % 7), ord) AS type FROM gp_nodes GROUP BY ALL)
        SELECT call, coalesce(e.type, s.name, a.name, n.type) AS type FROM c LEFT JOIN env e USING (file_path, receiver) LEFT JOIN (SELECT DISTINCT file_path, name FROM cls) s ON s.file_path = c.file_path AND s.name = c.receiver
        LEFT JOIN (SELECT DISTINCT name FROM cls) a ON a.name = c.receiver LEFT JOIN note n ON n.file_path = c.file_path AND n.receiver = c.receiver""",
)
def _(t):
    k, i = F.col("p_partkey"), F.col("id")
    v = lambda x: F.concat(F.lit("v"), x)
    calls = t.part.select(k.alias("call"), F.col("p_brand").alias("file_path"), v(k % 90).alias("receiver"))
    env = t.part.where(k % 2 == 0).select(F.col("p_brand").alias("file_path"), v(k * 3 % 90).alias("name"), F.concat(F.lit("T"), k % 5).alias("type"))
    symbols = B.part_nodes(t).select("file_path", "kind", "ord", v(i % 40).alias("name"), F.concat(F.lit("f("), v(i % 90), F.lit(": A"), i % 7, F.lit(")")).alias("signature"))
    return modules.receiver_types(calls, env, symbols).select("call", "type")


@query(
    "j19_call_links",
    """WITH a AS (SELECT l_orderkey AS call, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, l_partkey AS node FROM lineitem), c AS (SELECT o_orderkey AS call, o_custkey % 100 AS target FROM orders)
        SELECT a.node AS src, c.target * 10 + a.pos AS dst, 'param_bind' AS kind FROM a JOIN c USING (call) WHERE a.pos <= 3 UNION ALL SELECT c.target * 1000 + g, c.call, 'return_flow' FROM c, (VALUES (0), (1)) v(g) WHERE c.target % 2 = 0""",
)
def _(t):
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    arguments = t.lineitem.select(F.col("l_orderkey").alias("call"), F.row_number().over(line).cast("long").alias("pos"), F.col("l_partkey").alias("node"))
    calls = t.orders.select(F.col("o_orderkey").alias("call"), (F.col("o_custkey") % 100).alias("target"))
    fns = t.spark.range(100)
    parameters = fns.select(F.col("id").alias("fn"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("pos")).withColumn("node", F.col("fn") * 10 + F.col("pos"))
    returns = fns.where("id % 2 = 0").select(F.col("id").alias("fn"), F.explode(F.array(F.col("id") * 1000, F.col("id") * 1000 + 1)).alias("node"))
    return flow.link_calls(calls, arguments, parameters, returns)


@query(
    "j21_runtime_nodes",
    """WITH r AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 3 ELSE -1 END AS node_id, CASE p_partkey % 4 WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) ELSE '' END AS symbol, p_brand AS file_path, CAST(p_partkey * 7 % 400 + 1 AS INTEGER) AS line FROM part)
        SELECT ref, coalesce((SELECT min(id) FROM gp_nodes n WHERE n.id = r.node_id), (SELECT min(id) FROM gp_nodes n WHERE n.name = r.symbol), (SELECT min(id) FROM gp_nodes n WHERE lower(n.name) = lower(r.symbol)), (SELECT min(id) FROM gp_nodes n WHERE n.file_path = r.file_path AND n.start_line = r.line)) AS node FROM r""",
)
def _(t):
    k = F.col("p_partkey")
    symbol = F.when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.upper("p_name")).otherwise("")
    refs = t.part.select(k.alias("ref"), F.when(k % 4 == 0, k + 3).otherwise(-1).alias("node_id"), symbol.alias("symbol"), F.col("p_brand").alias("file_path"), (k * 7 % 400 + 1).cast("int").alias("line"))
    return lookups.resolve_runtime(refs, B.part_nodes(t)).select("ref", "node")


@query("t7_seeds", "SELECT id, name FROM (SELECT * FROM gp_nodes WHERE name = 'small ring' ORDER BY ord LIMIT 5)")
def _(t):
    return lookups.seeds(B.part_nodes(t), "small ring", 5).select("id", "name")


# metrics


@query(
    "a6_cognitive",
    """WITH b AS (SELECT *, coalesce(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY fn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM gc_nodes)
        SELECT fn, CAST(sum(CASE status WHEN 'F' THEN 1 + depth WHEN 'P' THEN 1 ELSE 0 END + CASE WHEN priority LIKE '1%' THEN 3 ELSE 0 END) AS BIGINT) AS cognitive FROM b GROUP BY fn""",
)
def _(t):
    nodes = B.order_nodes(t)
    kind = F.when(F.col("status") == "F", _pick(F.col("id"), "branch", "loop_header", "catch")).when(F.col("status") == "P", "switch_case").otherwise("statement")
    blocks = nodes.select("fn", F.col("id").alias("block"), kind.alias("kind"), F.when(F.col("priority") == "1-URGENT", "a && b || c ?? d").otherwise("a & b | c ? d : e").alias("text"))
    depths = control.block_depths(B.order_edges(t), nodes.where("ord = 1").select("fn", F.col("id").alias("block")), blocks.where("kind IN ('branch', 'loop_header', 'catch')").select("fn", "block"))
    return metrics.cognitive_nested(blocks, depths)


@query("a9_lines_of_code", "SELECT file_path AS fn, CAST(max(end_line) - min(start_line) + 1 AS BIGINT) AS loc FROM gp_nodes GROUP BY file_path")
def _(t):
    return metrics.lines_of_code(B.part_nodes(t).select(F.col("file_path").alias("fn"), "start_line", "end_line"))


_TAINT = """p AS (SELECT a.fn, a.id AS source, b.id AS sink, b.ord - a.ord + 1 AS length, (SELECT bool_or(m.is_sanitizer) FROM gc_nodes m WHERE m.fn = a.fn AND m.ord > a.ord AND m.ord <= b.ord) AS sanitized,
        (SELECT count(*) FROM gc_nodes m WHERE m.fn = a.fn AND m.ord > a.ord AND m.ord < b.ord AND m.is_sink) AS between_ FROM gc_nodes a JOIN gc_nodes b ON a.fn = b.fn AND b.ord > a.ord WHERE a.is_source AND b.is_sink)"""


@query(
    "a10_taint_summary",
    f"""WITH {_TAINT}, f AS (SELECT * FROM p WHERE between_ = 0) SELECT (SELECT count(*) FROM gc_nodes WHERE is_source) AS sources, (SELECT count(*) FROM gc_nodes WHERE is_sink) AS sinks, count(*) AS flows, count(*) FILTER (NOT sanitized) AS critical,
        count(*) FILTER (sanitized AND length > 5) AS warning, count(*) FILTER (sanitized AND length <= 5) AS info, count(*) FILTER (sanitized) AS sanitized FROM f""",
)
def _(t):
    nodes = B.order_nodes(t)
    return metrics.taint_summary(nodes, flow.taint(nodes, B.order_edges(t)))


@query("a19_session_stats", "SELECT c_custkey AS session_id, count(o_orderkey) AS edges, count(*) FILTER (o_orderstatus = 'F') AS observed, count(*) FILTER (o_orderstatus = 'O') AS bootstrapped, CAST(coalesce(sum(o_orderkey % 9), 0) AS BIGINT) AS hits FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    kind = F.when(F.col("o_orderstatus") == "F", "observed").when(F.col("o_orderstatus") == "O", "bootstrapped").otherwise("mixed")
    edges = t.orders.select(F.col("o_custkey").alias("session_id"), kind.alias("source_type"), (F.col("o_orderkey") % 9).alias("hit_count"))
    return runtime.session_stats(t.customer.select(F.col("c_custkey").alias("session_id")), edges)


@query("a21_model_references", "SELECT p_brand AS model, p_partkey AS field, p_name AS name, coalesce(r.n, 0) AS references FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity < 3 GROUP BY l_partkey) r ON r.l_partkey = p_partkey")
def _(t):
    fields = t.part.select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("field"), F.col("p_name").alias("name"))
    refs = t.lineitem.where("l_quantity < 3").select(F.col("l_partkey").alias("field"))
    return schema.model_references(fields.select("model").distinct(), fields, refs)


@query("z8_stored_complexity", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size END, 1) AS cyclomatic, coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size END, 0) AS cognitive FROM part WHERE p_size % 15 <> 0")
def _(t):
    s = F.col("p_size")
    return metrics.stored_complexity(t.part.select(F.col("p_partkey").alias("id"), F.when(s % 3 != 0, s).alias("cyclomatic"), F.when(s % 5 != 0, s).alias("cognitive")))


@query(
    "z_buckets",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 7 WHEN p_size % 6 >= 3 THEN 1 WHEN p_size % 6 >= 1 THEN 3 WHEN p_size % 4 >= 2 THEN 5 WHEN p_size % 4 >= 1 THEN 7 ELSE 10 END AS tests,
        CASE WHEN p_partkey % 7 = 0 THEN 5 WHEN p_size > 20 THEN 10 WHEN p_size > 10 THEN 8 WHEN p_size > 5 THEN 6 WHEN p_size > 2 THEN 4 ELSE 2 END AS velocity FROM part""",
)
def _(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select(k.alias("id"), metrics.test_bucket(s % 6, s % 4, k % 5 != 0).alias("tests"), metrics.velocity_bucket(F.when(k % 7 != 0, s)).alias("velocity"))


@query(
    "z4_blast_buckets",
    """WITH RECURSIVE r(root, id) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.root, e.src FROM r JOIN gp_edges e ON e.dst = r.id AND e.kind = 'calls'), n AS (SELECT root AS id, count(*) - 1 AS n FROM r GROUP BY root)
        SELECT id, CASE WHEN n > 100 THEN 10 WHEN n > 50 THEN 8 WHEN n > 20 THEN 6 WHEN n > 5 THEN 4 WHEN n > 0 THEN 2 ELSE 0 END AS blast FROM n""",
)
def _(t):
    return traversal.blast_buckets(B.part_edges(t), t.part.select(F.col("p_partkey").alias("id")))


@query("c7_hotspots_in_file", f"WITH {_RISK} SELECT id, file_path, score, CAST(row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) AS INTEGER) AS place FROM z WHERE score >= 40")
def _(t):
    return views.hotspots_in_file(_scored(t), 40)


@query(
    "c8_factor_impact",
    f"""WITH {_RISK}, ff AS (SELECT id, unnest(['complexity', 'testCoverage', 'dataSensitivity', 'blastRadius', 'changeVelocity', 'errorHandling']) AS name, unnest([complexity, tests, 0, blast, 5, errors]) AS score, unnest([0.15, 0.25, 0.2, 0.15, 0.1, 0.15])::DOUBLE AS weight FROM z)
        SELECT id, name, CAST(floor(score * weight * 10 + 0.5) AS BIGINT) AS impact, CAST(row_number() OVER (PARTITION BY id ORDER BY score * weight DESC, name) AS INTEGER) AS place FROM ff""",
)
def _(t):
    factors = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("score"), F.lit(w).alias("weight")) for n, w in metrics.WEIGHTS.items()])).alias("f")
    return views.factor_impact(_scored(t).select("id", factors).select("id", "f.*"))


# flow


@query("g21_trace_value", "SELECT a.fn, a.id AS root, b.id, CAST(b.ord - a.ord AS INTEGER) AS depth FROM gc_nodes a JOIN gc_nodes b ON a.fn = b.fn AND b.ord >= a.ord AND b.ord - a.ord < 10 WHERE a.is_source")
def _(t):
    starts = B.order_nodes(t).where("is_source").select(F.col("id").alias("root"), "fn", "id")
    return flow.trace_value(B.order_edges(t), starts).select("fn", "root", "id", "depth")


@query("g8_bootstrap")
def _(t):
    edges = B.part_edges(t).withColumn("ord", F.col("dst"))
    return runtime.bootstrap(edges, lookups.seeds(B.part_nodes(t), "small ring").select("id", "ord"))


@query("g19_def_use", "SELECT n.id, coalesce(string_agg(e.dst, ',' ORDER BY e.dst), '') AS uses FROM gc_nodes n LEFT JOIN gc_edges e ON e.src = n.id WHERE n.status = 'P' GROUP BY n.id")
def _(t):
    return flow.def_use(B.order_nodes(t).withColumn("is_def", F.col("status") == "P"), B.order_edges(t)).select("id", F.array_join("uses", ",").alias("uses"))


@query(
    "g15_loops",
    """SELECT fn, id AS block, CAST(coalesce(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY fn ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS nesting,
        coalesce(lead(id) OVER (PARTITION BY fn ORDER BY ord) IS NULL AND count(*) OVER (PARTITION BY fn) > 1, false) AS leads_back FROM gc_nodes""",
)
def _(t):
    """Each customer's orders in a ring: the edge to the first leads back."""
    nodes = B.order_nodes(t)
    ends = nodes.groupBy("fn").agg(F.min_by("id", "ord").alias("dst"), F.max_by("id", "ord").alias("src")).where("src <> dst")
    ring = B.order_edges(t).withColumn("kind", F.lit("next")).unionByName(ends.withColumn("kind", F.lit("back")))
    blocks = nodes.select("fn", F.col("id").alias("block"), (F.col("ord") == 1).alias("is_entry"), (F.col("status") == "F").alias("is_header"))
    back = control.back_edges(ring).select("fn", F.col("src").alias("block"), F.lit(True).alias("back"))
    return control.loop_nesting(ring, blocks).join(back, ["fn", "block"], "left").select("fn", "block", "nesting", F.coalesce("back", F.lit(False)).alias("leads_back"))


@query(
    "g24_summaries",
    """WITH e AS (SELECT DISTINCT o_custkey AS fn, CASE o_orderkey % 4 WHEN 0 THEN 'db_write' WHEN 1 THEN 'log' WHEN 2 THEN 'env_read' END AS kind FROM orders), f AS (SELECT fn, count(*) FILTER (ord > 1) AS flows, bool_or(status = 'P') AS null_, bool_or(status = 'O') AS undef FROM gc_nodes GROUP BY fn)
        SELECT f.fn, flows, (SELECT count(*) FROM e WHERE e.fn = f.fn AND kind IS NOT NULL) AS effects, null_ AS can_return_null, undef AS can_return_undefined, CAST(1 AS BIGINT) AS cyclomatic FROM f""",
)
def _(t):
    nodes = B.order_nodes(t)
    flows = control.param_flows(B.order_edges(t).withColumn("transform", F.lit(None).cast("string")), nodes.where("ord = 1"))
    code = t.orders.select(F.col("o_custkey").alias("fn"), _pick(F.col("o_orderkey"), "user.save()", "console.warn(x)", "process.env.A", "y = 1").alias("code"))
    returns = nodes.select("fn", F.when(F.col("status") == "P", "return null;").when(F.col("status") == "O", "return;").otherwise("return x").alias("text"))
    throws = nodes.select("fn", control.throw_type(F.lit("throw new TypeError(x)")).alias("type"))
    cc = metrics.cyclomatic(nodes, B.order_edges(t)).withColumn("cognitive", F.lit(0))
    rows = control.summaries(nodes.select("fn").distinct(), flows, control.effects(code), throws, returns, cc)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return rows.select("fn", size("flows"), size("effects"), "can_return_null", "can_return_undefined", "cyclomatic")


@query(
    "b8_semantic_diff",
    """WITH a AS (SELECT l_suppkey AS name, list_sort(list_distinct(list(l_returnflag) FILTER (l_linenumber = 1))) AS e, list_distinct(list('p' || l_linenumber) FILTER (l_tax < 0.02)) AS f FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS name, list_distinct(list(l_returnflag) FILTER (l_linenumber = 2)) AS e, list_distinct(list('p' || l_linenumber) FILTER (l_tax > 0.07)) AS f FROM lineitem GROUP BY 1),
        d AS (SELECT name, len(list_filter(coalesce(b.e, []), lambda x: NOT list_contains(coalesce(a.e, []), x))) AS added, len(list_filter(coalesce(a.e, []), lambda x: NOT list_contains(coalesce(b.e, []), x))) AS removed,
            len(list_filter(coalesce(b.f, []), lambda x: NOT list_contains(coalesce(a.f, []), x))) AS flows_added, len(list_filter(coalesce(a.f, []), lambda x: NOT list_contains(coalesce(b.f, []), x))) AS flows_removed, name % 3 = 0 AS undefined_changed FROM a JOIN b USING (name))
        SELECT * FROM d WHERE added > 0 OR removed > 0 OR flows_added > 0 OR flows_removed > 0 OR undefined_changed""",
)
def _(t):
    def side(line, tax, undefined):
        set_ = lambda when, value: F.collect_set(F.when(when, value))
        rows = t.lineitem.groupBy(F.col("l_suppkey").alias("name")).agg(set_(F.col("l_linenumber") == line, F.col("l_returnflag")).alias("effects"), set_(tax, F.concat(F.lit("p"), "l_linenumber")).alias("flows"))
        return rows.withColumns({"can_return_null": F.lit(False), "can_return_undefined": undefined})

    rows = control.compare_summaries(side(1, F.col("l_tax") < 0.02, F.lit(False)), side(2, F.col("l_tax") > 0.07, F.col("name") % 3 == 0))
    size = lambda c: F.size(c).cast("long").alias(c)
    return rows.select("name", size("added"), size("removed"), size("flows_added"), size("flows_removed"), "undefined_changed")


@query(
    "b8_merged_differences",
    """SELECT s_suppkey AS name, CASE s_suppkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a' ELSE 'b' END AS added, s_suppkey % 3 <> 1 AS null_changed FROM supplier""",
)
def _(t):
    k = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    side = lambda where, x, null: t.supplier.where(where).select(k.alias("name"), F.array(F.lit(x)).alias("added"), none.alias("removed"), F.lit(null).alias("null_changed"))
    rows = control.merge_differences(side("s_suppkey % 3 <> 2", "a", False), side("s_suppkey % 3 <> 1", "b", True))
    return rows.select("name", F.array_join(F.sort_array("added"), ",").alias("added"), "null_changed")


# branches, models


@query(
    "b3_conflict_rows",
    """WITH it AS (SELECT DISTINCT * FROM br_items WHERE branch IN (1, 2)), a AS (SELECT * FROM it WHERE branch = 1), b AS (SELECT * FROM it WHERE branch = 2),
        e AS (SELECT branch, key, min(replace(item_kind, 'symbol_', '')) AS did FROM it WHERE item_kind IN ('symbol_added', 'symbol_modified') GROUP BY ALL)
        SELECT 1 AS level, 'low' AS severity, a.key, NULL AS other, NULL AS change FROM a JOIN b USING (key) WHERE a.item_kind = 'file' AND b.item_kind = 'file'
        UNION ALL SELECT 2, 'medium', x.key, NULL, x.did || '/' || y.did FROM e x JOIN e y USING (key) WHERE x.branch = 1 AND y.branch = 2
        UNION ALL SELECT 3, 'high', key, NULL, CAST(branch AS VARCHAR) FROM it WHERE item_kind = 'signature_changed' AND (SELECT count(DISTINCT branch) FROM e) = 2
        UNION ALL SELECT 4, 'critical', key, NULL, '1' FROM a WHERE item_kind = 'summary_changed' AND (EXISTS (SELECT 1 FROM b WHERE item_kind = 'symbol_added') OR key IN (SELECT key FROM b WHERE item_kind = 'symbol_modified'))
        UNION ALL SELECT 5, 'critical', a.key, b.key, NULL FROM a JOIN b USING (model) WHERE a.item_kind = 'schema_field' AND b.item_kind = 'schema_field'""",
)
def _(t):
    return branches.between(B.branch_items(t), 1, 2)


@query("k5_fingerprints", "SELECT DISTINCT branch, item_kind, key FROM br_items")
def _(t):
    return branches.from_json(branches.to_json(B.branch_items(t)))


@query("b13_range_summary", "SELECT l_suppkey AS range, count(DISTINCT l_partkey % 97) AS files, CAST(sum(l_quantity) AS BIGINT) AS insertions, CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM lineitem GROUP BY 1")
def _(t):
    diff = t.lineitem.select(F.col("l_suppkey").alias("range"), (F.col("l_partkey") % 97).alias("file_path"), F.col("l_quantity").cast("long").alias("insertions"), F.col("l_linenumber").cast("long").alias("deletions"))
    return views.range_summary(diff).drop("changed")


@query("t4_critical_first", "SELECT ord AS id, CAST(row_number() OVER (ORDER BY rank, ord) AS INTEGER) AS place FROM gs_findings ORDER BY place LIMIT 50")
def _(t):
    first = views.critical_first(B.findings(t)).limit(50)
    return first.select(F.col("ord").alias("id"), F.row_number().over(Window.orderBy("rank", "ord")).alias("place"))  # 50 rows


@query("g27_model_connections", "SELECT name, count(*) AS connections FROM (SELECT DISTINCT e, unnest([a, b]) AS name FROM (SELECT l_orderkey AS e, 'M' || min(l_suppkey) AS a, 'M' || max(l_suppkey) AS b FROM lineitem GROUP BY l_orderkey)) GROUP BY name")
def _(t):
    m = lambda f: F.concat(F.lit("M"), f("l_suppkey"))
    return views.connections(t.lineitem.groupBy("l_orderkey").agg(m(F.min).alias("from"), m(F.max).alias("to")))


_DEF = "def f(a, b=1):\n    c = a\n    c.d = g(c, b)\n    e = c.d\n    if e:\n        return g(e)\n    return None\n"


@query(
    "g17_data_flow",
    """SELECT 'p' || s_suppkey || '.py' AS file_path, src, dst, kind FROM supplier, (VALUES ('a', 'c', 'data_dep'), ('c', 'g(c, b)', 'param_bind'), ('b', 'g(c, b)', 'param_bind'), ('g(c, b)', 'c.d', 'data_dep'), ('c', 'c.d', 'field_flow'),
        ('c.d', 'c.d', 'field_flow'), ('c.d', 'e', 'data_dep'), ('e', 'g(e)', 'param_bind'), ('g(e)', 'return g(e)', 'data_dep')) v(src, dst, kind)""",
)
def _(t):
    source = t.supplier.select(F.format_string("p%d.py", "s_suppkey").alias("file_path"), F.lit(_DEF).alias("content"))
    nodes, edges = python_ast.data_flow(python_ast.facts(source))
    code = lambda end: nodes.select(F.col("id").alias(end), F.col("code").alias(f"{end}_code"))
    return edges.join(code("src"), "src").join(code("dst"), "dst").select("file_path", F.col("src_code").alias("src"), F.col("dst_code").alias("dst"), "kind")


@query("g20_phi_versions", "WITH n AS (SELECT n.id, n.file_path AS name, n.ord, e.c FROM gp_nodes n JOIN (SELECT dst, count(*) AS c FROM gp_edges GROUP BY dst HAVING count(*) > 1) e ON e.dst = n.id) SELECT id, name, c AS incoming, (SELECT count(*) FROM gp_nodes m WHERE m.file_path = n.name) + row_number() OVER (PARTITION BY name ORDER BY ord) AS version FROM n")
def _(t):
    definitions = B.part_nodes(t).select(F.lit(0).alias("fn"), "id", F.col("file_path").alias("name"), "ord")
    return flow.phi_versions(definitions, B.part_edges(t))


@query(
    "x14_type_environment",
    """WITH a AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'f' || (o_custkey % 50) WHEN 1 THEN 'f' || (o_custkey % 50) || '.K' ELSE 'f' || (o_custkey % 50) || '.K.m' END AS scope, 'v' || (o_orderkey % 4) AS name, o_orderkey AS ord,
            CASE o_orderkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'array' WHEN 3 THEN 'boolean' END AS type FROM orders),
        u AS (SELECT o_orderkey AS use, 'f' || (o_custkey % 50) AS f, 'v' || (o_orderkey * 7 % 5) AS name, o_orderkey AS ord FROM orders)
        SELECT use, coalesce((SELECT arg_max(type, a.ord) FROM a WHERE a.scope = u.f || '.K.m' AND a.name = u.name AND a.ord < u.ord AND type IS NOT NULL), (SELECT arg_max(type, a.ord) FROM a WHERE a.scope = u.f || '.K' AND a.name = u.name AND type IS NOT NULL),
            (SELECT arg_max(type, a.ord) FROM a WHERE a.scope = u.f AND a.name = u.name AND type IS NOT NULL)) AS type FROM u""",
)
def _(t):
    k, f = F.col("o_orderkey"), F.concat(F.lit("f"), F.col("o_custkey") % 50)
    scope = F.when(k % 3 == 0, f).when(k % 3 == 1, F.concat(f, F.lit(".K"))).otherwise(F.concat(f, F.lit(".K.m")))
    said = t.orders.select(scope.alias("scope"), F.concat(F.lit("v"), k % 4).alias("name"), k.alias("ord"), control.literal_type(_pick(k, "template_string", "float", "list", "true", "call")).alias("type"))
    uses = t.orders.select(k.alias("use"), F.concat(f, F.lit(".K.m")).alias("scope"), F.concat(F.lit("v"), k * 7 % 5).alias("name"), k.alias("ord"))
    return flow.type_environment(said, uses).select("use", "type")


_TEXTS = {
    "ts": "import { a } from './a';\nimport 'side';\nexport abstract class Box extends Base {\n  constructor(x) {\n  }\n  private async open(x: number): Promise<void> {\n    if (x) {\n    }\n  }\n}\n// class No {}\nexport interface Shape {}\nexport type Id = string;\nexport const run = async (x) => {\n};\nasync function* walk() {}\nconst q = require('q');\nenum Kind { A }\n",
    "java": "package p;\nimport java.util.List;\nimport static a.B.*;\npublic final class Car {\n    public List<String> drive(int a, int b) throws IOException {\n        return null;\n    }\n}\ninterface Road {\n}\nenum Gear { P }\n",
    "go": "package main\nimport \"fmt\"\nimport (\n\t\"os\"\n\tx \"a/b\"\n)\ntype Car struct {\n}\ntype Road interface {\n}\ntype Id string\nfunc (c *Car) Drive(a int) error {\n}\nfunc main() {\n}\n",
}
_NAMED = [
    ("ts", "Box", "class", 3), ("ts", "constructor", "constructor", 4), ("ts", "open", "method", 6), ("ts", "Shape", "interface", 12), ("ts", "Id", "type_alias", 13), ("ts", "run", "function", 14), ("ts", "walk", "function", 16), ("ts", "Kind", "enum", 18),
    ("java", "Car", "class", 4), ("java", "drive", "method", 5), ("java", "Road", "interface", 9), ("java", "Gear", "enum", 11), ("go", "Car", "struct", 7), ("go", "Road", "interface", 9), ("go", "Id", "type_alias", 11), ("go", "Drive", "method", 12), ("go", "main", "function", 14),
]
_IMPORTED = [("ts", "./a", 1), ("ts", "side", 2), ("ts", "q", 17), ("java", "java.util.List", 2), ("java", "a.B.*", 3), ("go", "fmt", 2), ("go", "os", 4), ("go", "a/b", 5)]


def _texts(t):
    held = t.spark.createDataFrame(list(_TEXTS.items()), "ext string, content string")  # a row for each language
    return t.supplier.crossJoin(F.broadcast(held)).select(F.concat(F.lit("src/f"), "s_suppkey", F.lit("."), "ext").alias("file_path"), "content")


@query("s6_line_symbols", f"SELECT 'src/f' || s_suppkey || '.' || ext AS file_path, name, kind, CAST(line AS INTEGER) AS line FROM supplier, {_values([(e, n, k, str(at)) for e, n, k, at in _NAMED], 'ext', 'name', 'kind', 'line')}")
def _(t):
    return line_symbols.symbols(_texts(t))


@query("s6_line_imports", f"SELECT 'src/f' || s_suppkey || '.' || ext AS file_path, source, CAST(line AS INTEGER) AS line FROM supplier, {_values([(e, n, str(at)) for e, n, at in _IMPORTED], 'ext', 'source', 'line')}")
def _(t):
    return line_symbols.imports(_texts(t))


def _classes(t):
    """file_path, content: a class for each order with a method for each of its lines, in the order of the lines."""
    of = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    method = lambda x, i: F.concat(F.lit("  m"), i + 1, F.lit("(a, b) { /* f( */ s"), x["l_suppkey"], F.lit('("x(", a);\n  }\n'))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit("import { h"), c % 7, F.lit(" as g } from './c"), c, F.lit("';\nexport class C"), k, F.lit(" extends B"), c % 50, F.lit("\n  implements I"), c % 3, F.lit(" { // no(\n"),
        F.coalesce(F.array_join(F.transform("lines", method), ""), F.lit("")), F.lit("}\n"),
    )
    return t.orders.join(of, "o_orderkey", "left").select(F.concat(F.lit("src/o"), k, F.lit(".ts")).alias("file_path"), text.alias("content"))


@query(
    "s6_code_facts",
    """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, l_suppkey AS s FROM lineitem), n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey),
        o AS (SELECT o_orderkey AS k, o_custkey AS c, 'src/o' || o_orderkey || '.ts' AS f, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON k = o_orderkey),
        r AS (SELECT 'import' AS fact, f AS file_path, './c' || c AS name, NULL AS kind, 1 AS line, NULL AS end_line, NULL AS owner, NULL AS detail, NULL AS n, NULL AS exported FROM o
            UNION ALL SELECT 'imported', f, 'h' || (c % 7), NULL, 1, NULL, './c' || c, 'g', NULL, NULL FROM o
            UNION ALL SELECT 'symbol', f, 'C' || k, 'class', 2, 4 + 2 * n, NULL, NULL, NULL, true FROM o
            UNION ALL SELECT 'heritage', f, 'B' || (c % 50), 'extends', 2, NULL, 'C' || k, NULL, NULL, NULL FROM o UNION ALL SELECT 'heritage', f, 'I' || (c % 3), 'implements', 3, NULL, 'C' || k, NULL, NULL, NULL FROM o
            UNION ALL SELECT 'symbol', f, 'm' || r, 'method', 2 + 2 * r, 3 + 2 * r, 'C' || k, NULL, 2, false FROM o JOIN l USING (k) UNION ALL SELECT 'call', f, 's' || s, NULL, 2 + 2 * r, NULL, 'C' || k || '.m' || r, NULL, 2, NULL FROM o JOIN l USING (k))
        SELECT fact, file_path, name, kind, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line, owner, detail, CAST(n AS INTEGER) AS n, exported FROM r""",
)
def _(t):
    return brace_code.facts(_classes(t))


def _programs(t):
    """A function for each customer, in TypeScript, Java or Go by its number; a statement for each order, by its status and key."""
    go, java = F.col("o_custkey") % 3 == 2, F.col("o_custkey") % 3 == 1
    k, end = F.col("o_orderkey").cast("string"), F.when(go, "\n").otherwise(";\n")
    paren = lambda word, x: F.concat(F.lit(word), F.when(go, " ").otherwise(" ("), x, F.when(go, " {\n").otherwise(") {\n"))
    loop = F.when(go, paren("for", F.lit("more(x)"))).otherwise(paren("while", F.lit("more(x)")))
    statement = (
        F.when(F.col("o_orderstatus") == "F", F.concat(paren("if", F.concat(F.lit("x > "), k)), F.lit("x = cut(x)"), end, F.lit("}\n")))
        .when(F.col("o_orderstatus") == "O", F.concat(loop, F.lit("x = x - 1"), end, F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("break"), end)).otherwise(""), F.lit("}\n")))
        .otherwise(F.concat(F.lit("x = y.next(x, "), k, F.lit(")"), end))
    )
    body = F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", statement.alias("s"))))["s"], "")
    rows = t.orders.groupBy("o_custkey").agg(body.alias("body"))
    name = F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    head = F.when(go, F.concat(F.lit("func "), name, F.lit("(x int, y T) int {\n"))).when(java, F.concat(F.lit("class K {\npublic int "), name, F.lit("(int x, T y) {\n"))).otherwise(F.concat(F.lit("export function "), name, F.lit("(x: number, y: T) {\n")))
    content = F.concat(head, "body", F.lit("return x\n}\n"), F.when(java, "}\n").otherwise(""))
    return rows.select(F.concat(name, F.when(go, ".go").when(java, ".java").otherwise(".ts")).alias("file_path"), content.alias("content"))


_PROGRAMS = """n AS (SELECT o_custkey AS c, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 0) AS b, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS p FROM orders GROUP BY o_custkey),
    named AS (SELECT *, 'f' || c || CASE c % 3 WHEN 2 THEN '.go:' WHEN 1 THEN '.java:K.' ELSE '.ts:' END || 'f' || c AS fn FROM n)"""


@query("g16_brace_blocks", f"WITH {_PROGRAMS} SELECT fn, f + o + 1 AS cyclomatic, 3 + 4 * f + 3 * o AS n_blocks, f + o AS branches, o AS loops, b AS breaks, o - b AS backs FROM named")
def _(t):
    blocks, edges = python_ast.blocks(cut(brace_flow.facts(_programs(t)).where("fact IN ('block', 'block_edge')")))
    counted = blocks.groupBy("fn").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind").isin("branch", "loop_header")).alias("branches"), F.count_if(F.col("kind") == "loop_exit").alias("loops"))
    left = edges.groupBy("fn").agg(F.count_if(F.col("kind") == "break").alias("breaks"), F.count_if(F.col("kind") == "back").alias("backs"))
    return metrics.cyclomatic(blocks, edges).join(counted, "fn").join(left, "fn")


@query("g17_brace_flow", f"WITH {_PROGRAMS} SELECT fn, 3 + 2 * (f + o + p) AS n_nodes, f + o + p AS assignments, 2 * (f + o + p) + p + 1 AS n_edges, f + o + p AS bound, p AS fields FROM named")
def _(t):
    nodes, edges = python_ast.data_flow(cut(brace_flow.facts(_programs(t)).where("fact IN ('flow_node', 'flow_edge')")))
    made = nodes.groupBy("fn").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kind") == "assignment").alias("assignments"))
    return made.join(edges.groupBy("fn").agg(F.count("*").alias("n_edges"), F.count_if(F.col("kind") == "param_bind").alias("bound"), F.count_if(F.col("kind") == "field_flow").alias("fields")), "fn")
