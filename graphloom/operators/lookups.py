"""Filters, lookups and first-match joins over nodes (id, ord, kind, name, ...) and edges (src, dst, kind, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities from least to most.
SEVERITIES = ("low", "medium", "high", "critical")


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes whose name or qualified name is name."""
    return nodes.where((F.col("name") == name) | (F.col("qualified_name") == name))


def at_line(nodes: DataFrame, file_path: str, line: int) -> DataFrame:
    """Nodes of a file that contain a line; a null end is open."""
    return nodes.where((F.col("file_path") == file_path) & (F.col("start_line") <= line) & (F.col("end_line").isNull() | (F.col("end_line") >= line)))


def neighbours(edges: DataFrame, node_id, kind: str | None = None) -> DataFrame:
    """Distinct ids that an edge joins to node_id, in either direction."""
    some = edges if kind is None else edges.where(F.col("kind") == kind)
    out = some.where(F.col("src") == node_id).select(F.col("dst").alias("id"))
    return out.union(some.where(F.col("dst") == node_id).select("src")).distinct()


def without_node(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without the nodes of gone (id), and without the edges that touch them."""
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(edges.columns)


def substring_search(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """The first limit nodes, by ord, whose name or qualified name contains text in any case."""
    q = text.lower()
    return nodes.where(F.lower("name").contains(q) | F.lower("qualified_name").contains(q)).orderBy("ord").limit(limit)


def suggest(nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Exact matches, then prefixes, then the rest that contain text; ord breaks ties; 1 to 30 rows."""
    q, name = text.lower(), F.lower("name")
    tier = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(q) | F.lower("qualified_name").contains(q), 2)
    found = nodes.where(~F.col("kind").isin("import", "export")).withColumn("tier", tier).where("tier IS NOT NULL")
    return found.orderBy("tier", "ord").limit(min(30, max(1, limit)))


def seeds(nodes: DataFrame, text: str, most: int = 5, fallback: int = 10) -> DataFrame:
    """Where a search begins: the first `most` nodes of that name, else the first `fallback` whose name or qualified name holds text."""
    exact = by_name(nodes, text).orderBy("ord").limit(most).withColumn("tier", F.lit(0))
    both = exact.unionByName(substring_search(nodes, text, fallback).withColumn("tier", F.lit(1)))
    best = F.min("tier").over(Window.partitionBy())  # at most most + fallback rows
    return both.withColumn("best", best).where("tier = best").drop("tier", "best")


#: Severities of flows from least to most.
FLOW_SEVERITIES = ("info", "warning", "critical")


def flow_filter(flows: DataFrame, least: str = "info", prefix: str = "") -> DataFrame:
    """Flows (severity, first_path) of at least that severity whose first step lies under the path prefix."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(FLOW_SEVERITIES):
        rank = F.when(F.col("severity") == name, i).otherwise(rank)
    return flows.where((rank >= FLOW_SEVERITIES.index(least)) & F.col("first_path").startswith(prefix))


def finding_filter(findings: DataFrame, least: str = "low", path: str = "") -> DataFrame:
    """Findings (severity, source_path, sink_path) of at least that severity with path in either of the two."""
    hit = F.coalesce(F.col("source_path").contains(path), F.lit(False)) | F.coalesce(F.col("sink_path").contains(path), F.lit(False))
    return findings.where((severity_rank(F.col("severity")) >= SEVERITIES.index(least)) & hit)


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == name, i).otherwise(out)
    return out


def first_match(refs: DataFrame, ref_name: str, nodes: DataFrame) -> DataFrame:
    """refs with target: the id of the node of that name with the least ord, null if none."""
    first = nodes.groupBy(F.col("name").alias("__name")).agg(F.min_by("id", "ord").alias("target"))
    return refs.join(first, F.col(ref_name) == F.col("__name"), "left").drop("__name")


#: Spans of a file near one place, up to which a file's points meet all of them.
NEAR = 64


def enclosing(points: DataFrame, nodes: DataFrame, width: int = 64) -> DataFrame:
    """points (point, file_path, line) with the id of the smallest node of the file that contains the line.

    Kinds: function, method, class and module; ties go to the lesser ord.  Where no width
    lines of a file have more than NEAR nodes, a range join on buckets of width lines, so
    that a file's points meet only the nodes near them.  Otherwise each node is cut into
    blocks of 1, 2, 4, ... lines, a block keeps its smallest node, and each line asks the
    blocks around it: rows grow with the logarithm of the longest node, however many overlap.
    """
    kinds = nodes.where(F.col("kind").isin("function", "method", "class", "module") & F.col("end_line").isNotNull() & (F.col("end_line") >= F.col("start_line")))
    bucket = lambda c: F.expr(f"{c} div {width}")
    spans = kinds.select(F.col("file_path").alias("f"), "start_line", "end_line", "id", "ord")
    near = spans.withColumn("b", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))))
    facts = near.groupBy("f", "b").agg(F.count("*").alias("n"), F.max(F.col("end_line") - F.col("start_line")).alias("lines")).agg(F.max("n").alias("n"), F.max("lines").alias("lines")).first()
    if (facts["n"] or 0) > NEAR:
        best = _smallest(points.select("file_path", "line").where("file_path IS NOT NULL AND line IS NOT NULL").distinct(), spans, int(facts["lines"] + 1).bit_length())
        return points.join(best, ["file_path", "line"], "left").select(*points.columns, "symbol_id")
    at = points.withColumn("b", bucket("line"))
    hits = at.join(near, (at["file_path"] == near["f"]) & (at["b"] == near["b"]) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = hits.groupBy("point").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), "ord")).alias("symbol_id"))
    return points.join(best, "point", "left")


def _smallest(lines: DataFrame, spans: DataFrame, levels: int) -> DataFrame:
    """file_path, line, symbol_id for distinct lines within any span; levels: more than the logarithm of the longest."""
    # blocks k of 2**k lines that make up a span exactly: at most two of each size, the odd ones at its ends
    first, end = F.col("start_line").cast("long"), F.col("end_line").cast("long") + 1
    a, z = [F.shiftright(first + ((1 << k) - 1), k) for k in range(levels)], [F.shiftright(end, k) for k in range(levels)]
    block = lambda k, b, odd: F.when((a[k] < z[k]) & (odd.bitwiseAND(F.lit(1)) == 1), F.struct(F.lit(k).alias("k"), b.alias("b")))
    pieces = F.array_compact(F.array(*[x for k in range(levels) for x in (block(k, a[k], a[k]), block(k, z[k] - 1, z[k]))]))
    few = spans.where("f IS NOT NULL").groupBy("f", "start_line", "end_line").agg(F.min(F.struct("ord", "id")).alias("x"))
    cover = few.select("f", F.struct((F.col("end_line") - F.col("start_line")).alias("lines"), "x.ord", "x.id").alias("x"), F.explode(pieces).alias("p")).groupBy("f", "p.k", "p.b").agg(F.min("x").alias("x"))
    ask = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(F.col("line").cast("long"), k).alias("b")) for k in range(levels)])
    asked = lines.select(F.col("file_path").alias("f"), "line", F.explode(ask).alias("p")).select("f", "line", "p.k", "p.b")
    return asked.join(cover, ["f", "k", "b"]).groupBy(F.col("f").alias("file_path"), "line").agg(F.min("x")["id"].alias("symbol_id"))


# How sure each way of resolving a call is.
CONFIDENCE = {"same_file": 0.95, "import_scoped": 0.9, "type_narrowed": 0.85, "global": 0.5}
CALLABLE = ("function", "method", "constructor")


def resolve_calls(calls: DataFrame, nodes: DataFrame, imports: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """calls with target, tier and confidence; the first tier that finds a node decides, target null if none does.

    calls: call, file_path, callee and, where known, receiver and n_args.  nodes: id, ord,
    kind, name, qualified_name, file_path, exported and, where known, owner and n_params.
    imports: file_path, name (local), qualified_name.  types: file_path, receiver, type.

    same_file: a callable of the name.  import_scoped: what the name was imported as, else
    the method of the imported receiver.  type_narrowed: the method of a class, interface or
    struct that bears the name of the receiver's type.  global: the only exported callable of
    the name; else one that takes as many arguments, of the exported ones if there are any;
    else the first exported, else the first.
    """
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    own = calls.withColumns({c: v for c, v in (("receiver", text), ("n_args", number)) if c not in calls.columns})
    nodes = nodes.withColumns({c: v for c, v in (("owner", text), ("n_params", number)) if c not in nodes.columns})
    usable = nodes.where(F.col("kind").isin(*CALLABLE))
    same = usable.groupBy("file_path", F.col("name").alias("callee")).agg(F.min_by("id", "ord").alias("same_file"))
    # of nodes with one qualified name the last counts
    known = nodes.groupBy("qualified_name").agg(F.max_by(F.struct("id", "name", "file_path"), "ord").alias("q"))
    local = imports.groupBy("file_path", "name").agg(F.max("qualified_name").alias("qualified_name")).join(known, "qualified_name").select("file_path", "name", "q")
    direct = local.select("file_path", F.col("name").alias("callee"), F.col("q.id").alias("imported"))
    method = nodes.where(F.col("kind").isin("method", "function") & F.col("owner").isNotNull())
    method = method.groupBy(F.col("file_path").alias("m_file"), F.col("owner").alias("m_owner"), F.col("name").alias("callee")).agg(F.min_by("id", "ord").alias("method"))
    on = local.select("file_path", F.col("name").alias("receiver"), F.col("q.file_path").alias("m_file"), F.col("q.name").alias("m_owner"))
    through = on.join(method, ["m_file", "m_owner"]).select("file_path", "receiver", "callee", F.col("method").alias("through"))
    rows = own.join(same, ["file_path", "callee"], "left").join(direct, ["file_path", "callee"], "left").join(through, ["file_path", "receiver", "callee"], "left")
    if types is None:
        rows = rows.withColumn("narrowed", F.lit(None).cast(nodes.schema["id"].dataType))
    else:
        owners = nodes.where(F.col("kind").isin("class", "interface", "struct")).select(F.col("name").alias("type"), F.col("file_path").alias("m_file"), F.col("name").alias("m_owner"), "ord")
        narrowed = owners.join(method, ["m_file", "m_owner"]).groupBy("type", "callee").agg(F.min_by("method", "ord").alias("narrowed"))
        said = types.groupBy("file_path", "receiver").agg(F.max("type").alias("type"))
        rows = rows.join(said, ["file_path", "receiver"], "left").join(narrowed, ["type", "callee"], "left")
    out = usable.where("exported").groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n_out"), F.min_by("id", "ord").alias("first_out"))
    # without an exported callable any node of the name may fit by its parameters
    pool = nodes.join(out.select(F.col("callee").alias("name"), "n_out"), "name", "left").where(F.col("n_out").isNull() | (F.col("exported") & F.col("kind").isin(*CALLABLE)))
    fitting = pool.where("n_params IS NOT NULL").groupBy(F.col("name").alias("callee"), F.col("n_params").alias("n_args")).agg(F.min_by("id", "ord").alias("fitting"))
    every = usable.groupBy(F.col("name").alias("callee")).agg(F.min_by("id", "ord").alias("first_any"))
    rows = rows.join(out, "callee", "left").join(fitting, ["callee", "n_args"], "left").join(every, "callee", "left")
    anywhere = F.coalesce(F.when(F.col("n_out") == 1, F.col("first_out")), "fitting", "first_out", "first_any")
    found = {"same_file": F.col("same_file"), "import_scoped": F.coalesce("imported", "through"), "type_narrowed": F.col("narrowed"), "global": anywhere}
    tier = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in found.items()])
    sure = F.coalesce(*[F.when(v.isNotNull(), F.lit(CONFIDENCE[k])) for k, v in found.items()])
    return rows.select(*calls.columns, F.coalesce(*found.values()).alias("target"), tier.alias("tier"), sure.alias("confidence"))


def confident(calls: DataFrame, least: float = 0.8) -> DataFrame:
    """Calls that were resolved with at least that confidence."""
    return calls.where(F.col("confidence") >= least)


def orphans(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Callable nodes that nothing in calls (dst) calls."""
    return nodes.where(F.col("kind").isin(*CALLABLE)).join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def node_detail(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, siblings (others of its file), callers, callees, and name and kind of the callee with the least id; "?" and "unknown" where there is none."""
    calls = edges.where("kind = 'calls'")
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    outof = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"), F.min("dst").alias("callee"))
    files = nodes.groupBy("file_path").agg((F.count("*") - 1).alias("siblings"))
    names = nodes.select(F.col("id").alias("callee"), F.col("name").alias("callee_name"), F.col("kind").alias("callee_kind"))
    rows = nodes.select("id", "file_path").join(files, "file_path").join(into, "id", "left").join(outof, "id", "left").join(names, "callee", "left")
    none = F.lit(0).cast("long")
    return rows.select("id", "siblings", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"), F.coalesce("callee_name", F.lit("?")).alias("first_callee"), F.coalesce("callee_kind", F.lit("unknown")).alias("first_kind"))


def runtime_suggest(observed: DataFrame, nodes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """symbol, tier: observed symbols (source_key, last_seq) that hold text, newest first, then names of nodes; each once, 1 to 30 rows."""
    q = text.lower()
    seen = observed.where(F.lower("source_key").contains(q)).groupBy(F.col("source_key").alias("symbol")).agg(F.max("last_seq").alias("place"))
    named = nodes.where(F.lower("name").contains(q) | F.lower("qualified_name").contains(q)).groupBy(F.col("name").alias("symbol")).agg(F.min("ord").alias("place"))
    rows = seen.select("symbol", F.lit(0).alias("tier"), (-F.col("place")).alias("place")).unionByName(named.join(seen, "symbol", "left_anti").select("symbol", F.lit(1).alias("tier"), "place"))
    return rows.orderBy("tier", "place").limit(min(30, max(1, limit)))


def resolve_runtime(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (ref, node_id, symbol, file_path, line) with node: by id, else exact name, else name in any case, else the first node that starts at the file and line."""
    by_id = nodes.select(F.col("id").alias("node_id"), F.col("id").alias("n1"))
    exact = nodes.groupBy(F.col("name").alias("symbol")).agg(F.min_by("id", "ord").alias("n2"))
    loose = nodes.groupBy(F.lower("name").alias("__lower")).agg(F.min_by("id", "ord").alias("n3"))
    place = nodes.groupBy("file_path", F.col("start_line").alias("line")).agg(F.min_by("id", "ord").alias("n4"))
    rows = refs.join(by_id, "node_id", "left").join(exact, "symbol", "left").join(loose, F.lower("symbol") == F.col("__lower"), "left").join(place, ["file_path", "line"], "left")
    return rows.select(*refs.columns, F.coalesce("n1", "n2", "n3", "n4").alias("node"))


def symbol_table(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node of each qualified name (the last), the nodes of each name, and the first of each file and name."""
    by_qualified = nodes.groupBy("qualified_name").agg(F.max_by("id", "ord").alias("id"))
    by_name = nodes.select("name", "id", "ord")
    return by_qualified, by_name, nodes.groupBy("file_path", "name").agg(F.min_by("id", "ord").alias("id"))


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row, in order, of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest(rows: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The n rows of each key with the greatest order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both; of those with one key the last in order (fresh after stored) stays."""
    both = stored.withColumn("__fresh", F.lit(0)).unionByName(fresh.withColumn("__fresh", F.lit(1)))
    return keep_first(both, key, [F.desc("__fresh"), F.desc(order)]).drop("__fresh")


def resolved_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends, and the number dropped of each kind."""
    whole = F.coalesce(F.col("src").cast("string") != "", F.lit(False)) & F.coalesce(F.col("dst").cast("string") != "", F.lit(False))
    return edges.where(whole), edges.where(~whole).groupBy("kind").agg(F.count("*").alias("dropped"))
