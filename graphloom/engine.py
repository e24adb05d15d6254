"""One object for a repository's graph and what can be asked of it; every answer is a DataFrame.

    engine = Engine.analyze(spark, "/src/project")        # or Engine.load(spark, path)
    engine.impact("parse_config").show()
    engine.search("read settings", limit=10).show()
    engine.save("/data/project")

Nodes: id, ord, kind, name, qualified_name, file_path, start_line, end_line, exported,
is_test, signature, cyclomatic.  Edges: src, dst, kind, ord, confidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import rules
from .operators import branches, control, flow, lookups, metrics, modules, schema, text, traversal
from .plans.lineage import cut
from .sources import brace_code, brace_flow, files, parsed, python_ast


@dataclass
class Engine:
    nodes: DataFrame
    edges: DataFrame
    sources: DataFrame | None = None  # file_path, content

    # building, keeping

    @classmethod
    def analyze(cls, spark: SparkSession, root: str, cache: str | None = None) -> Engine:
        """Walk root, parse what has a parser, and resolve calls, imports and heritage.

        cache: a path where facts are kept by content; then only files that are new or have
        changed since are parsed.  Names are resolved anew, by joins of all facts.
        """
        return cls.from_sources(files.walk(spark, root).select("file_path", "content"), cache)

    @classmethod
    def from_sources(cls, sources: DataFrame, cache: str | None = None) -> Engine:
        facts = parsed.facts(sources, python_ast.facts, cache and f"{cache}/python")
        node_id = lambda *c: F.xxhash64(*c)
        blocks, block_edges = python_ast.blocks(facts)
        cc = metrics.cyclomatic(blocks, block_edges)
        flow_nodes, flow_edges = python_ast.data_flow(facts)
        params = flow_nodes.where("kind = 'param'").groupBy("fn").agg(F.count("*").cast("int").alias("n_params"))
        symbols = python_ast.symbols(facts).withColumn("fn", F.concat_ws(":", "file_path", "qualified_name")).join(cc, "fn", "left").join(params, "fn", "left")
        test = F.substring_index("file_path", "/", -1).rlike(r"^test_|_test\.py$") & F.col("name").rlike("^test_|^Test")
        named = symbols.select(
            node_id("file_path", "qualified_name").alias("id"), "kind", "name", "qualified_name", "file_path", F.col("line").alias("start_line"), "end_line",
            (~F.col("name").startswith("_")).alias("exported"), test.alias("is_test"), F.col("name").alias("signature"), F.col("cyclomatic").cast("int").alias("cyclomatic"),
            F.when(F.col("kind") == "method", F.regexp_extract("qualified_name", r"([^.]+)\.[^.]+$", 1)).alias("owner"),
            F.when(F.col("kind").isin("function", "method"), F.coalesce("n_params", F.lit(0)) - F.when(F.col("kind") == "method", 1).otherwise(0)).alias("n_params"),
        )
        braces = parsed.facts(sources, brace_code.facts, cache and f"{cache}/braces")  # the other languages
        of = F.concat_ws(".", "owner", "name")
        brace_cc = metrics.cyclomatic(*python_ast.blocks(parsed.facts(sources, brace_flow.facts, cache and f"{cache}/brace_flow")))
        told = braces.where("fact = 'symbol'").withColumn("fn", F.concat_ws(":", "file_path", of)).join(brace_cc, "fn", "left")
        test = F.col("file_path").rlike(r"(?:[._](?:test|spec)\.|Tests?\.java$|_test\.go$|/__tests__/)")
        named = named.unionByName(told.select(
            node_id("file_path", of).alias("id"), "kind", "name", of.alias("qualified_name"), "file_path", F.col("line").alias("start_line"), "end_line", "exported", test.alias("is_test"),
            F.col("name").alias("signature"), F.col("cyclomatic").cast("int").alias("cyclomatic"), "owner", F.col("n").alias("n_params"),
        ))
        none = F.lit(None)
        whole = sources.select(
            node_id("file_path", F.lit("")).alias("id"), F.lit("file").alias("kind"), F.substring_index("file_path", "/", -1).alias("name"), F.col("file_path").alias("qualified_name"), "file_path",
            F.lit(1).alias("start_line"), none.cast("int").alias("end_line"), F.lit(True).alias("exported"), F.lit(False).alias("is_test"), none.cast("string").alias("signature"), none.cast("int").alias("cyclomatic"),
            none.cast("string").alias("owner"), none.cast("int").alias("n_params"),
        )
        nodes = cut(whole.unionByName(named).dropDuplicates(["id"]).withColumn("ord", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id")).cast("long")))
        owner = F.regexp_replace("qualified_name", r"\.?[^.]+$", "")
        contains = named.select(node_id("file_path", owner).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
        made = facts.where("fact = 'call'").select(
            "file_path", F.regexp_extract("name", r"([^.]+)$", 1).alias("callee"), F.regexp_extract("name", r"^([A-Za-z_]\w*)\.[^.]+$", 1).alias("receiver"), F.col("detail").cast("int").alias("n_args"),
            "owner", node_id("file_path", "owner").alias("src"),
        )
        made = made.unionByName(braces.where("fact = 'call'").select("file_path", F.col("name").alias("callee"), F.coalesce("detail", F.lit("")).alias("receiver"), F.col("n").alias("n_args"), F.coalesce("owner", F.lit("")).alias("owner"), node_id("file_path", F.coalesce("owner", F.lit(""))).alias("src")))
        # self is of the class that the calling method is in; a name that a class is called into is of that class
        selves = made.where("receiver IN ('self', 'cls', 'this')").select("file_path", F.concat_ws("@", "receiver", "owner").alias("receiver"), F.regexp_extract("owner", r"([^.]+)\.[^.]+$", 1).alias("type")).where("type <> ''")
        source, target = flow_nodes.where("kind = 'call'").select(F.col("id").alias("src"), F.regexp_extract("code", r"^(?:\w+\.)*([A-Z]\w*)\(", 1).alias("type")), flow_nodes.where("kind = 'assignment'").select(F.col("id").alias("dst"), F.col("code").alias("receiver"))
        built = flow_edges.join(source, "src").join(target, "dst").where("type <> ''").select("file_path", "receiver", "type")
        types = selves.unionByName(built).distinct()
        made = made.withColumn("receiver", F.when(F.col("receiver").isin("self", "cls", "this"), F.concat_ws("@", "receiver", "owner")).otherwise(F.col("receiver"))).drop("owner")
        imported = facts.where("fact = 'import'").select("file_path", F.col("detail").alias("name"), F.regexp_replace("name", r"^[^:]*:", "").alias("qualified_name"))
        imported = imported.unionByName(braces.where("fact = 'imported' AND name NOT IN ('*', 'default')").select("file_path", F.col("detail").alias("name"), F.col("name").alias("qualified_name")))
        found = lookups.resolve_calls(made, nodes, imported, types).where("target IS NOT NULL")
        calls = found.select("src", F.col("target").alias("dst"), F.lit("calls").alias("kind"), "confidence")
        bases = facts.where("fact = 'heritage'").select(node_id("file_path", "owner").alias("src"), "name", F.lit("extends").alias("how"))
        bases = bases.unionByName(braces.where("fact = 'heritage'").select(node_id("file_path", "owner").alias("src"), "name", F.col("kind").alias("how")))
        extends = lookups.first_match(bases, "name", nodes.where("kind IN ('class', 'interface')")).where("target IS NOT NULL").select("src", F.col("target").alias("dst"), F.col("how").alias("kind"), F.lit(0.9).alias("confidence"))
        path = F.concat(F.lit("/"), F.translate(F.regexp_replace(F.regexp_replace("name", ":.*$", ""), r"^\.+", ""), ".", "/"), F.lit(".py"))
        wants = facts.where("fact = 'import'").select(node_id("file_path", F.lit("")).alias("src"), path.alias("tail")).where("tail <> '/.py'")
        tails = sources.select(node_id("file_path", F.lit("")).alias("dst"), F.split(F.concat(F.lit("/"), "file_path"), "/").alias("p"))
        ends = tails.select("dst", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("p", -i, i), "/")))).alias("tail"))
        imports = wants.join(ends, "tail").select("src", "dst", F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence")).distinct()
        paths = modules.resolve_paths(braces.where("fact = 'import'").select(F.col("file_path").alias("from_file"), F.col("name").alias("source")).distinct(), sources)
        near = paths.join(sources.select(F.col("file_path").alias("resolved")), "resolved").select(node_id("from_file", F.lit("")).alias("src"), node_id("resolved", F.lit("")).alias("dst"), F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence"))
        imports = imports.unionByName(near).distinct()
        edges = contains.unionByName(calls).unionByName(extends).unionByName(imports)
        edges = edges.where("src <> dst").withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy("kind", "dst")).cast("long"))
        return cls(nodes, cut(edges), sources)

    def save(self, path: str) -> None:
        for name, df in (("nodes", self.nodes), ("edges", self.edges), ("sources", self.sources)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "sources")))

    # questions

    def _seeds(self, name: str) -> DataFrame:
        """The first node of that name, else the first whose name contains it."""
        exact = lookups.by_name(self.nodes, name).orderBy("file_path", "ord").limit(1).select("id")
        return exact if not exact.isEmpty() else lookups.substring_search(self.nodes, name, 1).select("id")

    def _named(self, found: DataFrame) -> DataFrame:
        return found.join(self.nodes.select("id", "kind", "name", "qualified_name", "file_path", "start_line"), "id")

    def status(self) -> DataFrame:
        return self.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))

    def search(self, query: str, limit: int = 20, mode: str = "hybrid") -> DataFrame:
        docs = self.nodes.where("kind <> 'file'").select(F.col("id").alias("node_id"), "name", "qualified_name", "file_path")
        found = {"hybrid": text.hybrid, "keyword": text.bm25, "semantic": text.tfidf}[mode](docs, query, limit)
        return self._named(found.withColumnRenamed("node_id", "id"))

    def trace(self, name: str, depth: int = 5, direction: str = "forward", kinds: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
        nodes, used, _ = traversal.trace(self.edges, self._seeds(name), depth, direction, kinds)
        return self._named(nodes), used

    def impact(self, name: str, depth: int = 3) -> DataFrame:
        return self._named(traversal.impact(self.edges, self._seeds(name), depth))

    def context(self, name: str, depth: int = 2) -> DataFrame:
        seed = self._seeds(name).first()
        return self._named(traversal.context(self.edges, seed["id"], depth)) if seed else self._named(self.nodes.where("false").select("id"))

    def callers(self, name: str) -> DataFrame:
        return self._named(traversal.transitive_callers(self.edges, self._seeds(name)).select("id", "depth"))

    def suggest(self, prefix: str, limit: int = 10) -> DataFrame:
        return lookups.suggest(self.nodes, prefix, limit)

    def processes(self) -> DataFrame:
        entries = self.nodes.where(rules.entry_type(F.col("name"), F.coalesce("signature", F.lit(""))).isNotNull()).select("id")
        return self._named(traversal.processes(self.edges, entries))

    def communities(self) -> DataFrame:
        some = self.edges.where("kind IN ('calls', 'data_flow')").select("src", "dst", F.when(F.col("kind") == "calls", 1.0).otherwise(2.0).alias("weight"))
        members = self._named(flow.label_propagation(some)).join(self.nodes.select("id", "ord"), "id")
        return members.join(control.community_labels(members), "community")

    def test_links(self) -> DataFrame:
        return traversal.test_links(self.edges, self.nodes)

    def test_impact(self, changed: DataFrame) -> DataFrame:
        return traversal.test_impact(self.test_links(), self.edges, changed)

    def test_gaps(self) -> DataFrame:
        covered = self.test_links().select(F.col("prod").alias("id")).distinct()
        return self.nodes.where("NOT is_test AND kind IN ('function', 'method')").join(covered, "id", "left_anti")

    def coverage(self) -> DataFrame:
        return metrics.coverage(self.nodes.where("kind IN ('function', 'method')"), self.test_links())

    def coupling(self) -> DataFrame:
        return metrics.coupling(self.nodes, self.edges)

    def risk(self, churn: DataFrame | None = None) -> DataFrame:
        """score, level, factors and advice of every function and method; churn: file, recent_commits."""
        some = self.nodes.where("kind IN ('function', 'method', 'constructor')")
        links = self.test_links().groupBy(F.col("prod").alias("id")).agg(F.count_if(F.col("link") == "direct").alias("direct"), F.count_if(F.col("link") == "transitive").alias("transitive"))
        rows = some.join(links, "id", "left").join(traversal.blast_buckets(self.edges, some.select("id")), "id", "left")
        recent = F.lit(None).cast("long")
        if churn is not None:
            rows = rows.join(churn.select(F.col("file").alias("file_path"), "recent_commits"), "file_path", "left")
            recent = F.col("recent_commits")
        zero = F.lit(0)
        return metrics.risk(
            rows.select(
                "id", "name", "file_path", metrics.complexity_bucket(F.col("cyclomatic")).alias("complexity"),
                metrics.test_bucket(F.coalesce("direct", zero), F.coalesce("transitive", zero), F.lit(True)).alias("testCoverage"), metrics.sensitivity(F.col("name"), zero, zero).alias("dataSensitivity"),
                F.coalesce("blast", zero).alias("blastRadius"), metrics.velocity_bucket(recent).alias("changeVelocity"), metrics.error_bucket(F.col("cyclomatic")).alias("errorHandling"),
            )
        )

    def hotspots(self, limit: int = 20) -> DataFrame:
        return self.risk().orderBy(F.desc("score"), "id").limit(limit)

    def findings(self) -> DataFrame:
        if self.sources is None:
            raise ValueError("this graph was made without its sources")
        return text.scan_lines(self.sources.where(files.scannable(F.col("file_path")))).withColumn("fix", control.suggest_fix(F.col("category")))

    def flows(self) -> DataFrame:
        """fn, source and sink (code and line), category, sanitized, length, severity: untrusted data that reaches what it must not, within functions of Python and of brace_code's languages."""
        if self.sources is None:
            raise ValueError("this graph was made without its sources")
        nodes, edges = python_ast.data_flow(cut(python_ast.facts(self.sources).unionByName(brace_flow.facts(self.sources))))
        code, call = F.col("code"), F.col("kind").isin("call", "field", "assignment", "return")
        marked = nodes.select(
            "id", "fn", F.col("node").alias("ord"), "code", "line", (rules.first_of(code, rules.SOURCES).isNotNull() & call).alias("is_source"), rules.first_of(code, rules.SINKS).alias("category"),
            rules.any_of(code, rules.SANITIZERS).alias("is_sanitizer"),
        ).withColumn("is_sink", F.col("category").isNotNull() & (F.col("code") != ""))
        marked = cut(marked)
        found = flow.taint(marked, edges)
        end = lambda name, *more: marked.select(F.col("id").alias(name), F.col("code").alias(f"{name}_code"), F.col("line").alias(f"{name}_line"), *more)
        return found.join(end("source"), "source").join(end("sink", "category"), "sink").drop("source", "sink")

    def security_score(self) -> DataFrame:
        return metrics.security_score(self.findings())

    def models(self) -> DataFrame:
        return schema.extract_models(self.nodes, self.edges)[0]

    @staticmethod
    def conflicts(items: DataFrame) -> DataFrame:
        return branches.detect(items).orderBy(F.desc("level"), "branch_a", "branch_b")

    def imports_of(self, imports: DataFrame) -> DataFrame:
        """imports (from_file, source) with the files they mean."""
        return modules.resolve_paths(imports, self.nodes.where("kind = 'file'").select("file_path"))
