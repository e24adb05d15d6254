"""Files as rows: walking, chunking, snippets, and findings of other scanners."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..plans.lineage import cut

# What a walk leaves out, as in an ignore file.
UNWALKED = (
    "node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", "coverage", "__pycache__", ".tox", "venv", ".venv", "target", "bin/Debug", "bin/Release", "obj", ".idea", ".vscode", ".DS_Store",
    "*.lock", "package-lock.json", "*.min.js", "*.min.css", "*.map", "*.d.ts",
)
# Folders the security scan does not enter, extensions it reads.
IGNORED = "node_modules|\\.git|dist|build|out|\\.next|\\.nuxt|coverage|__pycache__|vendor|\\.venv|venv"
SCANNED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".java", ".go", ".rs", ".rb", ".php", ".c", ".cpp", ".cs", ".kt", ".swift")
# Severities and categories of another scanner's findings.
SEVERITY = {"ERROR": "critical", "WARNING": "high", "INFO": "medium", "INVENTORY": "low"}
CATEGORY = [
    ("injection", "sql_injection"), ("sql-injection", "sql_injection"), ("xss", "xss"), ("command-injection", "command_injection"), ("path-traversal", "path_traversal"), ("ssrf", "ssrf"),
    ("open-redirect", "open_redirect"), ("deserialization", "insecure_deserialization"), ("crypto", "hardcoded_secret"), ("auth", "missing_auth"),
]


def ignored(path: Column, patterns) -> Column:
    """Whether a path from the root is left out by lines of an ignore file; of several that fit the last counts, and "!" takes back.

    A pattern with a slash before its end holds from the root, another at any depth; a
    name also covers all that a folder of it holds; "*" and "?" stay within a name, "**" does not.
    """
    out = F.lit(False)
    for line in patterns:
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        start = "^" if "/" in p else "(?:^|/)"
        p = p.lstrip("/")
        body = re.escape(p).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out = F.when(path.rlike(f"{start}{body}{'/' if folder else '(?:/|$)'}"), F.lit(not back)).otherwise(out)
    return out


def _small_file(spark: SparkSession, name: str) -> str:
    """The text of one small file, which may be hidden, as Spark's own readers do not see those; empty if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return ""
    stream = system.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def walk(spark: SparkSession, root: str, supported_only: bool = True, ignore=UNWALKED, respect_gitignore: bool = True, extra=(), most: int = 50_000) -> DataFrame:
    """file_path, length, content and language of the files under root that no pattern leaves out, at most `most`, by path; languages are told by path.

    Patterns: ignore, those of root's .gitignore, extra.  Contents are read for kept files only.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.removeprefix("file://").rstrip("/")
    path = F.regexp_replace("path", "^file:/*", "/")
    inside = F.expr("substring(file_path, " + str(len(prefix) + 2) + ")")
    own = _small_file(spark, f"{root.rstrip('/')}/.gitignore").split("\n") if respect_gitignore else []
    # paths and lengths only: no file is opened yet
    rows = found.select("path", path.alias("file_path"), "length").where(~ignored(inside, [*ignore, *own, *extra])).withColumn("language", rules.language(F.col("file_path")))
    rows = rows.where("language IS NOT NULL") if supported_only else rows
    chosen = rows.orderBy("file_path").limit(most).select("path", "file_path", "length", "language")
    names = [r["path"] for r in chosen.select("path").collect()]  # at most `most`
    if not names:
        return chosen.select("file_path", "length", F.lit("").alias("content"), "language")
    kept = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([_literal(x) for x in names])
    return kept.select(path.alias("file_path"), "length", F.col("content").cast("string").alias("content")).withColumn("language", rules.language(F.col("file_path")))


def _literal(path: str) -> str:
    """path as a pattern that fits itself only."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def scannable(path: Column) -> Column:
    """Whether the security scan reads a file: its extension, no ignored or hidden folder, .env apart."""
    name = F.substring_index(path, "/", -1)
    ends = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*SCANNED)
    return (ends & ~name.startswith(".") | (name == ".env")) & ~path.rlike(rf"(^|/)({IGNORED}|\.[^/]+)/")


def chunks(files: DataFrame, budget: int = 20 << 20, most: int = 512 << 10) -> DataFrame:
    """files (ord, length) with chunk: files in order fill chunks of budget bytes; larger files than most, which is at most budget, are left out.

    Where a chunk ends depends on where it began.  With the lengths summed up to each file,
    every file's next beginning is looked up as if a chunk began there; from the first
    file those pointers are doubled, so that chunks are found in as many rounds as their
    number has bits.  ord is distinct.
    """
    if most > budget:
        raise ValueError("a file may not be larger than a chunk")
    spark = files.sparkSession
    kept = files.where(F.col("length") <= most).select("ord", F.col("length").cast("long").alias("length"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(kept.repartitionByRange(n, "ord").withColumn("part", F.spark_partition_id()))
    # a part is summed by itself; what precedes it is a row for each part
    parts = rows.groupBy("part").agg(F.sum("length").alias("s"))
    before = parts.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("ord")
    rows = cut(rows.join(F.broadcast(before), "part").withColumn("end", F.col("offset") + F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("offset"))
    # a chunk that begins with a file ends before the first whose end is beyond begin + budget: in the bucket of that number, or first in the next
    point = rows.select(F.expr(f"end div {budget}").alias("bucket"), F.col("end").alias("at"), F.lit(1).alias("is_point"), "ord")
    probe = rows.select(F.expr(f"(end - length) div {budget} + 1").alias("bucket"), (F.col("end") - F.col("length") + budget).alias("at"), F.lit(0).alias("is_point"), "ord")
    down = Window.partitionBy("bucket").orderBy(F.desc("at"), "is_point", F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    found = point.unionByName(probe).withColumn("next", F.last(F.when(F.col("is_point") == 1, F.col("ord")), ignorenulls=True).over(down)).where("is_point = 0")
    first = point.groupBy((F.col("bucket") - 1).alias("bucket")).agg(F.min("ord").alias("first"))
    jump = cut(found.join(first, "bucket", "left").select("ord", F.coalesce("next", "first").alias("next")).where("next IS NOT NULL"))
    begins = cut(rows.agg(F.min("ord").alias("ord")).where("ord IS NOT NULL").withColumn("chunk", F.lit(0).cast("long")))
    step = 1
    while True:
        more = cut(begins.join(jump, "ord").select(F.col("next").alias("ord"), (F.col("chunk") + step).alias("chunk")))
        if more.isEmpty():
            break
        begins = cut(begins.unionByName(more).groupBy("ord").agg(F.min("chunk").alias("chunk")))
        jump = cut(jump.join(jump.select(F.col("ord").alias("next"), F.col("next").alias("further")), "next").select("ord", F.col("further").alias("next")))
        step *= 2
    # a file is in the chunk that began last
    told = rows.join(begins, "ord", "left").withColumn("own", F.max("chunk").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = rows.join(begins, "ord").groupBy("part").agg(F.max("chunk").alias("m"))
    carry = parts.join(last, "part", "left").select("part", F.max("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    return told.join(F.broadcast(carry), "part").select("ord", "length", F.coalesce("own", "carry").alias("chunk"))


def snippet(content: Column, line: int | Column, before: int = 3, after: int = 12) -> Column:
    """Lines line - before to line + after of content, clipped; the first 20 for a line of 0 or less."""
    lines = F.split(content, "\n")
    line = F.lit(line) if isinstance(line, int) else line
    first = F.greatest(F.lit(1), line - before)
    return F.array_join(F.when(line <= 0, F.slice(lines, 1, 20)).otherwise(F.slice(lines, first, line + after - first + 1)), "\n")


def source_slice(path: Column, content: Column, first: Column, last: Column) -> Column:
    """Lines first to last of content, clipped; null for a path that leads out of the repository."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")), lambda s, x: F.struct((s["now"] + F.when(x == "..", -1).otherwise(1)).alias("now"), F.least(s["low"], s["now"] + F.when(x == "..", -1).otherwise(1)).alias("low")))
    lines = F.split(content, "\n")
    start, end = F.greatest(F.lit(1), first), F.least(F.size(lines), last)
    return F.when(~path.startswith("/") & (depth["low"] >= 0), F.array_join(F.slice(lines, start, F.greatest(F.lit(0), end - start + 1)), "\n"))


def definition(lines: DataFrame, name: str, kind: str = "") -> DataFrame:
    """source, line, end_line of where name is defined in lines (source, pos from 0, line); sources without it are left out.

    The first pattern that fits any line decides, then the first line.  The end is where
    braces opened from there on are closed again, else the last line.
    """
    q = re.escape(name)
    words = {"class": "class", "interface": "interface", "type_alias": "type", "enum": "enum"}
    patterns = [rf"\b{words[kind]}\s+{q}\b"] if kind in words else []
    patterns += [rf"\bfunction\s+{q}\b", rf"\b(?:const|let|var)\s+{q}\b", rf"\b{q}\s*[=(:]"]
    found = lines.withColumn("rule", rules.first_of(F.col("line"), [(p, i) for i, p in enumerate(patterns)], 1)).where("rule IS NOT NULL")
    first = found.groupBy("source").agg(F.min(F.struct("rule", "pos")).alias("at")).select("source", F.col("at.pos").alias("first"))
    after = lines.join(first, "source").where("pos >= first")
    opened, closed = F.regexp_count("line", F.lit(r"\{")), F.regexp_count("line", F.lit(r"\}"))
    so_far = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    after = after.withColumns({"depth": F.sum(opened - closed).over(so_far), "any": F.sum(opened).over(so_far)})
    end = F.coalesce(F.min(F.when((F.col("any") > 0) & (F.col("depth") <= 0), F.col("pos"))), F.max("pos"))
    return after.groupBy("source", "first").agg(end.alias("last")).select("source", (F.col("first") + 1).alias("line"), (F.col("last") + 1).alias("end_line"))


def external_findings(reports: DataFrame, most: int = 500) -> DataFrame:
    """file_path, line, severity, category of reports (text of JSON with results), the first `most` of each."""
    schema = "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<severity:string,message:string,metadata:struct<category:string>>>>"
    rows = reports.select(F.explode(F.slice(F.from_json("text", schema)["results"], 1, most)).alias("r"))

    def category(c: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for key, value in CATEGORY:
            out = out.when(F.lower(c).contains(key), F.lit(value))
        return out

    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("r.extra.severity")), F.lit("medium"))
    kind = F.coalesce(category(F.col("r.extra.metadata.category")), category(F.col("r.check_id")), F.lit("security"))
    return rows.select(F.col("r.path").alias("file_path"), F.col("r.start.line").alias("line"), severity.alias("severity"), kind.alias("category"))


def branch_scan(commits: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """branch, commits, files of branches (branch, day, hash, file) with a commit in the days before as_of, main lines and releases apart; newest first."""
    name = F.col("branch")
    kept = commits.where(~name.isin("HEAD", "main", "master", "develop") & ~name.startswith("release/"))
    rows = kept.groupBy("branch").agg(F.max("day").alias("last_day"), F.count_distinct("hash").alias("commits"), F.count_distinct("file").alias("files"))
    return rows.where(F.col("last_day") >= F.date_sub(F.lit(as_of).cast("date"), days)).orderBy(F.desc("last_day"), "branch")


def file_tree(paths: DataFrame) -> DataFrame:
    """path, parent, depth, is_file: every folder and file of paths (file_path)."""
    parts = F.split("file_path", "/")
    rows = paths.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    at = lambda k: F.array_join(F.slice("p", 1, k), "/")
    return rows.select(at(F.col("n")).alias("path"), F.when(F.col("n") > 1, at(F.col("n") - 1)).alias("parent"), F.col("n").alias("depth"), (F.col("n") == F.size("p")).alias("is_file")).distinct()


def sarif(findings: DataFrame) -> DataFrame:
    """One JSON text for each finding, in the result shape of SARIF."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    region = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("category").alias("ruleId"), level.alias("level"), F.array(region).alias("locations"))).alias("result"))


def merge_conflicts(texts: DataFrame) -> DataFrame:
    """file_path, start_line, end_line of the conflict blocks in the output of a merge (source, pos, line)."""
    line = F.col("line")
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.when(line.startswith("CONFLICT (content): Merge conflict in "), F.regexp_extract("line", r"in (.+)$", 1)), True).over(w)
    start = F.last(F.when(line.startswith("<<<<<<<"), F.col("pos") + 1), True).over(w)
    rows = texts.select("line", "pos", path.alias("file_path"), start.alias("start_line"))
    return rows.where(line.startswith(">>>>>>>") & F.col("start_line").isNotNull() & F.col("file_path").isNotNull()).select("file_path", "start_line", (F.col("pos") + 1).alias("end_line"))
