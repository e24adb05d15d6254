"""What a browser of the graph shows: filtered graphs, findings, references and branches, each as a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookups import severity_rank


def holds(text: str, *columns: str) -> Column:
    """Whether text, in any case, is in any of the columns; empty text is in all."""
    q = text.strip().lower()
    if not q:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(q), F.lit(False)) for c in columns))


def graph_filter(nodes: DataFrame, edges: DataFrame, *, kinds=(), languages=(), communities=(), tests: bool | None = None, entries: bool = False, least_risk: float = 0, text: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes that pass every filter given, the edges between them, and the number of nodes in each community.

    kinds, languages and communities: empty for all; tests: False leaves them out, True keeps only them.
    """
    kept = nodes.where(holds(text, "name", "qualified_name", "file_path"))
    for column, values in (("kind", kinds), ("language", languages), ("community", communities)):
        kept = kept.where(F.col(column).isin(*values)) if values else kept
    if tests is not None:
        kept = kept.where(F.col("is_test") == tests)
    if entries:
        kept = kept.where("is_entry")
    if least_risk > 0:
        kept = kept.where(F.coalesce("risk", F.lit(0)) >= least_risk)
    ids = kept.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    group = F.col("community") if "community" in nodes.columns else F.col("file_path")
    return kept, inner, kept.groupBy(group.alias("community")).agg(F.count("*").alias("n"))


def _worst() -> Column:
    """3 less the rank of severities: 0 is critical."""
    return 3 - severity_rank(F.col("severity"))


def findings_by_category(findings: DataFrame, *, severities=(), categories=(), text: str = "") -> DataFrame:
    """category, worst (0 is critical), n, and how many of each severity; the worst first."""
    rows = findings.where(holds(text, "file_path", "category"))
    rows = rows.where(F.col("severity").isin(*severities)) if severities else rows
    rows = rows.where(F.col("category").isin(*categories)) if categories else rows
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    return rows.groupBy("category").agg(F.min(_worst()).alias("worst"), F.count("*").alias("n"), *counts).orderBy("worst", F.desc("n"), "category")


def threat_map(findings: DataFrame, by: str, other: str) -> DataFrame:
    """by (file_path or category), worst, n and the distinct values of the other, which is small: categories or files of one group."""
    rows = findings.groupBy(by).agg(F.min(_worst()).alias("worst"), F.count("*").alias("n"), F.sort_array(F.collect_set(other)).alias("categories" if other == "category" else "files"))
    return rows.orderBy("worst", F.desc("n"), by)


def critical_first(findings: DataFrame) -> DataFrame:
    """findings (severity, file_path, line, ord), most severe first."""
    return findings.orderBy(_worst(), "ord")


def repo_totals(nodes: DataFrame, text: str = "") -> DataFrame:
    """repo, files and functions of the repositories whose name holds text; nodes: repo, file_path, kind (null: no node)."""
    rows = nodes.where(holds(text, "repo")).groupBy("repo")
    return rows.agg(F.count_distinct("file_path").alias("files"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"))


def repo_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """repo, nodes, edges, files, functions, classes, tests and languages (sorted); edges: repo."""
    per = nodes.groupBy("repo").agg(
        F.count("*").alias("nodes"), F.count_distinct("file_path").alias("files"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"),
        F.count_if(F.col("kind") == "class").alias("classes"), F.count_if("is_test").alias("tests"), F.sort_array(F.collect_set("language")).alias("languages"),
    )
    return per.join(edges.groupBy("repo").agg(F.count("*").alias("edges")), "repo", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def references_by_file(refs: DataFrame) -> DataFrame:
    """file_path, n, reads (with queries), writes (with migrations), most first."""
    kind = F.col("ref_kind")
    rows = refs.groupBy("file_path").agg(F.count("*").alias("n"), F.count_if(kind.isin("read", "query")).alias("reads"), F.count_if(kind.isin("write", "migration")).alias("writes"))
    return rows.orderBy(F.desc("n"), "file_path")


def siblings(nodes: DataFrame) -> DataFrame:
    """id, file_path, kind, place: the nodes of each file numbered by line."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "ord"))
    return nodes.select("id", "file_path", "kind", place.alias("place"))


def by_directory(models: DataFrame) -> DataFrame:
    """directory and models of models (name, file_path), largest first; files without a folder are in '.'."""
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    return models.groupBy(F.when(folder == "", ".").otherwise(folder).alias("directory")).agg(F.count("*").alias("models")).orderBy(F.desc("models"), "directory")


def connections(relations: DataFrame) -> DataFrame:
    """name and connections of models: relations (from, to) that touch each; one to itself counts once."""
    ends = relations.select(F.explode(F.array_distinct(F.array("from", "to"))).alias("name"))
    return ends.groupBy("name").agg(F.count("*").alias("connections"))


def factor_impact(factors: DataFrame) -> DataFrame:
    """factors (id, name, score, weight) with impact, round(score * weight * 10), and place, 1 for the largest."""
    force = F.col("score") * F.col("weight")
    place = F.row_number().over(Window.partitionBy("id").orderBy(force.desc(), "name"))
    return factors.select("id", "name", F.floor(force * 10 + 0.5).cast("long").alias("impact"), place.alias("place"))


def hotspots_in_file(scored: DataFrame, least: int = 0) -> DataFrame:
    """id, file_path, score, place of scored nodes of at least that score, the riskiest of each file first."""
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "id"))
    return scored.where(F.col("score") >= least).select("id", "file_path", "score", place.alias("place"))


def branch_groups(listed: DataFrame, text: str = "") -> DataFrame:
    """name, last_day, local, remote, current of branches (name, day, remote, current), local and remote of one name together; the current first, then the newest."""
    short = F.regexp_replace("name", "^origin/", "")
    rows = listed.withColumn("name", short).where(holds(text, "name")).groupBy("name")
    rows = rows.agg(F.max("day").alias("last_day"), F.bool_or(~F.col("remote")).alias("local"), F.bool_or("remote").alias("remote"), F.bool_or("current").alias("current"))
    return rows.orderBy(F.desc("current"), F.desc("last_day"), "name")


def range_summary(diff: DataFrame) -> DataFrame:
    """range, files, insertions, deletions and changed (sorted paths, at most 200) of diff (range, file_path, insertions, deletions)."""
    per = diff.groupBy("range", "file_path").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    first = F.row_number().over(Window.partitionBy("range").orderBy("file_path"))
    per = per.withColumn("__r", first)
    return per.groupBy("range").agg(
        F.count("*").alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.sort_array(F.collect_list(F.when(F.col("__r") <= 200, F.col("file_path")))).alias("changed")
    )
