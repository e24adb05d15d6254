"""Counts, coupling, churn, coverage, scores and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, file_path, ca, ce, instability: incoming and outgoing calls and imports; parallel edges count each."""
    some = edges.where(F.col("kind").isin("calls", "imports"))
    ca = some.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ca"))
    ce = some.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("ce"))
    rows = nodes.join(ca, "id", "left").join(ce, "id", "left").select("id", "file_path", "kind", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    return rows.withColumn("instability", F.coalesce(F.try_divide("ce", F.col("ca") + F.col("ce")), F.lit(0.0)))


def file_coupling(per_node: DataFrame) -> DataFrame:
    """file_path, ca, ce, instability and abstractness (interfaces and traits among its nodes)."""
    rows = per_node.groupBy("file_path").agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce"), F.avg(F.col("kind").isin("interface", "trait").cast("double")).alias("abstractness"))
    return rows.withColumn("instability", F.coalesce(F.try_divide("ce", F.col("ca") + F.col("ce")), F.lit(0.0)))


def churn(log: DataFrame, as_of: str, window: int = 90, recent: int = 30) -> DataFrame:
    """file, commits, authors, insertions, deletions, last_day, recent_commits over the window days before as_of."""
    day = F.lit(as_of).cast("date")
    rows = log.where((F.col("day") >= F.date_sub(day, window)) & (F.col("day") <= day))
    late = F.col("day") > F.date_sub(day, recent)
    return rows.groupBy("file").agg(
        F.count_distinct("hash").alias("commits"), F.count_distinct("author_email").alias("authors"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"),
        F.max("day").alias("last_day"), F.count_distinct(F.when(late, F.col("hash"))).alias("recent_commits"),
    )


def cyclomatic(blocks: DataFrame, edges: DataFrame, clamped: bool = True) -> DataFrame:
    """fn and edges - blocks + 2 (at least 1 if clamped) of each function."""
    n = blocks.groupBy("fn").agg(F.count("*").alias("n"))
    e = edges.groupBy("fn").agg(F.count("*").alias("e"))
    value = F.coalesce("e", F.lit(0)) - F.col("n") + 2
    return n.join(e, "fn", "left").select("fn", (F.greatest(F.lit(1), value) if clamped else value).cast("long").alias("cyclomatic"))


def cognitive(blocks: DataFrame) -> DataFrame:
    """fn and its cognitive complexity: branches and loops cost 1 and the number of those before them, others nothing; blocks: fn, ord, kind."""
    nests = F.col("kind").isin("branch", "loop_header")
    before = F.coalesce(F.sum(nests.cast("int")).over(Window.partitionBy("fn").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("cost", F.when(nests, 1 + before).otherwise(0)).groupBy("fn").agg(F.sum("cost").alias("cognitive"))


#: A token that begins so is an operator.
OPERATOR = r"^[+\-*/=<>!&|^~%?:]"


def halstead(statements: DataFrame) -> DataFrame:
    """fn and volume: statements times log2 of the distinct operators and operands; statements: fn, text."""
    tokens = statements.select("fn", F.explode(F.split("text", r"\s+|[(){}\[\],;]")).alias("token")).where("token <> ''")
    is_op = F.col("token").rlike(OPERATOR)
    kinds = tokens.groupBy("fn").agg(F.count_distinct(F.when(is_op, F.col("token"))).alias("n1"), F.count_distinct(F.when(~is_op, F.col("token"))).alias("n2"))
    n = statements.groupBy("fn").agg(F.count("*").alias("n"))
    size = F.greatest(F.coalesce("n1", F.lit(0)), F.lit(1)) + F.greatest(F.coalesce("n2", F.lit(0)), F.lit(1))
    return n.join(kinds, "fn", "left").select("fn", (F.col("n") * F.log2(size)).alias("volume"))


def coverage(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """file_path, total, covered, percent (100 times, 0 when empty) of production nodes with a test link (prod)."""
    covered = links.select(F.col("prod").alias("id")).distinct().withColumn("hit", F.lit(1))
    rows = nodes.where("NOT is_test").join(covered, "id", "left").groupBy("file_path").agg(F.count("*").alias("total"), F.count("hit").alias("covered"))
    return rows.withColumn("percent", F.coalesce(F.try_divide(F.col("covered") * 100.0, "total"), F.lit(0.0)))


def uncovered(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Production nodes without a test link (prod)."""
    return nodes.where("NOT is_test").join(links.select(F.col("prod").alias("id")).distinct(), "id", "left_anti")


def community_sizes(members: DataFrame, least: int = 2) -> DataFrame:
    """community, size, members (ids in order) of communities of at least that size; a community's ids are held in one row, as its listing is."""
    rows = members.groupBy("community").agg(F.count("*").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("members"))
    return rows.where(F.col("size") >= least).orderBy(F.desc("size"), "community")


def by_severity(findings: DataFrame, severities=("critical", "high", "medium", "low")) -> DataFrame:
    """severity and n, 0 where there is none, worst first."""
    every = findings.sparkSession.createDataFrame([(s, i) for i, s in enumerate(severities)], "severity string, place int")
    rows = every.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left")
    return rows.select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "place").orderBy("place").drop("place")


def taint_summary(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """One row: sources, sinks, flows, critical, warning, info, sanitized."""
    s = F.col("severity")
    counts = flows.agg(F.count("*").alias("flows"), *[F.count_if(s == x).alias(x) for x in ("critical", "warning", "info")], F.count_if("sanitized").alias("sanitized"))
    return nodes.agg(F.count_if("is_source").alias("sources"), F.count_if("is_sink").alias("sinks")).crossJoin(counts)  # one row each


def lines_of_code(blocks: DataFrame) -> DataFrame:
    """fn and loc: from its first line to its last, 0 where lines are not known; blocks: fn, start_line, end_line."""
    rows = blocks.groupBy("fn").agg(F.min("start_line").alias("low"), F.max("end_line").alias("high"))
    return rows.select("fn", F.greatest(F.coalesce(F.col("high") - F.col("low") + 1, F.lit(0)), F.lit(0)).cast("long").alias("loc"))


#: Statements' operators that add to cognitive complexity.
LOGICAL = r"&&|\|\||\?\?"


def cognitive_nested(blocks: DataFrame, depths: DataFrame) -> DataFrame:
    """fn and cognitive: branches, loops and catches cost 1 and their depth, cases of a switch 1, logical operators 1 each; blocks: fn, block, kind, text; depths: fn, block, depth."""
    kind = F.col("kind")
    rows = blocks.join(depths, ["fn", "block"], "left")
    cost = F.when(kind.isin("branch", "loop_header", "catch"), 1 + F.coalesce("depth", F.lit(0))).when(kind == "switch_case", 1).otherwise(0)
    return rows.groupBy("fn").agg(F.sum(cost + F.regexp_count(F.coalesce("text", F.lit("")), F.lit(LOGICAL))).cast("long").alias("cognitive"))


def resolution_stats(calls: DataFrame) -> DataFrame:
    """tier (unresolved where null), n and mean confidence (null for unresolved), most first."""
    tier = F.coalesce("tier", F.lit("unresolved"))
    return calls.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("tier").isNotNull(), F.col("confidence"))).alias("mean")).orderBy(F.desc("n"), "tier")


def stored_complexity(nodes: DataFrame) -> DataFrame:
    """id, cyclomatic (1 if missing), cognitive (0 if missing) of nodes that have either."""
    rows = nodes.where("cyclomatic IS NOT NULL OR cognitive IS NOT NULL")
    return rows.select("id", F.coalesce("cyclomatic", F.lit(1)).alias("cyclomatic"), F.coalesce("cognitive", F.lit(0)).alias("cognitive"))


def security_score(findings: DataFrame, *by: str) -> DataFrame:
    """taint, inputs, dependencies, flows, overall and grade, one row for each group by, or one in all; findings: severity, category."""
    s, c = F.col("severity"), F.col("category")
    inputs = c.isin("sql_injection", "xss", "command_injection", "insecure_deserialization")
    held = lambda x: F.least(F.lit(100), F.greatest(F.lit(0), x))
    row = findings.groupBy(*by).agg(
        held(100 - (20 * F.count_if(s == "critical") + 8 * F.count_if(s == "high") + 3 * F.count_if(s == "medium") + F.count_if(s == "low"))).alias("taint"),
        held(100 - 12 * F.count_if(inputs)).alias("inputs"),
        held(100 - 15 * F.count_if(c.isin("hardcoded_secret", "ssrf", "dependency_risk"))).alias("dependencies"),
        held(100 - 10 * F.count_if(c.isin("path_traversal", "open_redirect", "pii_leak", "log_injection"))).alias("flows"),
    )
    overall = F.floor(F.col("taint") * 0.4 + F.col("inputs") * 0.25 + F.col("dependencies") * 0.2 + F.col("flows") * 0.15 + 0.5)
    return row.withColumn("overall", overall).withColumn(
        "grade", F.when(F.col("overall") >= 90, "A").when(F.col("overall") >= 75, "B").when(F.col("overall") >= 60, "C").when(F.col("overall") >= 40, "D").otherwise("F")
    )


#: The weights of the risk factors.
WEIGHTS = {"complexity": 0.15, "testCoverage": 0.25, "dataSensitivity": 0.20, "blastRadius": 0.15, "changeVelocity": 0.10, "errorHandling": 0.15}


def complexity_bucket(cc: Column) -> Column:
    return F.when(cc.isNull(), 5).when(cc > 50, 10).when(cc > 30, 8).when(cc > 15, 6).when(cc > 8, 4).otherwise(2)


def test_bucket(direct: Column, transitive: Column, known: Column) -> Column:
    return F.when(~known, 7).when(direct >= 3, 1).when(direct >= 1, 3).when(transitive >= 2, 5).when(transitive >= 1, 7).otherwise(10)


def velocity_bucket(recent: Column) -> Column:
    return F.when(recent.isNull(), 5).when(recent > 20, 10).when(recent > 10, 8).when(recent > 5, 6).when(recent > 2, 4).otherwise(2)


def error_bucket(cc: Column) -> Column:
    cc = F.coalesce(cc, F.lit(1))
    return F.when(cc > 10, 7).when(cc > 5, 4).otherwise(2)


def sensitivity(name: Column, critical: Column, warning: Column) -> Column:
    n = F.lower(name)
    found = (
        F.when(n.rlike("auth|login|password|token|session|credential"), 4).otherwise(0) + F.when(n.rlike("payment|billing|credit|charge"), 5).otherwise(0)
        + F.when(n.rlike("email|phone|ssn|address|pii"), 3).otherwise(0) + F.when(n.rlike("encrypt|decrypt|hash|sign|verify"), 3).otherwise(0)
    )
    return F.least(F.lit(10), found + F.when(critical > 0, 3).otherwise(0) + F.when(warning > 0, 1).otherwise(0))


def level(score: Column) -> Column:
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")


def risk(rows: DataFrame) -> DataFrame:
    """rows, with a column for each factor of WEIGHTS, with score (0 to 100), level and recommendation."""
    total = sum((F.col(k) * F.lit(w) for k, w in WEIGHTS.items()), F.lit(0.0))
    scored = rows.withColumn("score", F.floor(total * 10 + 0.5).cast("long")).withColumn("level", level(F.col("score")))
    advice = F.concat_ws(
        "; ",
        F.when(F.col("testCoverage") >= 7, "Add test coverage for this code"), F.when(F.col("complexity") >= 7, "Consider refactoring to reduce complexity"),
        F.when(F.col("dataSensitivity") >= 7, "Ensure security review for sensitive data handling"),
        F.when(F.col("blastRadius") >= 7, "High blast radius — consider adding integration tests"),
    )
    none = F.when(F.col("level") == "low", "Low risk — no action needed").otherwise("Review before merging")
    return scored.withColumn("recommendation", F.when(advice == "", none).otherwise(advice))


def overall_risk(scored: DataFrame) -> DataFrame:
    """part, name, value: the mean of each factor (factor), the nodes of each level (level), the mean score (mean), each to one decimal, and the three factors that weigh most (top; value is their mean times weight)."""
    spark = scored.sparkSession
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    names = list(WEIGHTS)
    levels = ("low", "medium", "high", "critical")
    sums = scored.agg(
        *[F.avg(n).alias(n) for n in names], F.avg("score").alias("__mean"), *[F.count_if(F.col("level") == x).alias(f"__{x}") for x in levels]
    )  # one row
    parts = [F.struct(F.lit("factor").alias("part"), F.lit(n).alias("name"), tenth(F.col(n)).cast("double").alias("value")) for n in names]
    parts += [F.struct(F.lit("level").alias("part"), F.lit(x).alias("name"), F.col(f"__{x}").cast("double").alias("value")) for x in levels]
    parts += [F.struct(F.lit("mean").alias("part"), F.lit("score").alias("name"), tenth(F.col("__mean")).cast("double").alias("value"))]
    rows = sums.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    weights = spark.createDataFrame(list(WEIGHTS.items()), "name string, weight double")
    top = rows.where("part = 'factor'").join(weights, "name").select(F.lit("top").alias("part"), "name", (F.col("value") * F.col("weight")).alias("value"))
    return rows.unionByName(top.orderBy(F.desc("value"), "name").limit(3))


def file_risk(scored: DataFrame, limit: int = 30) -> DataFrame:
    """file_path, mean, worst, n, level (of the worst), worst first."""
    rows = scored.groupBy("file_path").agg(F.avg("score").alias("mean"), F.max("score").alias("worst"), F.count("*").alias("n"))
    return rows.withColumn("level", level(F.col("worst"))).orderBy(F.desc("worst"), "file_path").limit(limit)
