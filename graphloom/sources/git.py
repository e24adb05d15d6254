"""Logs, blames and diffs as text, parsed into rows with window functions. Input: source (one per file of text), pos, line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(texts: DataFrame) -> DataFrame:
    """source, pos, line of texts (source, text)."""
    return texts.select("source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _fill(value: Column) -> Column:
    """The last value so far that is not null."""
    return F.last(value, True).over(Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))


def parse_log(rows: DataFrame) -> DataFrame:
    """hash, author, author_email, date, message, file, insertions, deletions of a log with --format=%H|%h|%an|%ae|%aI|%s --numstat; "-" counts 0."""
    head = r"^([0-9a-f]{40})\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"
    part = lambda i: F.when(F.col("line").rlike(head), F.regexp_extract("line", head, i))
    names = ("hash", "abbrev", "author", "author_email", "date", "message")
    filled = rows.select("*", *[_fill(part(i + 1)).alias(n) for i, n in enumerate(names)])
    stat = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    number = lambda i: F.coalesce(F.expr(f"try_cast(regexp_extract(line, '{stat}', {i}) AS bigint)".replace("\\", "\\\\")), F.lit(0))
    return filled.where(F.col("line").rlike(stat)).select(*names, F.regexp_extract("line", stat, 3).alias("file"), number(1).alias("insertions"), number(2).alias("deletions"))


def parse_diff(rows: DataFrame) -> DataFrame:
    """file_path, type (add, delete, context), content, old_line, new_line of unified diffs."""
    line = F.col("line")
    path = _fill(F.when(line.rlike(r"^diff --git "), F.regexp_extract("line", r" b/(.*)$", 1)))
    hunk = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    start = lambda i: _fill(F.when(line.rlike(hunk), F.regexp_extract("line", hunk, i).cast("int")))
    at = _fill(F.when(line.rlike(hunk) | line.rlike("^diff --git "), F.col("pos")))
    kind = F.when(line.startswith("+"), "add").when(line.startswith("-"), "delete").when(line.startswith(" "), "context")
    rows = rows.select("*", path.alias("file_path"), start(1).alias("old"), start(2).alias("new"), at.alias("at"), kind.alias("type"))
    hunked = _fill(F.when(F.col("line").rlike("^diff --git "), False).when(F.col("line").rlike(hunk), True))
    rows = rows.withColumn("in_hunk", hunked).where("in_hunk AND type IS NOT NULL AND NOT line LIKE '@@%'")
    so_far = Window.partitionBy("source", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda skip: F.coalesce(F.sum((F.col("type") != skip).cast("int")).over(so_far), F.lit(0))
    return rows.select(
        "source", "file_path", "type", F.expr("substring(line, 2)").alias("content"),
        F.when(F.col("type") != "add", F.col("old") + count("add")).alias("old_line"), F.when(F.col("type") != "delete", F.col("new") + count("delete")).alias("new_line"),
    )


def parse_blame(rows: DataFrame) -> DataFrame:
    """line_no, commit_hash, author, author_email, author_time, content of porcelain blames; what a commit said first holds for its later lines."""
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    is_head = F.col("line").rlike(head)
    rows = rows.withColumn("commit_hash", _fill(F.when(is_head, F.regexp_extract("line", head, 1)))).withColumn("line_no", _fill(F.when(is_head, F.regexp_extract("line", head, 2).cast("int"))))
    said = lambda p: F.when(F.col("line").rlike(f"^{p} "), F.expr(f"substring(line, {len(p) + 2})"))
    own = Window.partitionBy("source", "commit_hash").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.last(said(p), True).over(own).alias(n) for p, n in (("author", "author"), ("author-mail", "author_email"), ("author-time", "author_time"))])
    return rows.where(F.col("line").startswith("\t")).select("source", "line_no", "commit_hash", "author", "author_email", F.col("author_time").cast("long"), F.expr("substring(line, 2)").alias("content"))


def parse_branches(rows: DataFrame) -> DataFrame:
    """source, name, remote, current, commit_hash of listings by `branch -a -v`; pointers such as origin/HEAD are left out."""
    form = r"^(\*?)\s*(remotes/[^/\s]+/)?(\S+)\s+([0-9a-f]{7,40})\b"
    part = lambda i: F.regexp_extract("line", form, i)
    hits = rows.where(F.col("line").rlike(form) & ~F.col("line").rlike(r"\s->\s"))
    return hits.select("source", part(3).alias("name"), (part(2) != "").alias("remote"), (part(1) == "*").alias("current"), part(4).alias("commit_hash"))


def main_branch(branches: DataFrame) -> DataFrame:
    """source, main: main, else master, else the current branch of each listing."""
    n = F.col("name")
    order = F.when(n == "main", 0).when(n == "master", 1).when(F.col("current"), 2)
    return branches.where(order.isNotNull()).groupBy("source").agg(F.min_by("name", order).alias("main"))
