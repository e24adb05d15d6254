"""Imports: paths of modules, local names, chains of re-exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

# Endings tried, in this order.
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".go")


def normalise(path: Column) -> Column:
    """A path without . parts, and with .. parts taken back."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    step = lambda out, x: F.when((x == "..") & (F.size(out) > 0) & (F.element_at(out, -1) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x)))
    safe = F.aggregate(parts, empty, lambda out, x: F.when(F.size(out) == 0, F.array(x)).otherwise(step(out, x)))
    return F.array_join(safe, "/")


def resolve_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (from_file, source) with resolved: the first of the candidates that is a file (file_path), else the bare path; packages stay as they are."""
    relative = F.col("source").startswith(".")
    folder = F.regexp_extract("from_file", r"^(.*)/[^/]*$", 1)
    base = normalise(F.concat_ws("/", folder, "source"))
    one = imports.select("from_file", "source").distinct().withColumn("base", F.when(relative, base))
    tries = [F.when(F.col("base").endswith(e), F.col("base")).otherwise(F.concat("base", F.lit(e))) for e in ENDINGS] + [F.concat("base", F.lit(f"/index{e}")) for e in ENDINGS]
    found = one.where("base IS NOT NULL").select("from_file", "source", F.posexplode(F.array(*tries)).alias("rank", "file_path")).join(files.select("file_path").distinct(), "file_path")
    best = found.groupBy("from_file", "source").agg(F.min_by("file_path", "rank").alias("hit"))
    out = one.join(best, ["from_file", "source"], "left").select("from_file", "source", F.coalesce("hit", "base", "source").alias("resolved"))
    return imports.join(out, ["from_file", "source"])


def import_map(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """from_file, local, qualified_name of resolved imports (from_file, resolved, name, alias).

    symbols: file_path, name, qualified_name, exported, ord.  default is the first
    exported symbol of the file, * a marker of its name space.
    """
    out = symbols.where("exported")
    first = out.groupBy(F.col("file_path").alias("resolved")).agg(F.min_by("qualified_name", "ord").alias("first"))
    named = out.groupBy(F.col("file_path").alias("resolved"), "name").agg(F.min_by("qualified_name", "ord").alias("named"))
    rows = imports.join(first, "resolved", "left").join(named, ["resolved", "name"], "left")
    target = F.when(F.col("name") == "default", F.col("first")).when(F.col("name") == "*", F.concat(F.lit("__namespace__:"), "resolved")).otherwise(F.col("named"))
    return rows.select("from_file", F.coalesce("alias", "name").alias("local"), target.alias("qualified_name")).where("qualified_name IS NOT NULL")


def export_chain(wanted: DataFrame, symbols: DataFrame, reexports: DataFrame, most: int = 5) -> DataFrame:
    """name, start, qualified_name: the symbol of that name in start or, breadth first, in the files it re-exports, at most `most` files read.

    wanted: name, start; reexports: file, target, ord.
    """
    frontier = cut(wanted.select("name", "start", F.col("start").alias("file"), F.array().cast("array<long>").alias("place")).distinct())
    seen = [frontier]
    for _ in range(most - 1):
        known = reduce(DataFrame.unionByName, seen).select("name", "start", "file")
        new = frontier.join(reexports, "file").select("name", "start", F.col("target").alias("file"), F.concat("place", F.array(F.col("ord").cast("long"))).alias("place"))
        new = cut(new.join(known, ["name", "start", "file"], "left_anti").groupBy("name", "start", "file").agg(F.min("place").alias("place")))
        if new.isEmpty():
            break
        seen.append(new)
        frontier = new
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("name", "start").orderBy(F.size("place"), "place"))
    read = reduce(DataFrame.unionByName, seen).withColumn("nth", order).where(F.col("nth") <= most)
    own = symbols.groupBy(F.col("file_path").alias("file"), "name").agg(F.min_by("qualified_name", "ord").alias("qualified_name"))
    return read.join(own, ["file", "name"]).groupBy("name", "start").agg(F.min_by("qualified_name", "nth").alias("qualified_name"))


def resolve_symbols(refs: DataFrame, imported: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs (file_path, name) with qualified_name: imported, else of the file, else the only one anywhere, else the only exported, else the first."""
    own = symbols.groupBy("file_path", "name").agg(F.min_by("qualified_name", "ord").alias("same"))
    exported = F.when(F.col("exported"), F.col("qualified_name"))
    everywhere = symbols.groupBy("name").agg(F.count(exported).alias("n"), F.max(exported).alias("only"), F.min_by("qualified_name", "ord").alias("first"))
    local = imported.select(F.col("from_file").alias("file_path"), F.col("local").alias("name"), F.col("qualified_name").alias("imported"))
    rows = refs.join(local, ["file_path", "name"], "left").join(own, ["file_path", "name"], "left").join(everywhere, "name", "left")
    return rows.select("file_path", "name", F.coalesce("imported", "same", F.when(F.col("n") == 1, F.col("only")), "first").alias("qualified_name"))


def receiver_types(calls: DataFrame, environment: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (file_path, receiver) with type: from the environment (file_path, name, type), else a class or struct of that name, in the file or anywhere, else an annotation in a signature of the file."""
    env = environment.groupBy("file_path", F.col("name").alias("receiver")).agg(F.max("type").alias("env"))
    types = symbols.where(F.col("kind").isin("class", "struct"))
    same = types.select("file_path", F.col("name").alias("receiver"), F.col("name").alias("same")).distinct()
    anywhere = types.select(F.col("name").alias("receiver"), F.col("name").alias("anywhere")).distinct()
    said = F.regexp_extract_all("signature", F.lit(r"(\w+\s*:\s*[A-Z]\w*)"), F.lit(1))
    notes = symbols.select("file_path", "ord", F.explode(said).alias("note")).select("file_path", "ord", F.regexp_extract("note", r"^(\w+)", 1).alias("receiver"), F.regexp_extract("note", r"([A-Z]\w*)$", 1).alias("note"))
    first = notes.groupBy("file_path", "receiver").agg(F.min_by("note", "ord").alias("note"))
    rows = calls.join(env, ["file_path", "receiver"], "left").join(same, ["file_path", "receiver"], "left").join(anywhere, "receiver", "left").join(first, ["file_path", "receiver"], "left")
    return rows.select(*calls.columns, F.coalesce("env", "same", "anywhere", "note").alias("type"))
