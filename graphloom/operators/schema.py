"""Models, their fields and what refers to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# Ends of names of classes that are no models.
SERVICES = (
    "Service|Controller|Handler|Middleware|Router|Module|Factory|Provider|Guard|Interceptor|Pipe|Filter|Logger|Config|Manager|Util|Helper|Plugin|Extension|Adapter"
    "|Client|Worker|Queue|Cache|Store|Repository|Resolver"
)


def is_service(name: Column) -> Column:
    return name.rlike(f"(?i)^(.*?({SERVICES}))$")


def orm_by_path(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.contains("prisma"), "prisma").when(p.contains("entity") | p.contains("entities"), "typeorm").otherwise("raw_sql")


def field_type(signature: Column, return_type: Column, annotation: Column) -> Column:
    """Annotation, else return type, else what follows the colon of the signature, else unknown."""
    said = lambda c: F.when((c != "") & (c != "void"), c)
    parsed = F.trim(F.regexp_extract(signature, r":\s*([A-Za-z_][\w<>\[\]|&?,\s]*)", 1))
    return F.coalesce(said(annotation), said(return_type), F.when(parsed != "", parsed), F.lit("unknown"))


def extract_models(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models (model, name, orm, file_path, fields) and fields (model, field, name, field_type, nullable, is_primary, is_unique).

    Classes, interfaces and structs with two or more contained properties, constants or
    statics, and no service's name.  nodes: id, kind, name, file_path, signature.
    """
    held = edges.where("kind = 'contains'").select(F.col("src").alias("model"), F.col("dst").alias("field")).distinct()
    child = nodes.where(F.col("kind").isin("property", "const", "static")).select(F.col("id").alias("field"), "name", "signature")
    sig, name = F.coalesce("signature", F.lit("")), F.col("name")
    fields = held.join(child, "field").select(
        "model", "field", "name", field_type(sig, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("field_type"),
        (sig.contains("?") | F.lower(sig).contains("null")).alias("nullable"), name.rlike(r"(?i)\b(id|_id|pk|primary)\b").alias("is_primary"), name.rlike(r"(?i)\b(email|slug|username|unique)\b").alias("is_unique"),
    )
    sizes = fields.groupBy("model").agg(F.count("*").alias("fields")).where("fields >= 2")
    owners = nodes.where(F.col("kind").isin("class", "interface", "struct") & ~is_service(F.col("name"))).select(F.col("id").alias("model"), "name", orm_by_path(F.col("file_path")).alias("orm"), "file_path")
    models = owners.join(sizes, "model")
    return models, fields.join(models.select("model"), "model", "left_semi")


def link_fields(fields: DataFrame, code: DataFrame) -> DataFrame:
    """field, node, ref_kind: fields whose name stands as a word in a function's signature or name, in any case.

    fields: field, name; code: node, name, signature.  Words are joined by equality: a
    name of word characters can only stand at the words of the text.
    """
    text = F.coalesce("signature", "name")
    words = code.select("node", F.col("name").alias("node_name"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)))).alias("word"))
    hits = fields.select("field", F.lower("name").alias("word")).join(words, "word")
    return hits.select("field", "node", rules.reference_kind(F.col("node_name")).alias("ref_kind")).distinct()


def relationships(models: DataFrame, fields: DataFrame) -> DataFrame:
    """from, to, field, type: belongs_to or has_many where a field's type names a model; foreign_key where its name does.

    models: name (the part after :: counts); fields: model_name, name, field_type.
    """
    short = F.element_at(F.split("name", "::"), -1)
    known = models.select(short.alias("short"), F.col("name").alias("to")).groupBy("short").agg(F.max("to").alias("to"))
    rows = fields.select(F.col("model_name").alias("from"), F.element_at(F.split("model_name", "::"), -1).alias("own"), F.col("name").alias("field"), "field_type")
    typed = rows.where("field_type <> 'unknown'").withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("field_type"), F.lit(r"\w+"), F.lit(0)))))
    by_type = typed.join(known.withColumn("word", F.lower("short")), "word").where("short <> own")
    by_type = by_type.select("from", "to", "field", F.when(F.col("field_type").rlike(r"\[]|Array<"), "has_many").otherwise("belongs_to").alias("type"), F.lit(0).alias("rank"))
    root = F.regexp_extract("field", r"^(.+?)(?:Id|_id)$", 1)
    named = rows.where(root != "").withColumn("short", F.concat(F.upper(F.substring(root, 1, 1)), F.expr("substring(regexp_extract(field, '^(.+?)(?:Id|_id)$', 1), 2)")))
    by_name = named.join(known, "short").where("short <> own").select("from", "to", "field", F.lit("foreign_key").alias("type"), F.lit(1).alias("rank"))
    return by_type.unionByName(by_name).groupBy("from", "to", "field").agg(F.min_by("type", "rank").alias("type"))


def usage(refs: DataFrame) -> DataFrame:
    """field, reads (with queries), writes (with migrations), total."""
    kind = F.col("ref_kind")
    return refs.groupBy("field").agg(F.count_if(kind.isin("read", "query")).alias("reads"), F.count_if(kind.isin("write", "migration")).alias("writes"), F.count("*").alias("total"))


def model_references(models: DataFrame, fields: DataFrame, refs: DataFrame) -> DataFrame:
    """model, field, name, references of every field, 0 where nothing refers to it; models: model; fields: model, field, name; refs: field."""
    counts = refs.groupBy("field").agg(F.count("*").alias("references"))
    rows = models.select("model").join(fields, "model").join(counts, "field", "left")
    return rows.select("model", "field", "name", F.coalesce("references", F.lit(0).cast("long")).alias("references"))


def migration_steps(changes: DataFrame) -> DataFrame:
    """model, field, action, step, type, breaking of changes (model, field, action, refs, writes, relations)."""
    a = F.col("action")
    step = lambda kind, breaking, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kind).alias("type"), breaking.alias("breaking")))
    yes, no, writes, relations, refs = F.lit(True), F.lit(False), F.col("writes") > 0, F.col("relations") > 0, F.col("refs") > 0
    drop = F.array(step("drop_column", yes), step("update_code", writes), step("update_references", yes, relations))
    rename = F.array(step("rename_column", no), step("update_code", no))
    look = F.array(step("review_references", no, refs), step("review_writes", no, writes), step("review_relationships", no, relations), step("analysis", no, ~(refs | writes | relations)))
    steps = F.array_compact(F.when(a.isin("remove", "drop"), drop).when(a == "rename", rename).otherwise(look))
    return changes.select("model", "field", "action", F.posexplode(steps).alias("step", "s")).select("model", "field", "action", "step", "s.type", "s.breaking")
