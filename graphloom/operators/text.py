"""Keyword, vector and fused search; line scanning."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def _same(word: str, x: Column) -> Column:
    return x == word


#: Accented letters, and what they are folded to.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, accents folded."""
    return F.filter(F.split(F.translate(F.lower(text), *ACCENTS), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_words(query: str) -> list[list[str]]:
    """The tokens of each word of a query, as tokens() has them."""
    folded = query.lower().translate(str.maketrans(*ACCENTS))
    return [[x for x in re.split(r"[\W_]+", w) if x] for w in folded.split()]


def settled(score: str) -> Column:
    """A score without its last digits, which depend on the order of a sum: equal scores tie."""
    return F.round(score, 9)


def postings(docs: DataFrame) -> DataFrame:
    """node_id, term, tf: how often each term is in name, qualified_name and file_path together."""
    words = F.concat(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in ("name", "qualified_name", "file_path")])
    return docs.select("node_id", F.explode(words).alias("term")).groupBy("node_id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, limit: int = 50, among: Column | None = None) -> DataFrame:
    """node_id, score (negative, least is best) of the documents that hold all words of query; k1 = 1.2, b = 0.75.

    A word of several tokens is a phrase, which must be adjacent in one of the columns.
    among: a condition on docs; others count for the statistics only.  Documents are read
    once for those, one row, and once to be scored, where they lie.
    """
    phrases = query_words(query)
    terms = sorted({x for p in phrases for x in p})
    if not terms:
        return docs.sparkSession.createDataFrame([], "node_id long, score double")
    columns = ("name", "qualified_name", "file_path")
    held = F.coalesce(F.col("__words"), F.array().cast("array<string>"))
    counted = docs.withColumn("__words", F.concat(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in columns]))
    counted = counted.withColumns({"__dl": F.size(held)} | {f"__tf{i}": F.size(F.filter(held, partial(_same, w))) for i, w in enumerate(terms)})
    facts = counted.agg(F.count("*").alias("__n"), F.avg(F.when(F.col("__dl") > 0, F.col("__dl"))).alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
    found = counted if among is None else counted.where(among)
    for i in range(len(terms)):
        found = found.where(F.col(f"__tf{i}") > 0)
    for p in (p for p in phrases if len(p) > 1):
        flat = [F.coalesce(F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" ")).contains(" " + " ".join(p) + " "), F.lit(False)) for c in columns]
        found = found.where(flat[0] | flat[1] | flat[2])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.greatest(F.log((F.col("__n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("__dl") / F.col("__avg")))
    scored = found.crossJoin(F.broadcast(facts)).select("node_id", (-score).alias("score"))  # one row
    return scored.orderBy(settled("score"), "node_id").limit(limit)


def match(docs: DataFrame, query: str) -> DataFrame:
    """Rows of docs that hold every word of query (a word of several tokens as a phrase) in one of the three columns; not ranked. An empty query matches nothing."""
    kept = docs.where(F.lit(bool(query_words(query))))
    flat = [F.coalesce(F.concat(F.lit(" "), F.array_join(tokens(F.col(c)), " "), F.lit(" ")), F.lit("")) for c in ("name", "qualified_name", "file_path")]
    for phrase in query_words(query):
        kept = kept.where(F.concat_ws("|", *flat).contains(" " + " ".join(phrase) + " "))
    return kept


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df: in how many documents' name and qualified name each term of the vector search is."""
    words = F.array_distinct(_semantic_tokens(F.concat_ws(" ", "name", F.coalesce("qualified_name", F.lit("null")))))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _semantic_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_]", " "), r"[\s_]+"), lambda x: F.length(x) > 1)


def tfidf(docs: DataFrame, query: str, limit: int = 50, least: float = 0.01) -> DataFrame:
    """node_id, score: cosine of raw counts weighed by ln((N + 1) / (df + 1)) + 1; a null qualified name reads "null".

    Terms are counted over all documents; only those that share a term with the query are weighed.
    """
    asked: dict[str, int] = {}
    for w in re.split(r"[\s_]+", re.sub("[^a-z0-9_]", " ", query.lower())):
        if len(w) > 1:
            asked[w] = asked.get(w, 0) + 1
    if not asked:
        return docs.sparkSession.createDataFrame([], "node_id long, score double")
    words = docs.select("node_id", _semantic_tokens(F.concat_ws(" ", "name", F.coalesce("qualified_name", F.lit("null")))).alias("words"))
    n = docs.agg(F.count("*").alias("n_docs"))
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row
    query_terms = docs.sparkSession.createDataFrame(list(asked.items()), "term string, qtf int")  # a row for each word of the query
    weighed = idf.join(F.broadcast(query_terms), "term").select("term", (F.col("qtf") * F.col("idf")).alias("qw"))
    length = weighed.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    near = words.where(F.arrays_overlap("words", F.array(*[F.lit(x) for x in asked])))
    tf = near.select("node_id", F.explode("words").alias("term")).groupBy("node_id", "term").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "term").join(F.broadcast(weighed), "term", "left").withColumn("w", F.col("tf") * F.col("idf"))
    dots = w.groupBy("node_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"))
    scored = dots.crossJoin(F.broadcast(length)).select("node_id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))
    return scored.where(F.col("score") > least).orderBy(settled("score").desc(), "node_id").limit(limit)


def fuse(keyword: DataFrame, semantic: DataFrame, limit: int = 20, k: int = 60) -> DataFrame:
    """node_id, score, bm25_rank, semantic_rank: reciprocal rank fusion; ties in keyword order first."""
    a = keyword.withColumn("bm25_rank", F.row_number().over(Window.orderBy(settled("score"), "node_id"))).select("node_id", "bm25_rank")
    b = semantic.withColumn("semantic_rank", F.row_number().over(Window.orderBy(settled("score").desc(), "node_id"))).select("node_id", "semantic_rank")
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = a.join(b, "node_id", "full").withColumn("score", part("bm25_rank") + part("semantic_rank"))
    return both.orderBy(F.desc("score"), F.col("bm25_rank").asc_nulls_last(), "semantic_rank").limit(limit).select("node_id", "score", "bm25_rank", "semantic_rank")


def hybrid(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return fuse(bm25(docs, query, 3 * limit), tfidf(docs, query, 3 * limit), limit)


def cosine(v: Column, probe: list[float]) -> Column:
    """The cosine of v, an array, and probe; null where either has no length."""
    q = F.array(*[F.lit(float(x)) for x in probe])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))


def cosine_top(vectors: DataFrame, probe: list[float], k: int = 10) -> DataFrame:
    """vec_id, score of the k vectors nearest to probe by cosine; vectors: vec_id, embedding."""
    return vectors.select("vec_id", cosine(F.col("embedding"), probe).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def code_lines(files: DataFrame) -> DataFrame:
    """file_path, line (from 1), text of the lines that begin no comment, of files (file_path, content) that are no tests."""
    path = F.col("file_path")
    test = path.contains("__tests__") | path.contains("/test/") | path.contains("/tests/") | path.contains(".test.") | path.contains(".spec.") | F.substring_index(path, "/", -1).startswith("test_")
    lines = files.where(~test).select("file_path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    head = F.regexp_replace("text", r"^\s+", "")
    code = lines.where(~(head.startswith("//") | head.startswith("*") | head.startswith("#")))
    return code.select("file_path", (F.col("line") + 1).alias("line"), "text")


#: What a line must hold for any rule of rules.LINES to fit it; prose mostly does not.
NEEDED = r"[(=:\[]|child_process|dangerouslySetInnerHTML|-----BEGIN|Bearer"


def scan_lines(files: DataFrame, patterns=rules.LINES) -> DataFrame:
    """file_path, line, category, severity: the first rule each line matches; files: file_path, content.

    Lines that begin as comments, and test files, are passed over.  Lines without what every
    rule of LINES needs meet only a user's own rules, and one chain gives both values of the
    first rule that fits.
    """
    patterns = list(patterns)
    own = patterns[len(rules.LINES) :] if patterns[: len(rules.LINES)] == list(rules.LINES) else patterns
    needed = ([NEEDED] if len(own) < len(patterns) else []) + [f"(?:{p[0]})" for p in own]
    some = code_lines(files).where(F.col("text").rlike("|".join(needed)))
    first = rules.first_of(F.col("text"), [(p[0], i) for i, p in enumerate(patterns)], 1)
    values = F.array(*[F.struct(F.lit(p[1]).alias("category"), F.lit(p[2]).alias("severity")) for p in patterns])
    return some.select("file_path", "line", F.get(values, first).alias("r")).where("r IS NOT NULL").select("file_path", "line", "r.category", "r.severity")


def worst_first(findings: DataFrame) -> DataFrame:
    """Of findings of one file, line and category the most severe, ties to the lesser ord."""
    from .lookups import severity_rank

    rank = F.row_number().over(Window.partitionBy("file_path", "line", "category").orderBy(F.desc(severity_rank(F.col("severity"))), "ord"))
    return findings.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
