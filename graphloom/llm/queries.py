"""The llm operators applied to whole tables, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import idfile

    manifest = idfile.write(table(spark, sf_dir, "documents"), common.work_path(spark, "ids"))
    return idfile.digest(manifest)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dedup

    return dedup.decide(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=toxicity.held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (common.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    docs = table(spark, sf_dir, "documents").select("doc_id", (common.crc_mod("doc_id", 7) == 2).alias("held_out"), "text")
    return lm.score(docs, lm.train(docs.where("NOT held_out")))


def op7_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quoting

    return quoting.link(table(spark, sf_dir, "conversations"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    decided = mixing.mix(table(spark, sf_dir, "documents")).decisions
    return decided.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_cut

    pages = table(spark, sf_dir, "pages")
    return html_cut.extract(pages.select("page_id", "url", "html"), html_cut.train(pages))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import spelling

    return spelling.variants(table(spark, sf_dir, "documents"), misspell=31)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fim

    made = fim.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored()).alias("restored_sha256"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Texts without white space, as text equality sees them.
_NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

#: The words of op13's texts.
_LISTED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op1_pivot_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.rid, q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v x ON q.rid <> x.rid WHERE q.vec_id % 20 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_NORM} AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM d""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        c AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
        f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c),
        p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
    "op13_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LISTED} AS w FROM documents), q AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LISTED} AS w FROM benchmark WHERE item_id IS NOT NULL),
        iw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM q WHERE len(w) > 0)),
        ms AS (SELECT DISTINCT m FROM iw), dk AS (SELECT rid, w, unnest(generate_series(1, len(w))) AS k FROM d),
        dw AS (SELECT rid, k, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM dk, ms WHERE k + m - 1 <= len(w)),
        found AS (SELECT rid, k, dw.m, item FROM dw JOIN iw ON dw.m = iw.m AND dw.s = iw.s),
        hit AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(generate_series(k, k + m - 1)) AS x FROM found) GROUP BY rid),
        its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
