"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embed_dedup, html_main, lang_id, mixing, ngram_join, ppm_score, secret_scan, token_count, token_store

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_tokens(_table(spark, sf_dir, "documents"))


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score.score(_table(spark, sf_dir, "documents"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_copies(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ended")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_table(spark, sf_dir, "documents"))


def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_ngram_jaccard, op2_secret_scan, op3_decontamination, op4_token_store, op5_ppm_score, op6_embed_dedup, op7_source_mixing, op8_token_count, op9_language_id, op10_html_main)}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
        ), half AS (
            SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 1.8 * c >= 0.8 * (na.n + nb.n) - 1e-9
        ), link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half), reach(a, b) AS (
            SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        ), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT d.doc_id, least(d.doc_id, coalesce(low.b, d.doc_id)) AS class_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links,
            d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
        FROM documents d LEFT JOIN low ON low.a = d.doc_id LEFT JOIN deg ON deg.a = d.doc_id
    """,
    "op6_embed_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        ), good AS (
            SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
            WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
        ), reach(a, b) AS (
            SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        ), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(low.b, v.vec_id)) AS component_id,
            v.vec_id = least(v.vec_id, coalesce(low.b, v.vec_id)) AS kept
        FROM v LEFT JOIN low ON low.a = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id
    """,
}
