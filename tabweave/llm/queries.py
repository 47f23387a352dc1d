"""One query per operator over its whole table, and DuckDB twins where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabweave.llm import html_text, media, packing, piece_bpe, private_data, secret_scan, simhash, token_counts, toxicity, vector_dups


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op3_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.piece_ids(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def packed(docs: DataFrame) -> DataFrame:
    """``packing.pack`` with the byte-level vocabulary."""
    import public_tokenizers

    return packing.pack(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_main_text, op2_secret_scan, op3_vector_near_dups, op4_media_columns, op5_simhash_near_dups, op6_token_counts, op7_piece_ids, op8_private_data, op9_toxicity, op10_packing)
}

#: op3 as brute force: every pair of a label, and reachability by repeated expansion.
ORACLES: dict[str, str] = {
    "op3_vector_near_dups": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), n AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
), edges AS (
  SELECT a.vec_id AS u, b.vec_id AS w
  FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98
), reach(u, w) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.u, e.w FROM reach r JOIN edges e ON r.w = e.u
), c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u
), d AS (SELECT u, count(*) AS n_links FROM edges GROUP BY u)
SELECT v.vec_id, CAST(coalesce(d.n_links, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.u = v.vec_id LEFT JOIN d ON d.u = v.vec_id
""",
}
