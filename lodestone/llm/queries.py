"""The corpus operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, embeddings, jaccard, language, mixing, phrases, pieces, reputation, sharding, spelling, suffixes, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return reputation.judge(pages, reputation.page_outcomes(pages, _table(spark, sf_dir, "labels")))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=90)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (min(a.n) + min(b.n) - count(*))
), r AS (
  SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CAST(least(s.doc_id, coalesce(min(r.v), s.doc_id)) AS BIGINT) AS component_id
FROM s LEFT JOIN r ON r.u = s.doc_id GROUP BY s.doc_id, s.sh
"""


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_twentieth(_table(spark, sf_dir, "embeddings"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity, op2_language, op3_urls, op4_pieces, op5_sharding, op6_mixing, op7_jaccard, op8_chat, op9_embeddings, op10_topk,
        op11_passages, op12_spelling, op13_phrases,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_urls": reputation.SQL, "op6_mixing": mixing.SQL, "op7_jaccard": OP7_SQL, "op8_chat": chat.SQL, "op11_passages": suffixes.SQL, "op12_spelling": spelling.SQL, "op13_phrases": phrases.SQL}
