"""A training-data pipeline over `documents`: language, toxicity, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet in
the shared checkpoint folder and read again, so a lost executor never costs more than the stage at hand. All stages but
the last return the columns that they got. A document without text has no language and goes in the first stage; rows
that repeat an id are one document to the duplicate stage and stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, language, mixing, pieces, toxicity
from lodestone.llm.common import ensure_checkpoint_dir

#: Languages are told apart with a score near 1; below this a text is none of the learnt ones.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; text without letters and text that is unlike every learnt language go."""
    judged = docs.select(F.struct("*").alias("row"), language.predict(spark, F.col("text"), language.train(docs)).alias("said"))
    return judged.where((F.col("said.lang_pred") != "und") & (F.col("said.score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(spark, F.col("text"), machine) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return jaccard.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.emit(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and intact: each document's pieces, and whether they decode to its text."""
    return pieces.round_trip(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Trained models decide in the first two stages, and the last runs a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
