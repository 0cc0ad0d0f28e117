"""Readers and writers of files as tables: documents of any known format, JSON stores, collections.

SRC-01..09/18/28, SNK-01/03, PIP-12, DML-06. Documents are `binaryFile` rows that Arrow batches turn into text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.office import extract

MAX_BYTES = 64 << 20


def _extractor():
    @F.arrow_udf("text string, error string")
    def extracted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for content, extension in batches:
            rows = [extract(c, e) for c, e in zip(content.to_pylist(), extension.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["text", "error"])

    return extracted


def parse_documents(files: DataFrame, most_chars: int = 24_000, most_bytes: int = MAX_BYTES) -> DataFrame:
    """PIP-12: (path, extension, text, error) of `binaryFile` rows; files beyond `most_bytes` aren't read (SRC-28)."""
    rows = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    small = rows.where(F.col("length") <= most_bytes).withColumn("p", _extractor()("content", "extension"))
    out = small.select("path", "extension", F.substring("p.text", 1, most_chars).alias("text"), F.col("p.error").alias("error"))
    large = rows.where(F.col("length") > most_bytes).select("path", "extension", F.lit(None).cast("string").alias("text"), F.lit("too-large").alias("error"))
    return out.unionByName(large)


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return parse_documents(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def read_json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-05..08: one JSON document or array; what doesn't parse gives rows of nulls, which are left out."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return rows.where(~F.coalesce(F.forall(F.array(*[F.col(c).isNull() for c in rows.columns]), lambda x: x), F.lit(False)))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: conversations of a store, a row for each message."""
    rows = read_json_store(spark, path, "id string, title string, timestamp double, archived boolean, messages array<struct<role:string,content:string>>")
    return rows.select("id", "title", "timestamp", F.coalesce("archived", F.lit(False)).alias("archived"), F.posexplode_outer("messages").alias("turn", "m")).select("id", "title", "timestamp", "archived", "turn", "m.role", "m.content")


def read_checkpoint(spark: SparkSession, path: str, now_ms: int, version: int = 2, most_age_ms: int = 86_400_000) -> DataFrame:
    """SRC-09: snapshots of the right version that have a plan and are no older than a day."""
    rows = read_json_store(spark, path, "version int, savedAt long, plan array<string>, findings array<string>")
    return rows.where((F.col("version") == version) & F.col("plan").isNotNull() & (F.lit(now_ms) - F.col("savedAt") <= most_age_ms))


def write_collection(chunks: DataFrame, path: str) -> None:
    """SNK-01: chunks by collection, so that a scan of one collection reads its own files only."""
    chunks.write.mode("append").partitionBy("collection").parquet(path)


def read_collection(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """SRC-01..04: all chunks or those of a collection, by partition pruning."""
    rows = spark.read.parquet(path)
    return rows if collection is None else rows.where(F.col("collection") == collection)


def export_json(rows: DataFrame, path: str) -> None:
    """SNK-03: a copy as JSON lines."""
    rows.write.mode("errorifexists").json(path)


def rewrite_collection(spark: SparkSession, old: str, new: str) -> int:
    """DML-06: a verified copy under a new path; raises unless all chunks arrived. The old path stays until it is dropped."""
    rows = spark.read.parquet(old)
    rows.write.partitionBy("collection").parquet(new)
    want, got = rows.count(), spark.read.parquet(new).count()
    if want != got:
        raise RuntimeError(f"copied {got} of {want} chunks")
    return got
