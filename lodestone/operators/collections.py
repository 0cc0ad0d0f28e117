"""Upkeep of chunk collections as set operations on immutable tables: the result is the new table, never a change in place.

FLT-03, JN-08, SET-02, TOP-04/08/09, AGG-12/13, SNK-04, DML-01..05/07/08/09, TAB-03, FLT-13, MSC-04. Chunks are (collection,
id, content, source_id, indexed_at); a missing indexed_at counts as 0, the oldest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import chunking
from lodestone.operators import retrieval

MAX_CHUNKS, MAX_MB, EXPORT_PAGE, EXPORT_MOST = 10_000, 500.0, 2000, 2000


def has_prefix(chunk_id: Column, source_id: Column, prefix: str) -> Column:
    """FLT-03: the id itself or its chunks and messages, or a source of that name."""
    return (chunk_id == prefix) | chunk_id.startswith(prefix + "_") | chunk_id.startswith(prefix + "#") | F.coalesce((source_id == prefix) | source_id.startswith(prefix + "#"), F.lit(False))


def targets(chunks: DataFrame, ids: list[str] = (), prefixes: list[str] = (), source_ids: list[str] = ()) -> DataFrame:
    """DML-05, SET-02: chunks that any selector meets; without a selector it is an error."""
    tests = [F.col("id").isin(list(ids))] if ids else []
    tests += [F.coalesce(F.col("source_id").isin(list(source_ids)), F.lit(False))] if source_ids else []
    tests += [has_prefix(F.col("id"), F.col("source_id"), p) for p in prefixes]
    if not tests:
        raise ValueError("delete needs ids, prefixes or source_ids")
    return chunks.where(reduce(Column.__or__, tests))


def delete(chunks: DataFrame, **selectors) -> DataFrame:
    gone = targets(chunks, **selectors).select("collection", "id").distinct()
    return chunks.join(gone, ["collection", "id"], "left_anti")


def oldest(chunks: DataFrame, n: int) -> DataFrame:
    """TOP-04: the n oldest of one collection."""
    return chunks.orderBy(F.coalesce("indexed_at", F.lit(0.0)), "id").limit(n)


def evict_oldest(chunks: DataFrame, n: int) -> DataFrame:
    return chunks.join(oldest(chunks, n).select("collection", "id"), ["collection", "id"], "left_anti")


def evict_share(chunks: DataFrame, share: float = 0.2) -> DataFrame:
    """DML-04: every collection without its oldest fifth, at least one chunk. Ids and ages are ranked; content is not moved for that."""
    order = Window.partitionBy("collection").orderBy(F.coalesce("indexed_at", F.lit(0.0)), "id")
    size = chunks.groupBy("collection").agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("_drop"))
    aged = chunks.select("collection", "id", "indexed_at").withColumn("_r", F.row_number().over(order)).join(size, "collection")
    return chunks.join(aged.where(F.col("_r") <= F.col("_drop")).select("collection", "id"), ["collection", "id"], "left_anti")


def without(chunks: DataFrame, collection: str | None = None) -> DataFrame:
    """SNK-05: chunks without one collection, or none at all."""
    return chunks.limit(0) if collection is None else chunks.where(~F.coalesce(F.col("collection") == collection, F.lit(False)))


def stats(chunks: DataFrame) -> DataFrame:
    """AGG-12: chunks of each collection and of all (`*`)."""
    return chunks.rollup("collection").agg(F.count("*").alias("n_chunks")).select(F.coalesce("collection", F.lit("*")).alias("collection"), "n_chunks")


def export_page(chunks: DataFrame, offset: int, limit: int = EXPORT_PAGE) -> DataFrame:
    """SNK-04, TOP-09: a page of all collections in order of (collection, id), with its position."""
    limit, offset = max(1, min(EXPORT_MOST, limit)), max(0, offset)
    return chunks.orderBy("collection", "id").offset(offset).limit(limit)


def chunk_rows(texts: DataFrame, chunks: Column) -> DataFrame:
    """TAB-03: a row for each chunk; a lone chunk keeps its text's id, others are `<id>_chunk<i>`."""
    cut = texts.withColumn("_c", chunks).withColumn("_n", F.size("_c"))
    flat = cut.select(*texts.columns, "_n", F.posexplode("_c").alias("chunk_index", "content"))
    name = F.when(F.col("_n") == 1, F.col("id")).otherwise(F.concat("id", F.lit("_chunk"), F.col("chunk_index")))
    kept = [c for c in texts.columns if c not in ("id", "text")]
    return flat.select(*kept, F.col("id").alias("source_id"), name.alias("id"), "chunk_index", "content")


def upsert(chunks: DataFrame, new: DataFrame, replace_ids: list[str], cap: int = MAX_CHUNKS, strict: bool = False) -> DataFrame:
    """DML-01/02/03: the table after indexing `new`: replaced sources out, the oldest out where the cap was reached, new in.

    Empty `new` changes nothing unless `strict`. The cap is tested before the new chunks, so one call may overshoot it.
    """
    if not strict and new.isEmpty():
        return chunks
    kept = delete(chunks, ids=replace_ids, prefixes=replace_ids, source_ids=replace_ids) if replace_ids else chunks
    count, more = kept.count(), new.count()
    if count >= cap:
        kept = evict_oldest(kept, min(count, count + more - cap))
    return kept.unionByName(new, allowMissingColumns=True)


@dataclass(frozen=True)
class Indexed:
    """What a request to index came to: texts and chunks that are in, chunks that were refused, and why."""

    indexed: int
    chunks: int
    rejected: int = 0
    reason: str = ""


def index(
    chunks: DataFrame, texts: DataFrame, collection: str, replace_ids: tuple[str, ...] = (), max_chunks: int = MAX_CHUNKS, max_mb: float = MAX_MB, prune: bool = True, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP,
    embedder: Callable | None = None,
) -> tuple[DataFrame, Indexed]:
    """DML-01/02/03: the table after indexing `texts(id, text, source_id)` into a collection, and what came of it.

    Texts are cut into chunks; without any nothing changes. Then, in this order: chunks of the replaced sources go; at the cap of
    chunks the oldest make room or, without `prune`, the request is refused; at the cap of MiB over all collections every one
    gives its oldest fifth or, without `prune`, the request is refused; chunks are embedded and come in. A refusal keeps
    what replacing removed. The caps are tested before the new chunks, so one request may overshoot them.
    """
    given = texts.withColumn("source_id", F.coalesce(F.col("source_id"), F.col("id"))) if "source_id" in texts.columns else texts.withColumn("source_id", F.col("id"))
    cut = given.select("id", F.col("source_id").alias("_s"), chunking.chunker(chunking.chunk_text, size, overlap)("text").alias("_c"))
    flat = cut.select("id", "_s", F.size("_c").alias("_n"), F.posexplode("_c").alias("_i", "content"))
    name = F.when(F.col("_n") == 1, F.col("id")).otherwise(F.concat("id", F.lit("_chunk"), F.col("_i")))
    new = flat.select(F.lit(collection).alias("collection"), name.alias("id"), F.col("_s").alias("source_id"), F.unix_timestamp(F.current_timestamp()).cast("double").alias("indexed_at"), "content")
    count, n_texts = new.count(), texts.count()
    if not count:
        return chunks, Indexed(n_texts, 0)
    mine, others = chunks.where(F.col("collection") == collection), chunks.where(~F.coalesce(F.col("collection") == collection, F.lit(False)))
    if replace_ids:
        mine = delete(mine, source_ids=list(replace_ids))
    have = mine.count()
    if 0 < max_chunks <= have:
        if not prune:
            reason = f"Collection '{collection}' is at its cap of {max_chunks} chunks and auto-pruning is disabled. Clear some space or enable auto-prune."
            return others.unionByName(mine), Indexed(0, 0, count, reason)
        mine = evict_oldest(mine, min(have, have + count - max_chunks)) if have + count > max_chunks else mine
    kept = others.unionByName(mine)
    if max_mb > 0:
        mb = kept.agg(F.sum(F.octet_length("content")) / (1 << 20)).first()[0] or 0.0
        if mb >= max_mb and not prune:
            return kept, Indexed(0, 0, count, f"Total storage estimated at {mb:.0f} MB exceeds the {max_mb:g} MB cap and auto-pruning is disabled. Clear some space or enable auto-prune.")
        kept = evict_share(kept) if mb >= max_mb else kept
    return kept.unionByName(retrieval.embed(new, embedder) if "embedding" in chunks.columns else new, allowMissingColumns=True), Indexed(n_texts, count)


#: The collection of remembered facts and what their ids begin with.
MEMORY, FACT_PREFIX = "conversations", "update_"


def fact_id(about: Column) -> Column:
    """DML-07: the id of the fact about a topic: letters and digits in lower case, other runs as one underscore."""
    return F.concat(F.lit(FACT_PREFIX), F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(about, F.lit(""))), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", ""))


def remember(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """DML-07: chunks after `facts(about, new_fact, at)`: of each topic the newest fact, in the place of the one before."""
    new = facts.groupBy(fact_id(F.col("about")).alias("id")).agg(F.max(F.struct("at", "new_fact")).alias("f")).select(F.lit(MEMORY).alias("collection"), "id", F.col("f.new_fact").alias("content"))
    return chunks.join(new.select("collection", "id"), ["collection", "id"], "left_anti").unionByName(new, allowMissingColumns=True)


def forget(chunks: DataFrame, topics: DataFrame) -> DataFrame:
    """DML-07: chunks without the facts about `topics(about)`; nothing else can be forgotten."""
    gone = topics.select(F.lit(MEMORY).alias("collection"), fact_id(F.col("about")).alias("id")).distinct()
    return chunks.join(gone, ["collection", "id"], "left_anti")


def merge_front(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """DML-08: rows of `new` replace those of `old` and come last in `seq` order, which is the front of a newest-first list."""
    top = old.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_top"))
    moved = new.crossJoin(F.broadcast(top)).withColumn(seq, F.col("_top") + F.row_number().over(Window.orderBy(key))).drop("_top")
    return old.join(new.select(key), key, "left_anti").unionByName(moved, allowMissingColumns=True)


def newest(rows: DataFrame, seq: str, n: int) -> DataFrame:
    """TOP-08: the n newest rows; ties by all that is in `seq`'s struct."""
    return rows.orderBy(F.desc(seq)).limit(n)


def cache_hits(entries: DataFrame, now: Column) -> DataFrame:
    """FLT-13: entries no older than their time to live; age equal to it is still a hit."""
    return entries.where(now - F.col("cached_at") <= F.col("ttl"))


def cache_stats(entries: DataFrame) -> DataFrame:
    """AGG-13: entries by type and in all."""
    return entries.rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("*")).alias("type"), "n")


def storage_mb(chunks: DataFrame) -> DataFrame:
    """MSC-04: MiB of content by collection."""
    return chunks.groupBy("collection").agg((F.sum(F.octet_length("content")) / (1 << 20)).alias("mib"))
