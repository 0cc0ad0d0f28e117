"""Exact cosine, BM25 and reciprocal-rank-fused retrieval over collections of chunks.

TOP-01/02/03, JN-01/02/11/12, AGG-14/15/17, SCA-53/54/55, WIN-01, PIP-01, UDF-03/04. A chunk is (collection, id, content,
embedding). Ties go to the smaller id. Queries are small relations that are broadcast; corpora are never collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """SCA-53: cosine similarity in double precision, cut to [0, 1]; null for a zero vector."""
    return F.least(F.greatest(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0)), F.lit(1.0))


def dense_topk(chunks: DataFrame, query: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """TOP-01: the k chunks nearest to the one query vector of `query(q)`, over all chunks or in each group of `by`."""
    scored = chunks.crossJoin(F.broadcast(query.select("q").limit(1))).select(*by, "id", cosine(F.col("embedding"), F.col("q")).alias("score")).where("score is not null")
    if not by:
        return scored.orderBy(F.desc("score"), "id").limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def is_zero(embedding: Column) -> Column:
    """Whether a vector has no component but zeros; such vectors are refused."""
    return ~F.exists(embedding, lambda x: x != 0)


def postings(chunks: DataFrame) -> DataFrame:
    """(collection, id, term, tf, len): one row for each term of a chunk."""
    words = chunks.select("collection", "id", tokens(F.col("content")).alias("t"))
    flat = words.select("collection", "id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return flat.groupBy("collection", "id", "len", "term").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """AGG-14: documents and mean length of each collection."""
    return chunks.select("collection", F.size(tokens(F.col("content"))).alias("n")).groupBy("collection").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.avg("n").alias("avg_len"))


def term_idf(post: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """SCA-54: a term's inverse document frequency; negative ones become epsilon times the collection's mean."""
    df = post.groupBy("collection", "term").agg(F.count("*").alias("df")).join(stats, "collection")
    raw = df.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("collection").agg(F.avg("raw").alias("mean"))
    return raw.join(mean, "collection").select("collection", "term", "df", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))


def _words(chunks: DataFrame) -> DataFrame:
    """(collection, id, t): each chunk's words. A generated row keeps the optimizer from reading a text again for every use of `t`."""
    return chunks.select("collection", "id", F.explode(F.array(tokens(F.col("content")))).alias("t"))


def _query_stats(words: DataFrame, terms: list[str], epsilon: float = EPSILON) -> DataFrame:
    """(collection, avg_len, idf): one row a collection, idf an array by place in `terms`; null where no document has a term.

    One pass over the documents' distinct terms: partial counts by term, then by how many documents have a term, which is a
    short table, of which the mean that negative frequencies become a part of follows. A null term stands for the document.
    """
    flat = words.select("collection", F.size("t").alias("len"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
    by_term = flat.groupBy("collection", "term").agg(F.count("*").alias("df"), F.sum("len").alias("n"))
    by_df = by_term.groupBy("collection", F.col("term").isNull().alias("whole"), F.when(F.col("term").isin(terms), F.col("term")).alias("term"), "df").agg(F.count("*").alias("terms"), F.sum("n").alias("n"))
    every = Window.partitionBy("collection")
    told = by_df.withColumn("docs", F.max(F.when(F.col("whole"), F.col("df"))).over(every)).withColumn("avg_len", F.max(F.when(F.col("whole"), F.col("n"))).over(every) / F.col("docs"))
    told = told.withColumn("raw", F.when(~F.col("whole"), F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    told = told.withColumn("mean", F.sum(F.col("raw") * F.col("terms")).over(every) / F.sum(F.when(~F.col("whole"), F.col("terms"))).over(every))
    idf = F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw"))
    return told.groupBy("collection").agg(F.first("avg_len").alias("avg_len"), F.array(*(F.max(F.when(F.col("term") == t, idf)) for t in terms)).alias("idf"))


def bm25_scores(chunks: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """JN-12, SCA-54: (collection, id, score) of the chunks that score above 0 for the query.

    Query terms count as often as they are given. Each chunk counts them in its own words; no posting crosses a shuffle.
    """
    asked = Counter(re.findall(r"[a-z0-9]+", query.lower()))
    if not asked:
        return chunks.select("collection", "id", F.lit(0.0).alias("score")).limit(0)
    words = _words(chunks)
    own = words.select("collection", "id", F.struct(F.size("t").alias("len"), F.filter("t", lambda x: x.isin(list(asked))).alias("t")).alias("w"))
    met = own.select("collection", "id", "w.len", "w.t").join(_query_stats(words, list(asked)), "collection")
    count = lambda term: F.size(F.filter("t", lambda x: x == term))
    score = F.lit(0.0)
    for i, (term, qf) in enumerate(asked.items()):
        tf = count(term)
        score = score + F.when(tf > 0, qf * F.col("idf")[i] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).otherwise(0.0)
    return met.select("collection", "id", score.alias("score")).where("score > 0")


def bm25(chunks: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """The same, with scores over their collection's best (AGG-15): a maximum that is joined, not a window over all hits."""
    scored = bm25_scores(chunks, query, k1, b)
    return scored.join(scored.groupBy("collection").agg(F.max("score").alias("best")), "collection").select("collection", "id", "score", F.least(F.col("score") / F.col("best"), F.lit(1.0)).alias("normalized"))


def lexical_topk(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """TOP-02/03: the k best chunks of each collection, with scores over the best and `rank0`; only those are compared further."""
    top = ranked(bm25_scores(chunks, query).withColumn("score", F.round("score", 9)), "score", k)
    return top.withColumn("normalized", F.least(F.col("score") / F.max("score").over(Window.partitionBy("collection")), F.lit(1.0)))


def ranked(hits: DataFrame, score: str, k: int, by: tuple[str, ...] = ("collection",)) -> DataFrame:
    """TOP-02: `rank0`, from 0, of the k best of each group."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "id")
    return hits.withColumn("rank0", F.row_number().over(order) - 1).where(F.col("rank0") < k)


def listed(hits: DataFrame) -> DataFrame:
    """Ranks over the collections' lists one behind the other, in order of their names: what fusion ranks by."""
    return hits.withColumn("rank0", F.row_number().over(Window.orderBy("collection", "rank0")) - 1)


def rrf(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """JN-01, SCA-55: ids of ranked lists (id, rank0) with the sum of 1 / (k + rank0 + 1)."""
    every = lists[0].select("id", "rank0")
    for more in lists[1:]:
        every = every.unionByName(more.select("id", "rank0"))
    return every.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank0") + 1)).alias("rrf"))


def hybrid(chunks: DataFrame, query_text: str, query_vector: DataFrame, k: int, score: Callable[[list[str]], list[float] | None] | None = None, rerank_k: int = 20) -> DataFrame:
    """PIP-01: dense and BM25 lists of 2k fused by rank; the score shown is the dense one, else BM25's (JN-02), to four places.

    With `score`, the best `rerank_k` (k to 50), if there are k of them, are scored anew and ordered by that.
    """
    dense = dense_topk(chunks, query_vector, 2 * k, by=("collection",)).withColumn("rank0", F.col("rank") - 1)
    lexical = lexical_topk(chunks, query_text, 2 * k)
    fused = rrf(listed(lexical), listed(dense))
    shown = fused.join(dense.select("id", F.col("score").alias("d")), "id", "left").join(lexical.select("id", F.col("normalized").alias("l")), "id", "left")
    shown = shown.select("id", "rrf", F.round(F.coalesce("d", "l", F.lit(0.0)), 4).alias("score")).orderBy(F.desc("rrf"), "id")
    if score is None:
        return shown.limit(k)
    few = shown.limit(max(k, min(rerank_k, 50)))
    if few.count() < k:
        return shown.limit(k)
    again = rerank(few.join(chunks.select("id", "content"), "id").repartition(1).sortWithinPartitions(F.desc("rrf"), "id"), score)
    return again.select("id", "rrf", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def coverage(hits: DataFrame) -> DataFrame:
    """AGG-17: the mean of the three best scores, at most 1."""
    return hits.orderBy(F.desc("score")).limit(3).agg(F.least(F.avg("score"), F.lit(1.0)).alias("coverage"))


def hash_embedder(dim: int = 64, batch: int = 100) -> Callable:
    """UDF-03: a deterministic stand-in for an embedding model: signed token hashes, summed and normalised, in batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for part in parts:
            for s in range(0, len(part), batch):
                rows = part.iloc[s : s + batch]
                out = np.zeros((len(rows), dim), dtype=np.float32)
                for i, text in enumerate(rows["content"].fillna("")):
                    for word in text.lower().split():
                        h = zlib.crc32(word.encode())
                        out[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                yield rows.assign(embedding=list(out / np.where(norm > 0, norm, 1)))

    return run


def embed(chunks: DataFrame, embedder: Callable | None = None) -> DataFrame:
    """Chunks with the embeddings of a model that maps batches of frames; texts without any token get a zero vector."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(embedder or hash_embedder(), fields + ", embedding array<float>")


def rerank(candidates: DataFrame, score: Callable[[list[str]], list[float] | None], batch: int = 10, most: int = 1200) -> DataFrame:
    """UDF-04: scores by an outside model in batches of texts cut to `most`; a batch without a usable reply keeps its own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s in range(0, len(part), batch):
                rows = part.iloc[s : s + batch].copy()
                got = score([t[:most] for t in rows["content"].fillna("")])
                good = got is not None and len(got) == len(rows)
                rows["score"] = [min(1.0, max(0.0, float(x))) for x in got] if good else rows["score"]
                rows["applied"] = good
                yield rows

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return candidates.mapInPandas(run, fields + ", applied boolean")
