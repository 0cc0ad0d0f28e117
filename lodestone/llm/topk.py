"""Exact top-k by inner product, in three phases with a uniform threshold.

A vector's score for a query is the sum of the partial scores of `slices` slices of its components. Queries and rows
meet in blocks; a block of rows holds its vectors' slices.

1. For each query and block, the `depth` best entries of every slice's score list are gathered and only those are summed
   up. The k-th best sum over all blocks is a safe cutoff t: at least k rows score that much. A row outside a block's
   lists scores at most the sum of the lists' last entries, the block's bound for the query.
2. t goes to the blocks whose bound reaches it; the others are done. A row that scores t or more has t / slices or more
   in at least one slice, so in those blocks the entries at or above that threshold are sufficient.
3. Their remaining slices are resolved in integers, and the k best of each query are kept, ties to the smaller id.

Defined results: a vector that is null, or holds a null, NaN or infinite component, takes no part, nor does a null id;
rows that repeat an id are rows of their own: each is a candidate, and each asks by itself where its id is asked for, its
own row alone left out; vectors of another length than the query's are not its candidates; fewer than k candidates give
all of them; empty tables give no rows. Scores are exact below 2 ** 63: sums are taken by floating point only where every
one of them is surely exact in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, shuffle_width

K, SLICES, DEPTH, QUERY_BLOCK, ROW_BLOCK, TILE = 20, 2, 256, 16384, 16384, 64
NONE = np.iinfo(np.int64).min // 8


def scaled(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """(row, id, v): each usable vector, its components floor(factor * x); row numbers tell repeated ids apart."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    )
    return cut(good.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("x", lambda e: F.floor(e * factor).cast("long")).alias("v")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in integers; by floating point where every sum is surely exact in it."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _sides(unit: pa.Table):
    """For each vector length: queries (table, matrix) and rows (row numbers, ids, matrix)."""
    dims = np.diff(unit["v"].combine_chunks().offsets.to_numpy()) if unit.num_rows else np.zeros(0, int)
    asks = unit["ask"].to_numpy()
    for dim in np.unique(dims):
        q, c = unit.filter(pa.array((dims == dim) & asks)), unit.filter(pa.array((dims == dim) & ~asks))
        if q.num_rows and c.num_rows:
            yield q, _matrix(q["v"]), c["row"].to_numpy(), c["id"].to_numpy(), _matrix(c["v"])


def partials(qm: np.ndarray, cm: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial scores (queries x rows) of each slice of the components."""
    edges = np.linspace(0, qm.shape[1], min(slices, max(1, qm.shape[1])) + 1).astype(int)
    return [_exact(qm[:, a:b], cm[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def lists(parts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The entries of the slices' score lists (queries x slices * depth) and the bound of all other rows; None where there are none."""
    n = parts[0].shape[1]
    if depth >= n:
        return np.broadcast_to(np.arange(n), (len(parts[0]), n)), None
    at = [np.argpartition(p, n - depth, axis=1)[:, n - depth :] for p in parts]
    return np.concatenate(at, axis=1), sum(np.take_along_axis(p, a, axis=1).min(axis=1) for p, a in zip(parts, at, strict=True))


_FOUND = pa.schema([("unit", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("hits", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64())), ("bound", pa.int64())])
_FOUND_DDL = "unit long, row long, id long, hits array<long>, scores array<long>, bound long"


def _found(rows: list[tuple]) -> pa.Table:
    return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)}, schema=_FOUND)


def _best(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    order = np.lexsort((ids[at], -scores))[:k]
    return ids[at[order]].tolist(), scores[order].tolist()


def _gather(k: int, slices: int, depth: int):
    """Phase 1."""

    def run(unit: pa.Table) -> pa.Table:
        out = []
        for q, qm, crow, cid, cm in _sides(unit):
            number, qrow, qid = (q[c].to_numpy() for c in ("unit", "row", "id"))
            for s in range(0, len(qm), TILE):
                parts = partials(qm[s : s + TILE], cm, slices)
                own = qrow[s : s + TILE, None] == crow[None, :]
                for p in parts:
                    p[own] = NONE
                entries, bound = lists(parts, max(k, depth))
                for i in range(len(entries)):
                    at = np.unique(entries[i])
                    at = at[crow[at] != qrow[s + i]]
                    out.append((number[s + i], qrow[s + i], qid[s + i], *_best(at, cid, sum(p[i, at] for p in parts), k), None if bound is None else bound[i]))
        return _found(out)

    return run


def _resolve(k: int, slices: int):
    """Phases 2 and 3, for queries whose cutoff a block's bound reaches."""

    def run(unit: pa.Table) -> pa.Table:
        out = []
        for q, qm, crow, cid, cm in _sides(unit):
            number, qrow, qid, cutoff = (q[c].to_numpy(zero_copy_only=False) if c != "cutoff" else q[c].to_pylist() for c in ("unit", "row", "id", "cutoff"))
            for s in range(0, len(qm), TILE):
                parts = partials(qm[s : s + TILE], cm, slices)
                bar = np.array([NONE if t is None else t // len(parts) for t in cutoff[s : s + TILE]], dtype=np.int64)
                enough = np.logical_or.reduce([p >= bar[:, None] for p in parts])
                for i in range(len(enough)):
                    at = np.flatnonzero(enough[i])
                    at = at[crow[at] != qrow[s + i]]
                    whole = sum(p[i, at] for p in parts)
                    if cutoff[s + i] is not None:
                        at, whole = at[whole >= cutoff[s + i]], whole[whole >= cutoff[s + i]]
                    out.append((number[s + i], qrow[s + i], qid[s + i], *_best(at, cid, whole, k), None))
        return _found(out)

    return run


def _met(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Groups of `unit`: rows(unit, row, id, v) beside asks(unit, row, id, v, cutoff)."""
    rows = rows.select("unit", "row", "id", "v", F.lit(None).cast("long").alias("cutoff"), F.lit(False).alias("ask"))
    return rows.unionByName(asks.select("unit", "row", "id", "v", "cutoff", F.lit(True).alias("ask"))).groupBy("unit")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's hits over all blocks."""
    hits = found.select("row", F.col("id").alias("query_id"), F.explode(F.arrays_zip("hits", "scores")).alias("h")).select("row", "query_id", F.col("h.hits").alias("vec_id"), F.col("h.scores").alias("score"))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, slices: int = SLICES, depth: int = DEPTH, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k best rows of `vectors(row, id, v)`, as `scaled` gives them, for each of `queries`, some of them: query_id, rank, vec_id, score."""
    total, asked = vectors.count(), queries.count()
    # at least a block a task, as far as blocks keep a thousand rows: queries are copied to every block of rows
    row_blocks, query_blocks = max(1, -(-total // row_block), min(shuffle_width(vectors.sparkSession), total // 1024)), max(1, -(-asked // query_block))
    block = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = vectors.withColumn("c", block(row_blocks, 3)).withColumn("q", every(query_blocks)).withColumn("unit", F.col("q") * row_blocks + F.col("c"))
    asks = queries.withColumn("q", block(query_blocks, 4)).withColumn("c", every(row_blocks)).withColumn("unit", F.col("q") * row_blocks + F.col("c"))
    first = cut(_met(rows, asks.withColumn("cutoff", F.lit(None).cast("long"))).applyInArrow(_gather(k, slices, depth), _FOUND_DDL))
    known = _ranked(first, k).groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select("row", F.col("least").alias("cutoff"))
    open_ = cut(first.where("bound is not null").select("unit", "row", "bound").join(known, "row", "left").where("cutoff is null or bound >= cutoff").select("unit", "row", "cutoff"))
    done = first.join(open_.select("unit", "row"), ["unit", "row"], "left_anti")
    if open_.isEmpty():
        found = done
    else:
        again = _met(rows.join(open_.select("unit").distinct(), "unit", "left_semi"), asks.join(open_, ["unit", "row"]))
        found = done.unionByName(again.applyInArrow(_resolve(k, slices), _FOUND_DDL))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def every_twentieth(embeddings: DataFrame) -> DataFrame:
    """The stated query set, rows whose id is divisible by 20, against all rows."""
    vectors = scaled(embeddings)
    return search(vectors, vectors.where("id % 20 = 0"))
