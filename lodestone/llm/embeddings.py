"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

Each of `TABLES` tables rotates a vector `FUNCTIONS` times (three rounds of random signs and a fast Hadamard transform)
and takes the nearest signed axis each time; the axes together are its bucket. Multiprobe: a vector also enters the
buckets one axis away whose second-nearest axis was nearly the nearest, `PROBES` in all. Keys cross the shuffle first, with
ids only; a vector follows to the buckets that it shares with another. There vectors are compared exactly, in double
precision; a pair is counted in the first bucket that it shares, so counts are right though no pair is ever written out.
A bucket of any size is dealt to tasks in pairs of blocks.

Equal vectors are one class from the start: only one of each class is hashed, with the class's size as its weight.

Defined results: a vector that is null, empty, zero, or holds a null, NaN or infinite component links with nothing and
is its own component; a null id has a null component and isn't kept; vectors of different lengths never link; repeated
rows are vectors of their own, linked with each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lodestone.llm.common import cut, mix64, shuffle_width
from lodestone.llm.components import components

TABLES, FUNCTIONS, PROBES, COSINE, BLOCK, SEED = 12, 3, 3, 0.9, 2048, 20240229
#: Low bits of a key that tell its table.
TABLE_BITS = 6
#: Rows of small buckets that are compared together.
TOGETHER = 1 << 14


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_keys(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Bucket keys (vectors x tables * probes) of nonzero vectors of one length; a table's first key is its nearest bucket.

    A key is a hash of the bucket's axes above `TABLE_BITS` bits for its table, so it is a bucket of one table and length.
    """
    n, dim = x.shape
    wide = max(2, 1 << (dim - 1).bit_length())
    y0 = np.zeros((n, wide))
    y0[:, :dim] = unit(x)
    rng = np.random.default_rng([seed, dim])
    out = np.empty((n, tables, probes), dtype=np.int64)
    rows = np.arange(n)
    for t in range(tables):
        axes, gaps = np.empty((n, functions, 2), dtype=np.int64), np.empty((n, functions))
        for f in range(functions):
            y = y0
            for _ in range(3):
                y = _hadamard(y * rng.choice((-1.0, 1.0), size=wide))
            size = np.abs(y)
            for r in range(2):
                at = size.argmax(axis=1)
                axes[:, f, r] = 2 * at + (y[rows, at] < 0)
                gaps[:, f] = size[rows, at] if r == 0 else gaps[:, f] - size[rows, at]
                size[rows, at] = -1
        order = np.argsort(gaps, axis=1)
        for p in range(probes):  # the nearest, then with one axis exchanged, the closest call first
            code = np.full(n, t + tables * dim, dtype=np.int64)
            for f in range(functions):
                swapped = (order[:, p - 1] == f) if 0 < p <= functions else np.zeros(n, bool)
                code = code * (2 * wide) + np.where(swapped, axes[:, f, 1], axes[:, f, 0])
            code = (mix64(code.view(np.uint64)) >> np.uint64(TABLE_BITS + 1) << np.uint64(TABLE_BITS)) | np.uint64(t)
            out[:, t, p] = code.view(np.int64) if p <= functions else out[:, t, 0]
    return out.reshape(n, tables * probes)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("x").to_pylist()
        dims = np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            keys = bucket_keys(np.array([vectors[i] for i in at], dtype=np.float64))
            yield pa.record_batch({"rep": batch.column("rep").take(pa.array(at)), "keys": pa.array(list(keys), pa.list_(pa.int64()))})


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def by_table(keys: list[np.ndarray]) -> np.ndarray:
    """Keys of vectors as an array (vectors x tables x probes), in ascending order in each table; -1 where there is none."""
    out = np.full((len(keys), TABLES, PROBES), -1, dtype=np.int64)
    size = np.array([len(k) for k in keys])
    flat, row = np.concatenate([np.zeros(0, np.int64), *keys]), np.repeat(np.arange(len(keys)), size)
    table = flat & ((1 << TABLE_BITS) - 1)
    order = np.lexsort((flat, table, row))
    flat, row, table = flat[order], row[order], table[order]
    cell = row * TABLES + table
    first = np.searchsorted(cell, cell)
    out[row, table, np.arange(len(flat)) - first] = flat
    return out


def is_first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether `key`, which the vectors a and b share, is the first one that they do, by table and then by number."""
    out = np.ones(len(a), dtype=bool)
    left = np.arange(len(a))
    for t in range(keys.shape[1]):
        table = key[left] & ((1 << TABLE_BITS) - 1)
        left = left[table >= t]  # those whose own table is past are settled
        if not len(left):
            break
        x, y, own = keys[a[left], t], keys[b[left], t], key[left]
        earlier = np.zeros(len(left), dtype=bool)
        for i in range(keys.shape[2]):
            met = np.zeros(len(left), dtype=bool)
            for j in range(keys.shape[2]):
                met |= x[:, i] == y[:, j]
            earlier |= met & (x[:, i] != -1) & (((own & ((1 << TABLE_BITS) - 1)) > t) | (x[:, i] < own))
        out[left[earlier]] = False
        left = left[~earlier]
    return out


_LINKS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


class _Units:
    """Some whole units, sorted: ids, weights, sides, vectors as units of length 1, keys."""

    def __init__(self, table: pa.Table, dim: int):
        self.rep, self.weight, self.side, self.key = (table[c].to_numpy() for c in ("rep", "weight", "side", "key"))
        x = table["x"].combine_chunks()
        self.x = unit(x.flatten().to_numpy().astype(np.float64).reshape(-1, dim))
        keys = table["keys"].combine_chunks()
        flat, ends = keys.values.to_numpy(), keys.offsets.to_numpy()
        self.keys = by_table([flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)])
        self.n, self.parent = np.zeros(len(self.rep), dtype=np.int64), np.arange(len(self.rep))

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Counts and ties close pairs of places."""
        differ = self.rep[i] != self.rep[j]
        i, j = i[differ], j[differ]
        for a, b in zip(*np.unique(np.stack([i, j]), axis=1), strict=True) if len(i) < len(self.rep) else _tree(i, j, len(self.rep)):
            ra, rb = _root(self.parent, a), _root(self.parent, b)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
        for p in range(0, len(i), 100_000):
            a, b = i[p : p + 100_000], j[p : p + 100_000]
            own = is_first_shared(self.keys, a, b, self.key[a])
            a, b = a[own], b[own]
            np.add.at(self.n, a, self.weight[b])
            np.add.at(self.n, b, self.weight[a])

    def meet(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Pairs of places that a unit compares."""
        return (self.side[i] == 2) | (self.side[i] != self.side[j])

    def compare(self, starts: np.ndarray, cosine: float) -> pa.RecordBatch:
        ends = np.append(starts[1:], len(self.rep))
        of = np.repeat(np.arange(len(starts)), ends - starts)
        small = (ends - starts <= 64)[of]
        for lag in range(1, 64):
            i = np.flatnonzero(small[: len(of) - lag] & (of[: len(of) - lag] == of[lag:])) if lag < len(of) else np.zeros(0, int)
            if not len(i):
                break
            i = i[self.meet(i, i + lag)]
            close = np.einsum("ij,ij->i", self.x[i], self.x[i + lag]) >= cosine
            self.link(i[close], i[close] + lag)
        for lo, hi in zip(starts, ends, strict=True):
            if hi - lo <= 64:
                continue
            for s in range(lo, hi, 512):
                i, j = np.nonzero(self.x[s : min(s + 512, hi)] @ self.x[s:hi].T >= cosine)
                i, j = i + s, j + s
                keep = (i < j) & self.meet(i, j)
                self.link(i[keep], j[keep])
        root = np.array([_root(self.parent, i) for i in range(len(self.rep))], dtype=np.int64)
        tied = (root != np.arange(len(root))) | (self.n > 0)
        return pa.record_batch({"rep": self.rep[tied], "n": self.n[tied], "root": self.rep[root[tied]]}, schema=_LINKS)


def _linked(cosine: float):
    """Links of sorted units; small ones of one vector length are compared together, a large one alone."""

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = np.diff(table["x"].combine_chunks().offsets.to_numpy())
        for dim in np.unique(dims):
            own = table.filter(pa.array(dims == dim))
            at = np.stack([own[c].to_numpy() for c in ("key", "lo", "hi")])
            starts = np.flatnonzero(np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(axis=0)]))
            yield _Units(own, dim).compare(starts, cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= TOGETHER:
                at = np.stack([held[c].to_numpy() for c in ("key", "lo", "hi")])
                last = int(np.flatnonzero((at != at[:, -1:]).any(axis=0))[-1]) + 1 if (at != at[:, -1:]).any() else 0
                if last:  # the last unit may go on in the next batch
                    yield from flush(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield from flush(held)

    return run


def _tree(i: np.ndarray, j: np.ndarray, n: int):
    """Enough of the links (i, j) to hold together what they hold together: labels fall to the smallest until they settle."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if np.array_equal(low, label):
            at = np.flatnonzero(label != np.arange(n))
            return zip(at, label[at], strict=True)
        label = low


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors(vec_id, embedding)`."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)  # single precision crosses shuffles as it is
    x = F.col("embedding") if single else F.transform("embedding", lambda e: e.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).select("vec_id", F.when(good, F.col("x")).alias("x"))
    classes = rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    classes = cut(classes.select("x", "first", "weight", F.monotonically_increasing_id().alias("rep")))  # ids may repeat: a class has a number
    width = shuffle_width(vectors.sparkSession)
    hashed = cut(classes.select("rep", "x").mapInArrow(_hashed, "rep long, keys array<long>"))
    entered = hashed.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    shared = entered.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("k"), F.ceil(F.col("c") / block).cast("int").alias("s"))
    buckets = entered.join(shared, F.col("key") == F.col("k")).groupBy("rep").agg(F.collect_list(F.struct("key", "s")).alias("b"))  # TABLES * PROBES at most
    met = classes.join(buckets, "rep").select("rep", "weight", "x", F.transform("b", lambda b: b["key"]).alias("keys"), F.explode("b").alias("b"))
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("b.s").cast("long")).cast("int")
    met = met.select("rep", "weight", "x", "keys", F.col("b.key").alias("key"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("b.s") - 1)).alias("other"))
    dealt = met.select(
        "rep", "weight", "x", "keys", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    links = cut(dealt.repartition(width, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep").mapInArrow(_linked(cosine), "rep long, n long, root long"))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    named = classes.join(parts, F.col("rep") == F.col("node")).groupBy("component").agg(F.min("first").alias("least"))
    judged = (
        classes.join(counts, "rep", "left")
        .join(parts.join(named, "component").select("node", "least"), F.col("rep") == F.col("node"), "left")
        .select("x", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("least", "first").alias("c"))
    )
    found = rows.where("x is not null").join(judged, "x").select("vec_id", "n", "c")
    out = found.unionByName(rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("c")))
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("c"), F.lit(False)).alias("kept"))
