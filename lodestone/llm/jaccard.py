"""The n-gram Jaccard join: signature trees over documents that exact partition keys bring together.

Documents with equal shingle sets are one class, of which one representative goes on. Two sets a <= b of similarity
`percent` differ in at most (a + b)(100 - p) / (100 + p) shingles. Sizes are cut into ranges so that a linked pair lies
in one range or in two neighbours; for each range that bounds the difference by some D. A set's shingles are dealt by
hash into D + 1 + spare partitions, and each partition that isn't empty gives a key, the hash of all its shingles: a
linked pair agrees on at least 1 + spare partitions, so it shares a key unless both have more empty partitions than
spare ones, and such sets give keys for the empty ones too. No link is lost, however common a passage is. Below a
similarity of 0.85 partitions would hold too few shingles for that; there, keys are bands of eight smallest hashes, as
many as leave a pair right at the threshold without a key once in a thousand million, and pairs above it far less often.

Documents that keys connect form a cluster. A cluster of up to `BLOCK` documents and `SHINGLES` shingles is one task's
work. In a larger one every document is first compared with `HUBS` of the cluster's own. Those that link with a hub are of
its group; hubs that are linked, or that a document links with both, share one. A group is connected already, so what is
still compared are documents of different groups, and those of none with each other and with all the rest: groups are cut
into blocks by hash, and a task joins two blocks. A group of copies, however large, thus
costs `HUBS` comparisons a document. In a task signature trees do the join: a node holds the OR and the AND of its documents' shingle bitmaps and their size range, and a dual traversal
drops node pairs whose largest possible overlap is too small. What remains is compared exactly, unless the two are
already connected. Links give components by alternating stars.

Defined results: null text and text without words give an empty set and no link; a null id has its set's size and a
null component, and links with nothing; rows that repeat an id each get a row, with the component of that id; empty
tables give no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, mix64, shuffle_width
from lodestone.llm.components import components
from lodestone.llm.shingles import CHECK, set_hash, shingle_set

WORDS, PERCENT, BLOCK, SHINGLES, HUBS, FANOUT, PAIRS, SIG = 5, 80, 2000, 1 << 22, 4, 8, 1 << 15, (1 << 40) - 1
#: Ids that are sent to all tasks to pick texts by, at most; beyond, texts are exchanged by id.
SENT_IDS = 2_000_000
#: From this similarity on (per cent) keys are exact; rows a band below it.
CERTAIN, ROWS = 85, 8


@lru_cache(maxsize=8)
def size_ranges(percent: int, upto: int = 1 << 40) -> np.ndarray:
    """First sizes of the ranges: a set in range r links only with sets in r - 1, r and r + 1."""
    firsts = [1]
    while firsts[-1] <= upto:
        firsts.append(max(firsts[-1] + 1, 100 * (firsts[-1] - 1) // percent + 1))
    return np.array(firsts, dtype=np.int64)


def range_of(n: int, percent: int) -> int:
    return int(np.searchsorted(size_ranges(percent), n, side="right")) - 1


def difference(r: int, percent: int) -> int:
    """The most shingles that a linked pair differs in, its smaller set in range r."""
    a = int(size_ranges(percent)[r + 1]) - 1
    return (a + 100 * a // percent) * (100 - percent) // (100 + percent)


def _sums(mixed: np.ndarray, high: np.ndarray, parts: int) -> np.ndarray:
    """The sum of the mixed hashes of each of `parts` partitions; 0 for an empty one."""
    at = (high * np.uint64(parts)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.zeros(parts, dtype=np.uint64)
    out[at[start]] = np.add.reduceat(mixed, start)
    return out


def partition_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two linked sets that aren't equal share one for certain. shingles: sorted and distinct.

    For both ranges that the set may be linked in: D + 1 + spare partitions, a key for each that isn't empty; for the empty
    ones too where there are more of those than `spare`.
    """
    own, out = range_of(len(shingles), percent), []
    mixed, high = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)), shingles >> np.uint64(32)
    for r in (own - 1, own):
        if r < 0 or (most := difference(r, percent)) < 1:
            continue
        spare = 1 + most // 16
        total = _sums(mixed, high, most + 1 + spare)
        empty = total == 0
        keep = np.ones(len(total), bool) if empty.sum() > spare else ~empty
        label = np.arange(len(total), dtype=np.uint64)[keep] + np.uint64((r + 1) << 40)
        out.append(mix64(total[keep] ^ mix64(label)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


@lru_cache(maxsize=8)
def bands(percent: int) -> tuple[np.ndarray, int]:
    """Multipliers of band keys and rows a band: as many bands as leave a linked pair without a shared key once in 10 ** 9."""
    p = (percent / 100) ** ROWS
    n = int(np.ceil(np.log(1e-9) / np.log1p(-p)))
    return np.random.default_rng(97).integers(0, 1 << 32, n * ROWS, dtype=np.uint32) | np.uint32(1), n


def band_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """A key for each band of ROWS smallest hashes; sets that share a passage only hardly ever share one."""
    multiplier, n = bands(percent)
    mixed = mix64(shingles ^ np.uint64(0x2545F4914F6CDD1D))
    halves = (mixed >> np.uint64(32)).astype(np.uint32), mixed.astype(np.uint32)
    least = np.full(len(multiplier), 0xFFFFFFFF, dtype=np.uint32)
    for s in range(0, len(mixed), 256):
        for k in (0, 1):
            least[k::2] = np.minimum(least[k::2], (multiplier[k::2, None] * halves[k][None, s : s + 256]).min(axis=1))
    row = mix64(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << np.uint64(32)))
    return mix64(np.add.reduce(row.reshape(n, ROWS), axis=1, dtype=np.uint64)).view(np.int64)


def set_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys that bring linked sets together: exact partition keys from CERTAIN on, band keys below, where partitions would
    hold so few shingles that shared passages make keys."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    return partition_keys(shingles, percent) if percent >= CERTAIN else band_keys(shingles, percent)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for s in range(0, len(ids), 1000):
                n, sig, check = [], [], []
                for text in texts.slice(s, 1000).to_pylist():
                    own = shingle_set(text, k)
                    n.append(len(own))
                    sig.append(set_hash(own))
                    check.append(set_hash(own, CHECK))
                yield pa.record_batch({"doc_id": ids.slice(s, 1000), "n": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.int64()), "check": pa.array(check, pa.int64())})

    return run


_PACKED = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("ties", pa.binary())])


def _bucketed(name: str, bucket: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Packed pairs by bucket, as the column of that name."""
    order = np.argsort(bucket, kind="stable")
    bucket, left, right = bucket[order], left[order], right[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]]))
    data = [_pack(left[i:j], right[i:j]) for i, j in zip(start, [*start[1:], len(bucket)], strict=False)]
    none = [None] * len(data)
    return pa.record_batch({"bucket": bucket[start], "pairs": pa.array(data if name == "pairs" else none, pa.binary()), "ties": pa.array(data if name == "ties" else none, pa.binary())}, schema=_PACKED)


def _pack(key: np.ndarray, sig: np.ndarray) -> bytes:
    """Ten bytes a pair: forty bits of a key (beside those that its bucket tells) and forty of a set's hash."""
    out = np.empty((len(key), 10), dtype=np.uint8)
    out[:, :5] = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out[:, 5:] = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return out.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 10)
    wide = np.zeros((2, len(raw), 8), dtype=np.uint8)
    wide[0, :, :5], wide[1, :, :5] = raw[:, :5], raw[:, 5:]
    return wide[0].view("<u8").ravel(), wide[1].view("<u8").ravel()


def _keyed(k: int, percent: int, buckets: int):
    """Keys and sets' hashes, packed by bucket. Forty bits of either can only bring together more than need be.

    Sets of one batch that share a key are tied here, and one of them stands for all in the key's bucket; ties go to buckets
    by the set, so a key that very many sets share is no bucket's load.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets give their keys once a task, as far as this remembers
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                keys, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for text in batch.column(0).slice(s, 2000).to_pylist():
                    own = shingle_set(text, k)
                    h = set_hash(own)
                    if h not in seen:
                        keys.append(set_keys(own, percent))
                        sigs.append(np.full(len(keys[-1]), h & SIG, dtype=np.uint64))
                        if len(seen) < 200_000:
                            seen.add(h)
                key, sig = np.concatenate(keys).view(np.uint64), np.concatenate(sigs)
                key, first, of = np.unique(key, return_index=True, return_inverse=True)
                tied = sig[first][of] != sig
                hub, own = sig[first][of][tied], sig[tied]
                yield _bucketed("pairs", (key % np.uint64(buckets)).astype(np.int32), key >> np.uint64(24), sig[first])
                yield _bucketed("ties", (own % np.uint64(buckets)).astype(np.int32), hub, own)

    return run


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's pairs; each key's sets, tied to the first of them, and the ties made before, once each."""
    got: list[tuple[np.ndarray, np.ndarray]] = []
    ties = [np.zeros((0, 2), dtype=np.uint64)]
    for batch in batches:
        for bucket, pairs, tied in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if pairs is not None:
                key, sig = _unpack(pairs)
                got.append((key | np.uint64(bucket << 40), sig))
            if tied is not None:
                ties.append(np.unique(np.stack(_unpack(tied), axis=1), axis=0))
    if got:
        key, sig = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((sig, key))
        key, sig = key[order], sig[order]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        hub = sig[np.flatnonzero(start)][np.cumsum(start) - 1]
        ties.append(np.stack([hub, sig], axis=1)[hub != sig])
    pairs = np.unique(np.concatenate(ties), axis=0).astype(np.int64)
    for s in range(0, len(pairs), 100_000):
        yield pa.record_batch({"u": pa.array(pairs[s : s + 100_000, 0]), "v": pa.array(pairs[s : s + 100_000, 1])})


class Forest:
    """Union-find whose labels are always the roots, so that a whole array can be looked up at once."""

    def __init__(self, n: int):
        self.label, self.members = np.arange(n), {}

    def tie(self, a: int, b: int) -> None:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return
        own, other = self.members.pop(a, [a]), self.members.pop(b, [b])
        root = min(a, b)
        small, large = (own, other) if len(own) < len(other) else (other, own)
        large.extend(small)
        self.label[large if root != (a if large is own else b) else small] = root
        self.members[root] = large


class SignatureTree:
    """Levels of nodes over documents in the given order: OR and AND of bitmaps, smallest and largest size."""

    def __init__(self, either: np.ndarray, size: np.ndarray):
        self.levels = [(either, either, size, size)]
        while len(self.levels[-1][2]) > 1:
            union, common, low, high = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(union, at), np.bitwise_and.reduceat(common, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))


def possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the nodes i of x and j of y can hold a linked pair: by the largest overlap that bitmaps and sizes allow."""
    (xo, xa, xl, xh), (yo, ya, yl, yh) = x, y
    only_x = np.bitwise_count(xa[i] & ~yo[j]).sum(axis=1, dtype=np.int64)
    only_y = np.bitwise_count(ya[j] & ~xo[i]).sum(axis=1, dtype=np.int64)
    most = np.minimum(xh[i] - only_x, yh[j] - only_y)
    return (most > 0) & (100 * most >= percent * np.maximum(xl[i] + yl[j] - most, np.maximum(xl[i], yl[j])))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def join(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Labels: the smallest index that links connect each set with. side: 2 joins with 2, else 0 with 1 only."""
    m = len(sets)
    forest, size = Forest(m), np.array([len(s) for s in sets], dtype=np.int64)
    bits = int(min(1 << 14, max(1 << 8, 1 << int(4 * size.max() - 1).bit_length())))
    maps = np.zeros((m, bits // 8), dtype=np.uint8)
    for i, s in enumerate(sets):
        at = (s & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(maps[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
    maps = maps.view(np.uint64)
    first = np.array([int(s[0] >> np.uint64(1)) if len(s) else 0 for s in sets])

    def tree(rows: np.ndarray) -> tuple[np.ndarray, SignatureTree]:
        rows = rows[np.lexsort((first[rows], size[rows]))]
        return rows, SignatureTree(maps[rows], size[rows])

    both = tree(np.flatnonzero(side == 2))
    for (rx, x), (ry, y), own in ((both, both, True), (tree(np.flatnonzero(side == 0)), tree(np.flatnonzero(side == 1)), False)):
        if not len(rx) or not len(ry):
            continue
        todo = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            lx, ly, i, j = todo.pop()
            if len(i) > PAIRS:
                todo.append((lx, ly, i[PAIRS:], j[PAIRS:]))
                i, j = i[:PAIRS], j[:PAIRS]
            if not lx and not ly:
                differ = forest.label[rx[i]] != forest.label[ry[j]]
                if own:
                    differ &= i < j
                i, j = i[differ], j[differ]
            keep = possible(x.levels[lx], i, y.levels[ly], j, percent)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if lx or ly:  # open the higher node of each pair, both where level
                down_x, down_y = lx >= ly, ly >= lx
                for down, level, t in ((down_x, lx, 0), (down_y, ly, 1)):
                    if not down:
                        continue
                    node, width = (i, len(x.levels[lx - 1][2])) if not t else (j, len(y.levels[ly - 1][2]))
                    kids = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    other = np.repeat(j if not t else i, FANOUT)
                    real = kids < width
                    i, j = (kids[real], other[real]) if not t else (other[real], kids[real])
                lx, ly = lx - down_x, ly - down_y
                if own:
                    i, j = i[i <= j], j[i <= j]
                todo.append((lx, ly, i, j))
                continue
            for a, b in zip(rx[i].tolist(), ry[j].tolist(), strict=True):
                if forest.label[a] != forest.label[b] and linked(sets[a], sets[b], percent):
                    forest.tie(a, b)
    return forest.label


def _units(k: int, percent: int):
    def flush(unit: list) -> pa.RecordBatch:
        ids = np.array([u[0] for u in unit], dtype=np.int64)
        label = join([u[2] for u in unit], np.array([u[1] for u in unit]), percent)
        at = np.flatnonzero(ids != ids[label])
        return pa.record_batch({"u": pa.array(ids[at]), "v": pa.array(ids[label[at]])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held = None, [], set()
        for batch in batches:
            for unit, doc, sig, side, text in zip(*(batch.column(c).to_pylist() for c in ("unit", "doc", "sig", "side", "text")), strict=True):
                if unit != now:
                    if len(rows) > 1:
                        yield flush(rows)
                    now, rows, held = unit, [], set()
                own = shingle_set(text, k)
                if (doc, sig) not in held and set_hash(own) == sig:  # another text of a repeated id isn't the one meant
                    held.add((doc, sig))
                    rows.append((doc, side, own))
        if len(rows) > 1:
            yield flush(rows)

    return run


def _against_hubs(k: int, percent: int):
    """Documents of large clusters, the hubs of their cluster that each links with, and these as bits; a hub links with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for batch in batches:
            out: dict[str, list] = {"doc": [], "sig": [], "bits": [], "hubs": []}
            for doc, sig, text, cluster, own in zip(*(batch.column(c).to_pylist() for c in ("doc", "sig", "text", "cluster", "hubs")), strict=True):
                if cluster not in known:
                    if len(known) >= 32:
                        known.clear()
                    known[cluster] = [(h["r"], h["doc"], shingle_set(h["text"], k)) for h in own]
                mine = shingle_set(text, k)
                if set_hash(mine) != sig:  # another text of a repeated id isn't the one meant
                    continue
                found = [(r, d) for r, d, h in known[cluster] if d == doc or linked(mine, h, percent)]
                if found:
                    bits = 0
                    for r, _ in found:
                        bits |= 1 << (r - 1)
                    for name, value in (("doc", doc), ("sig", sig), ("bits", bits), ("hubs", [d for _, d in found])):
                        out[name].append(value)
            yield pa.record_batch([pa.array(out["doc"], pa.int64()), pa.array(out["sig"], pa.int64()), pa.array(out["bits"], pa.int32()), pa.array(out["hubs"], pa.list_(pa.int64()))], names=list(out))

    return run


def _grouped(members: DataFrame, met: DataFrame) -> DataFrame:
    """members with `tied`, their group: the bits of all hubs that links join, in their cluster, with those each is tied to; 0 for none."""
    own = members.join(met.select("doc", "sig", "bits").distinct(), ["doc", "sig"], "left")
    kinds = own.where("bits is not null").groupBy("cluster").agg(F.collect_set("bits").alias("kinds"))
    wider = lambda bits: F.aggregate("kinds", bits, lambda now, o: F.when(now.bitwiseAND(o) != 0, now.bitwiseOR(o)).otherwise(now))
    tied = F.col("bits")
    for _ in range(HUBS - 1):
        tied = wider(tied)
    return own.join(kinds, "cluster", "left").withColumn("tied", F.when(F.col("bits").isNull(), 0).otherwise(tied)).drop("bits", "kinds")


def _deal(members: DataFrame, block: int, shingles: int) -> DataFrame:
    """(doc, sig, unit, side) of members (doc, sig, n, cluster, large, tied): whole clusters, or pairs of blocks of large ones.

    Blocks of a group meet those of other groups and of documents of none (group 0), and the latter meet each other too.
    """
    whole = members.where("not large").select("doc", "sig", F.col("cluster").cast("string").alias("unit"), F.lit(2).alias("side"))
    large = members.where("large")
    size = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / shingles)).cast("int")
    groups = large.groupBy("cluster", "tied").agg(size.alias("blocks")).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("tied", "blocks"))).alias("groups"))
    met = large.join(groups.where("size(groups) > 1 or element_at(groups, 0) is not null"), "cluster")
    met = met.withColumn("b", F.pmod(F.xxhash64("doc", F.lit(9)), F.element_at("groups", F.col("tied")).cast("long")).cast("int"))
    unit = lambda g, x, h, y, side: F.struct(F.concat_ws(":", F.col("cluster"), g, x, h, y).alias("unit"), F.lit(side).cast("int").alias("side"))
    own, b = F.col("tied"), F.col("b")

    def against(h: Column, o: Column) -> Column:
        """The unit of this row's block and block o of group h."""
        same = F.when(o == b, unit(own, b, h, o, 2)).when(b < o, unit(own, b, h, o, 0)).otherwise(unit(h, o, own, b, 1))
        return F.when(h == own, same).when(own < h, unit(own, b, h, o, 0)).otherwise(unit(h, o, own, b, 1))

    others = F.filter(F.map_keys("groups"), lambda h: (h != own) | (h == 0))
    dealt = F.flatten(F.transform(others, lambda h: F.transform(F.sequence(F.lit(0), F.element_at("groups", h) - 1), lambda o: against(h, o))))
    cut_up = met.select("doc", "sig", F.explode(dealt).alias("u")).select("doc", "sig", "u.unit", "u.side")
    return whole.unionByName(cut_up)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, block: int = BLOCK, shingles: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs(doc_id, text)`."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(texts.mapInArrow(_sketch(k), "doc_id long, n long, sig long, check long"))
    live = sketch.where("doc_id is not null and n > 0")
    keys = texts.where("doc_id is not null and text is not null").select("text").mapInArrow(_keyed(k, percent, 4 * width), "bucket int, pairs binary, ties binary")
    tied = keys.repartition(width, "bucket").mapInArrow(_hubs, "u long, v long")
    clusters = components(tied).select(F.col("node").alias("sig40"), F.col("component").alias("cluster"))
    classes = live.groupBy("sig", "check").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"))
    members = cut(classes.join(clusters, F.col("sig").bitwiseAND(F.lit(SIG)) == F.col("sig40")).select("doc", "sig", "n", "cluster"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    members = members.join(sizes.select("cluster", ((F.col("c") > block) | (F.col("s") > shingles)).alias("large")), "cluster")
    wanted = texts.where("text is not null")
    if members.count() <= SENT_IDS:
        wanted = wanted.join(F.broadcast(members.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi")
    large = members.where("large")
    links = None
    if not large.isEmpty():
        hubs = large.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("doc", F.lit(31)), "doc", "sig"))).where(F.col("r") <= HUBS)
        hubs = hubs.join(wanted, F.col("doc") == F.col("doc_id")).groupBy("cluster").agg(F.collect_list(F.struct("r", "doc", "text")).alias("hubs"))
        met = cut(large.join(wanted, F.col("doc") == F.col("doc_id")).join(hubs, "cluster").select("doc", "sig", "text", "cluster", "hubs").mapInArrow(_against_hubs(k, percent), "doc long, sig long, bits int, hubs array<long>"))
        links = met.select(F.col("doc").alias("u"), F.explode("hubs").alias("v")).where("u <> v")
        members = _grouped(members, met)
    else:
        members = members.withColumn("tied", F.lit(0))
    read = _deal(members, block, shingles).join(wanted, F.col("doc") == F.col("doc_id")).select("unit", "doc", "sig", "side", "text")
    found = read.repartition(width, "unit").sortWithinPartitions("unit").mapInArrow(_units(k, percent), "u long, v long")
    own = live.groupBy("sig", "check").agg(F.min("doc_id").alias("v"))
    same = live.join(own, ["sig", "check"]).select(F.col("doc_id").alias("u"), "v").where("u <> v")
    parts = components(cut(found).union(same).union(links) if links else cut(found).union(same))
    out = sketch.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(parts, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows of `docs` that are the first of their component, with all columns; rows without an id are kept."""
    gone = cut(near_duplicates(docs, k, percent).where("component_id <> doc_id").select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    return docs.alias("kept").join(gone.alias("gone"), F.col("kept.doc_id") == F.col("gone.doc_id"), "left_anti")
