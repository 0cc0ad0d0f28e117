"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (text key, id key): a 63-bit hash of the text, then 44 bits of a hash of the id and 18 of one of the
row's place in the table, so equal texts lie side by side, and rows that repeat their id, or have none, can be told apart. Splitters are found by counting: every pass takes the exact bytes below each boundary of a finer grid over the
intervals that still hold a splitter, and narrows them, until a boundary is within `TOLERANCE` of a shard's share. So a
group of equal texts is cut only where it is larger than that; then the id key splits it. Each pass is one aggregation
that sends sums of bytes, not rows. With the splitters known, rows are exchanged once, and numbered in their shard.

Law `bytes`: sizes are near equal. Size: UTF-8 bytes of the text, none for null, plus 1.

Slots are gapless in a shard and numbered part by part, the rows of a part in key order: parts are dealt by a hash of the
id key, so no part grows with one id or with rows that have none.

Defined results: null text has a null crc and size 1 and sorts first; a null id is one id more; rows that repeat an id,
a text or both are rows of their own and may lie in different shards where their group is large; fewer rows than shards leave shards empty; an empty table
gives no rows; columns named in `carry` go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

SHARDS, TOLERANCE, SLOT_ROWS = 16, 0.001, 50_000
#: (key, shift, bits) of each pass's grid, from coarse to fine.
GRID = (("h", 50, 13), ("h", 40, 10), ("h", 30, 10), ("h", 20, 10), ("h", 10, 10), ("h", 0, 10), ("k", 50, 12), ("k", 40, 10), ("k", 30, 10), ("k", 20, 10), ("k", 10, 10), ("k", 0, 10))
_NAMES = {"h": "_h", "k": "_k"}


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """_id, _size, _crc and the two keys of every row, beside the carried columns."""
    utf8 = F.encode("text", "UTF-8")
    crc = F.crc32(utf8)
    return docs.select(
        *carry,
        F.col("doc_id").alias("_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("_size"),
        crc.cast("long").alias("_crc"),
        F.coalesce(F.shiftleft(crc.cast("long"), 31).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1))), F.lit(0)).cast("long").alias("_h"),
        F.shiftleft(F.xxhash64("doc_id", F.lit(23)).bitwiseAND(F.lit((1 << 44) - 1)), 18).bitwiseOR(F.xxhash64(F.monotonically_increasing_id(), F.lit(29)).bitwiseAND(F.lit((1 << 18) - 1))).alias("_k"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """First (text key, id key) of shards 1 and up. The driver gets sums of at most 2 ** 13 cells for each open interval."""
    total = rows.agg(F.sum("_size")).first()[0] or 0
    slack = tolerance * total / shards
    done: dict[int, tuple[int, int]] = {}
    # an open interval: the cell (h, k) it starts at, bytes before it, the shards whose first row is sought in it
    todo: list[tuple[tuple[int, int], int, list[int]]] = [((0, 0), 0, list(range(1, shards)))] if total else []
    for level, (key, shift, bits) in enumerate(GRID):
        if not todo:
            break
        if level == 0:
            within, start = F.lit(True), F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("k"))
        else:
            up_key, up_shift, _ = GRID[level - 1]
            up = F.shiftleft(F.shiftright(_NAMES[up_key], up_shift), up_shift)
            start = F.struct((up if up_key == "h" else F.col("_h")).alias("h"), (up if up_key == "k" else F.lit(0).cast("long")).alias("k"))
            within = F.lit(False)
            for (h, k), _, _ in todo:
                within = within | ((start["h"] == h) & (start["k"] == k))
        digit = F.shiftright(_NAMES[key], shift).bitwiseAND(F.lit((1 << bits) - 1))
        cells = rows.where(within).groupBy(start.alias("at"), digit.alias("digit")).agg(F.sum("_size").alias("bytes")).collect()
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for c in cells:
            by.setdefault((c["at"]["h"], c["at"]["k"]), []).append((c["digit"], c["bytes"]))
        after = []
        for at, before, sought in todo:
            grid = sorted(by[at])
            deeper: dict[tuple[int, int], tuple[int, list[int]]] = {}
            for shard in sought:
                target, below = total * shard / shards, before
                for d, size in grid:
                    if below + size > target:
                        break
                    below += size
                else:
                    d, size = grid[-1][0] + 1, 0
                first, beyond = ((at[0], at[1] + (x << shift)) if key == "k" else (min(at[0] + (x << shift), (1 << 63) - 1), 0) for x in (d, d + 1))
                if target - below <= slack or not size:
                    done[shard] = first
                elif below + size - target <= slack:
                    done[shard] = beyond
                elif level + 1 == len(GRID):
                    done[shard] = first if target - below <= below + size - target else beyond
                else:
                    deeper.setdefault(first, (below, []))[1].append(shard)
            after += [(first, below, own) for first, (below, own) in deeper.items()]
        todo = after
    return [done[s] for s in sorted(done)]


def assign(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs(doc_id, text)`, beside `carry`."""
    rows = cut(keyed(docs, carry))  # written once: a row keeps its place, and with it its key
    narrow = rows.select("_size", "_h", "_k")
    cuts = splitters(narrow, shards, tolerance)
    shard = F.lit(0)
    for h, k in cuts:
        shard = shard + ((F.col("_h") > h) | ((F.col("_h") == h) & (F.col("_k") >= k))).cast("int")
    parts = max(1, -(-narrow.count() // (shards * SLOT_ROWS)))
    part = F.pmod(F.xxhash64("_k", F.lit(41)), F.lit(parts)).cast("int")
    placed = rows.withColumn("_shard", shard).withColumn("_part", part)
    counts = narrow.select(shard.alias("_s"), part.alias("_p")).groupBy("_s", "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    order = Window.partitionBy("_shard", "_part").orderBy("_h", "_k", "_id")
    numbered = placed.withColumn("_at", F.row_number().over(order))
    return numbered.join(offsets, (F.col("_shard") == F.col("_s")) & (F.col("_part") == F.col("_p"))).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"), (F.col("_from") + F.col("_at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(c).alias(c) for c in carry if c not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")],
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Whole rows as Parquet under `path`, a folder for each shard, in slot order in every file."""
    placed = assign(docs, shards, tuple(docs.columns))
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
