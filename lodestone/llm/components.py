"""Connected components of an edge table, without collecting anything.

Alternating large-star and small-star rounds: every round is two combinable minimum aggregations and two joins in
which one side has unique keys, so a hub with many neighbours is a skewed join that AQE splits, not one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.where("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = around.where("v > u") if large else around
    out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`edges(u, v)` of longs to `(node, component)`, the smallest node reachable; nodes without edges have no row.

    Null ends and loops are dropped, repeated edges count once, no edges give no rows. Rounds go on until the edges
    stop changing (about the logarithm of the longest path); `max_rounds` only guards against an endless loop and
    raises rather than returning a wrong answer.
    """
    edges = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = tuple(now)
        edges = cut(_star(_star(edges, large=True), large=False))
    raise RuntimeError("components did not settle")
