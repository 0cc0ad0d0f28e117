"""Mixing sources to target weights by repetition rates.

Tokens (words) are summed by source; the sources, by code point and null last, weigh `WEIGHTS` in turn and share
`SHARE` times all words. A target stops at `MOST` times its source's words, and what is over is shared again by weight:
every target is min(cap, level x weight) for one level, which is found in closed form over the sources sorted by
cap / weight. A source's rate is its target over its words; each document is emitted floor(rate) times, and once more
where a hash of its id falls below the fraction, so reruns agree and no document is emitted more than `MOST` times.

Defined results: null text and text without words have size 0 and are emitted by the same rule; sources without words
have target 0 and rate 0; where the share is `MOST` or more every target is its cap; rows that repeat an id share its draw; a null id draws as an empty one; empty tables give no
rows; `emit` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix-1"


def words(text: Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) of `sized(source, size)`: one row a source, ranked in windows over sources."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("double").alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    by = Window.orderBy((F.col("cap") / F.col("w")), F.asc_nulls_last("source"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * share - (F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    heavy = F.sum("w").over(every) - (F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w"))
    per = per.withColumn("order", F.row_number().over(by)).withColumn("level", left / heavy).withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("order"), F.col("level")))).over(every)["level"]
    target = F.least(F.col("cap"), level * F.col("w"))  # the cap where no source is open, as then the level is null
    per = per.withColumn("target", target)
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(row, size, source_size, target, copies) of all rows of `docs(doc_id, text, source)`; row: the whole row, whatever its columns are called."""
    per = cut(targets(docs.select("source", words(F.col("text")).alias("size")), weights, share, most))
    per = per.select(F.col("source").alias("of"), "source_size", "target", "rate")
    whole = F.floor("rate")
    copies = (whole + (draw(F.col("row.doc_id"), seed) < F.col("rate") - whole).cast("int")).cast("int")
    sized = docs.select(F.struct("*").alias("row"), words(F.col("text")).alias("size"))
    met = sized.join(F.broadcast(per) if _few(per) else per, F.col("row.source").eqNullSafe(F.col("of")))
    return met.select("row", "size", "source_size", "target", copies.alias("copies"))


def _few(per: DataFrame, bound: int = 100_000) -> bool:
    """Whether there are few enough sources to send them everywhere: counted, up to the bound."""
    return per.limit(bound + 1).count() <= bound


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    return planned(docs.select("doc_id", "text", "source")).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of `docs` as many times as it is taken, with its own columns."""
    out = planned(docs, weights, share, most, seed).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, (source_size * 2)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (((sum(source_size) OVER ())::DOUBLE * 1.5) - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level, row_number() OVER o AS n FROM c
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, w * coalesce((SELECT arg_min(level, n) FROM l WHERE level * w < cap), 'infinity'::DOUBLE)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CAST(u < rate - floor(rate) AS INT)) * size AS BIGINT) AS taken FROM r
"""
