"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once, with that speaker as the assistant and all
others as users with names; a mask says which content is learnt from, the assistant's own. The rendering is kept as its
pieces, a row for each participant and turn with its place in the rendered text, so a conversation of any length needs
no cell of its own length: places are sums over blocks of turns, then within each block. `text` joins them.

Roles: every distinct role but `system` is a participant; system turns are rendered as such in every perspective and
never learnt from. A null role is the participant `unknown`. Turns go by (turn, role, text).

Defined results: null text renders as an empty turn; a null turn comes first; turns that tie go by role, then text, and
equal rows are turns of their own; rows without a conv_id belong to no conversation and give no rows, nor does a
conversation in which only the system speaks; `<|` in a text or name is written `< |`, so no text can end its turn;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def _safe(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, participant, turn, role, name, content, piece, mask, span_start, span_end: mask and the span are of the content."""
    said = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce(_safe(F.col("text")), F.lit("")).alias("content"), F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).cast("long").alias("_block")
    )
    who = said.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("participant")).distinct()
    met = said.join(who, "conv_id")
    own = F.col("speaker") == F.col("participant")
    role = F.when(own, "assistant").when(F.col("speaker") == "system", "system").otherwise("user")
    met = met.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", _safe(F.col("speaker"))))
    head = F.concat(F.lit("<|"), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("|>\n"))
    met = met.withColumn("_head", head).withColumn("piece", F.concat("_head", "content", F.lit("<|end|>\n"))).withColumn("_long", F.length("piece").cast("long"))
    blocks = met.groupBy("conv_id", "participant", "_block").agg(F.sum("_long").alias("_sum"))
    earlier = Window.partitionBy("conv_id", "participant").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "participant", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_from"))
    within = Window.partitionBy("conv_id", "participant", "_block").orderBy(F.asc_nulls_first("turn"), "speaker", "content").rowsBetween(Window.unboundedPreceding, 0)
    placed = met.withColumn("_upto", F.sum("_long").over(within)).join(blocks, ["conv_id", "participant", "_block"])
    start = F.col("_from") + F.col("_upto") - F.col("_long") + F.length("_head")
    return placed.select(
        "conv_id", "participant", "turn", "role", "name", "content", "piece", own.cast("int").alias("mask"),
        start.cast("long").alias("span_start"), (start + F.length("content")).cast("long").alias("span_end"),
    )


def text(pieces: DataFrame) -> DataFrame:
    """conv_id, participant, text and spans (start, end of the content learnt from): one row a perspective, for conversations that fit in a cell."""
    rows = pieces.groupBy("conv_id", "participant").agg(F.array_sort(F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), "mask", "piece"))).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["mask"] == 1), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return rows.select("conv_id", "participant", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), spans.alias("spans"))


SQL = r"""
WITH s AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT s.*, p.participant, CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM s JOIN (SELECT DISTINCT conv_id, speaker AS participant FROM s WHERE speaker <> 'system') p ON s.conv_id = p.conv_id
), n AS (
  SELECT *, CASE WHEN role = 'user' THEN replace(speaker, '<|', '< |') END AS name FROM m
), h AS (
  SELECT *, '<|' || role || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM n
), x AS (
  SELECT *, head || content || '<|end|>' || chr(10) AS piece FROM h
), y AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, speaker, content ROWS UNBOUNDED PRECEDING) - length(piece) + length(head) AS b FROM x
)
SELECT conv_id, participant, turn, role, name, content, piece, CAST(speaker = participant AS INT) AS mask, CAST(b AS BIGINT) AS span_start, CAST(b + length(content) AS BIGINT) AS span_end FROM y
"""
