"""Reply streams: frames of three dialects, thinking tags and tool calls in fragments.

STR-01..05, SCA-20. A frame is (response_id, seq, dialect, frame): JSON text of the dialect `lines`, `choices` or `blocks`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_TAG = re.compile(r"<(/?)think(?:ing)?>")


def interpret(frames: DataFrame) -> DataFrame:
    """STR-01: text, think, done and prompt and output token counts of each frame, by its dialect."""
    j = lambda path: F.get_json_object("frame", path)
    own = lambda a, b, c: F.when(F.col("dialect") == "lines", a).when(F.col("dialect") == "choices", b).otherwise(c)
    full = lambda c: F.coalesce(c, F.lit(""))
    delta = F.when(j("$.type") == "content_block_delta", j("$.delta.text"))
    none = F.lit(None).cast("string")
    return frames.select(
        "response_id", "seq", "dialect",
        full(own(F.when(j("$.error").isNull(), j("$.message.content")), j("$.choices[0].delta.content"), delta)).alias("text"),
        full(own(F.when(j("$.error").isNull(), F.coalesce(j("$.message.thinking"), j("$.message.reasoning"))), j("$.choices[0].delta.reasoning_content"), none)).alias("think"),
        F.coalesce(own(F.coalesce(j("$.done"), F.lit("")) == "true", F.lit(False), j("$.type") == "message_stop"), F.lit(False)).alias("done"),
        own(j("$.prompt_eval_count"), j("$.usage.prompt_tokens"), F.when(j("$.type") == "message_start", j("$.message.usage.input_tokens"))).try_cast("long").alias("prompt_tokens"),
        own(j("$.eval_count"), j("$.usage.completion_tokens"), F.when(j("$.type") == "message_delta", j("$.usage.output_tokens"))).try_cast("long").alias("output_tokens"),
    )


def stream_usage(interpreted: DataFrame) -> DataFrame:
    """STR-05: the last counts that a reply's frames carry; replies without any have no row."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    out = interpreted.groupBy("response_id").agg(last("prompt_tokens").alias("prompt_tokens"), last("output_tokens").alias("output_tokens"))
    return out.where("prompt_tokens is not null or output_tokens is not null")


def split_thinking(delta: str, thinking: bool = False) -> tuple[str, str, bool]:
    """STR-02: text and thinking of a delta and the state after it; a tag in two deltas isn't one, nor is a tag out of turn."""
    parts: tuple[list[str], list[str]] = ([], [])
    at = 0
    for tag in _TAG.finditer(delta):
        if bool(tag[1]) == thinking:
            parts[thinking].append(delta[at : tag.start()])
            thinking, at = not thinking, tag.end()
    parts[thinking].append(delta[at:])
    return "".join(parts[0]), "".join(parts[1]), thinking


def _folded(rows: pd.DataFrame, thinking: bool) -> tuple[pd.DataFrame, bool]:
    out = []
    for r in rows.sort_values("seq").itertuples():
        text, think, thinking = split_thinking(r.text or "", thinking)
        out.append((r.response_id, r.seq, text, think))
    return pd.DataFrame(out, columns=["response_id", "seq", "text", "think"]), thinking


_SPLIT = "response_id long, seq long, text string, think string"


def thinking_batch(deltas: DataFrame) -> DataFrame:
    """The splitter over finished replies (response_id, seq, text): a fold of each reply's own deltas."""
    return deltas.groupBy("response_id").applyInPandas(lambda pdf: _folded(pdf, False)[0], _SPLIT)


def thinking_stream(deltas: DataFrame) -> DataFrame:
    """The splitter over a stream of deltas: its state is one flag for each reply."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        out, thinking = _folded(rows, state.get[0] if state.exists else False)
        state.update((thinking,))
        yield out

    return deltas.groupBy("response_id").applyInPandasWithState(step, _SPLIT, "thinking boolean", "append", GroupStateTimeout.NoTimeout)


def assemble_tool_calls(fragments: DataFrame) -> DataFrame:
    """STR-03/04: calls of fragments (response_id, seq, index, id, name, arguments): the last id and name, all arguments.

    A fragment without an index opens the next slot: one after the slots that the reply has so far.
    """
    order = Window.partitionBy("response_id").orderBy("seq")
    slots = F.coalesce(F.max("index").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    named = fragments.withColumn("index", F.coalesce("index", slots + F.sum(F.col("index").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("arguments", F.lit("")).alias("a")))), lambda x: x["a"]), "")
    return named.groupBy("response_id", "index").agg(last("id").alias("id"), last("name").alias("name"), joined.alias("arguments"))
