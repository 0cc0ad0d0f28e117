"""The engine's functions under SQL names: scalar functions in Arrow batches and a table function.

UDF-01, TAB-02. `register(spark)` once; then `SELECT * FROM text_chunks('...', 800, 120)` or `SELECT tool_calls(reply)`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions import chunking, markdown, replies

NAMES = ("chunk_text", "sliding_windows", "decode_entities", "markdown_segments", "tool_calls", "text_chunks")


def register(spark: SparkSession) -> tuple[str, ...]:
    """Register all functions for the session and return their names; repeating it changes nothing."""

    @F.udtf(returnType="chunk_index: int, content: string")
    class TextChunks:
        def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
            yield from enumerate(chunking.chunk_text(text, size, overlap))

    spark.udf.register("chunk_text", chunking.chunker(chunking.chunk_text))
    spark.udf.register("sliding_windows", chunking.chunker(chunking.sliding_windows))
    spark.udf.register("decode_entities", markdown.entity_decoder())
    spark.udf.register("markdown_segments", markdown.segmenter())
    spark.udf.register("tool_calls", replies.tool_call_parser())
    spark.udtf.register("text_chunks", TextChunks)
    return NAMES
