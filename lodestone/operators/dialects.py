"""Messages in the shape that each provider takes, captured network bodies, and a gate for replies that only echo.

PRJ-03/04, SCA-65/66, SRC-26, FLT-16, SCA-68. Messages are (conv_id, turn, role, content, tool_call_id, tool_calls, contexts):
content is text, tool_calls an array of (id, name, arguments), contexts an array of text blocks that go behind the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALLS = "array<struct<id:string,name:string,arguments:string>>"


def _object(json: Column) -> Column:
    """JSON text of an object: `{}` for what isn't one."""
    return F.when(F.get_json_object(json, "$").isNotNull() & F.trim(json).startswith("{"), json).otherwise("{}")


def payload(messages: DataFrame, provider: str) -> DataFrame:
    """PRJ-03: conv_id, turn and the message as JSON in the provider's dialect.

    One family takes content blocks (tool results are a user's, calls are an assistant's blocks), the others take text,
    calls beside it and a `tool` role; the local one takes call arguments as objects, the rest as strings.
    """
    filled = F.filter("contexts", lambda c: F.coalesce(c, F.lit("")) != "")
    text = F.array_join(F.filter(F.concat(F.array(F.coalesce("content", F.lit(""))), F.coalesce(filled, F.array().cast("array<string>"))), lambda t: t != ""), "\n\n")
    m = messages.withColumn("_t", text).withColumn("_calls", F.coalesce("tool_calls", F.array().cast(CALLS)))
    quoted = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x")))) - 6)
    obj = lambda *pairs: F.concat(F.lit("{"), *[x for k, (name, value) in enumerate(pairs) for x in (F.lit(("," if k else "") + f'"{name}":'), value)], F.lit("}"))
    if provider == "anthropic":
        result = obj(("role", F.lit('"user"')), ("content", F.concat(F.lit("["), obj(("type", F.lit('"tool_result"')), ("tool_use_id", quoted(F.col("tool_call_id"))), ("content", quoted(F.when(F.col("_t") != "", F.col("_t")).otherwise("(no output)")))), F.lit("]"))))
        said = F.when(F.trim("_t") != "", F.array(obj(("type", F.lit('"text"')), ("text", quoted(F.col("_t")))))).otherwise(F.array().cast("array<string>"))
        used = F.transform("_calls", lambda c: obj(("type", F.lit('"tool_use"')), ("id", quoted(c["id"])), ("name", quoted(c["name"])), ("input", _object(c["arguments"]))))
        calls = obj(("role", F.lit('"assistant"')), ("content", F.concat(F.lit("["), F.array_join(F.concat(said, used), ","), F.lit("]"))))
        plain = obj(("role", quoted(F.col("role"))), ("content", quoted(F.col("_t"))))
        body = F.when((F.col("role") == "tool") | (F.col("tool_call_id").isNotNull() & (F.col("role") != "assistant")), result).when((F.col("role") == "assistant") & (F.size("_calls") > 0), calls).otherwise(plain)
    else:
        argument = (lambda a: _object(a)) if provider == "ollama" else quoted
        listed = F.array_join(F.transform("_calls", lambda c: obj(("id", quoted(c["id"])), ("type", F.lit('"function"')), ("function", obj(("name", quoted(c["name"])), ("arguments", argument(c["arguments"])))))), ",")
        parts = (
            F.concat(F.lit('{"role":'), quoted(F.col("role"))), F.when((F.col("_t") != "") | (F.size("_calls") == 0), F.concat(F.lit(',"content":'), quoted(F.col("_t")))).otherwise(""),
            F.when(F.size("_calls") > 0, F.concat(F.lit(',"tool_calls":['), listed, F.lit("]"))).otherwise(""),
            F.when(F.col("tool_call_id").isNotNull(), F.concat(F.lit(',"tool_call_id":'), quoted(F.col("tool_call_id")))).otherwise(""), F.lit("}"),
        )
        body = F.concat(*parts)
    return m.select("conv_id", "turn", body.alias("message"))


def reply_text(body: Column, provider: str) -> Column:
    """SCA-66: the text of a whole reply."""
    path = {"ollama": "$.message.content", "anthropic": "$.content[0].text"}.get(provider, "$.choices[0].message.content")
    return F.coalesce(F.get_json_object(body, path), F.lit(""))


def captured_bodies(requests: DataFrame, each: int = 3000, most: int = 24_000) -> DataFrame:
    """SRC-26: JSON and script bodies of a page (page_id, pos, method, url, content_type, body): the first of each address
    without its query, cut to `each`, in order until `most` characters are reached."""
    key = F.split_part("url", F.lit("?"), F.lit(1))
    kept = requests.where(F.lower("content_type").rlike("json|javascript") & (F.coalesce("url", F.lit("")) != "")).withColumn("_k", key)
    first = kept.withColumn("_r", F.row_number().over(Window.partitionBy("page_id", "_k").orderBy("pos"))).where((F.col("_r") == 1) & (F.coalesce("body", F.lit("")) != ""))
    cut = F.when(F.length("body") > each, F.concat(F.substring("body", 1, each), F.lit("…"))).otherwise(F.col("body"))
    entry = F.concat(F.lit("\n// "), F.coalesce("method", F.lit("GET")), F.lit(" "), "url", F.lit("\n"), cut)
    upto = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = first.withColumn("entry", entry).withColumn("_sum", F.sum(F.length("entry")).over(upto)).where(F.col("_sum") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]), "\n")
    return run.groupBy("page_id").agg(F.regexp_replace(joined, r"^\s+|\s+$", "").alias("block"))


def only_echoes(text: Column, topics: tuple[str, ...] = ()) -> Column:
    """FLT-16: three or more signs that a reply repeats its queries instead of answering. topics: patterns of earlier queries."""
    t = F.trim(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(t, "\n"), lambda s: F.trim(s) != "")
    queried = lambda s: s.rlike(r"^\s*\d+\s") | (s.rlike(r"(?i)^\s*(what|how|why|who|when|where)\b") & ~s.rlike(r"[.!?]\s*$")) | ((F.length(s) < 80) & ~s.rlike(r"[.!?]") & ~s.rlike(r"(?i)\b(is|are|was|were|has|have|can|could|should|would|will|may|might|must)\b"))
    share = F.size(F.filter(lines, queried)) / F.greatest(F.size(lines), F.lit(1))
    words = F.size(F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: F.length(w) > 2)))
    n, echoes = F.length(t), sum((t.rlike(f"(?i){p}").cast("int") for p in topics), F.lit(0))
    signs = (
        n < 400, n < 200, share >= 0.5, share >= 0.75, (F.size(F.filter(F.split(t, r"\n\n+"), lambda p: F.trim(p) != "")) < 2) & (F.regexp_count(t, F.lit(r"[.!?]\s")) < 3), ~t.rlike(r"(?i)https?://"),
        t.rlike(r"^\d+\s*\n"), t.rlike(r"^\d+\s+\w"), echoes >= 3, echoes >= 5, t.rlike(r"(?i)<\s*(invoke|tool_call|function_calls|parameter)\b"), (n < 500) & (words < 30), (n < 300) & (words < 20),
    )
    return (t != "") & (sum((s.cast("int") for s in signs), F.lit(0)) >= 3)


def options(settings: DataFrame) -> DataFrame:
    """SCA-68: a map column `settings` without nulls and without -1, which stands for the default."""
    return settings.withColumn("settings", F.map_filter("settings", lambda k, v: v.isNotNull() & (v != "-1")))
