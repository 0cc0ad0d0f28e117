from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.functions import replies as R


def one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_rerank(spark):
    said = ['{"scores":[0.1,0.9]}', "[0.5, 0.25]", 'Sure: {"scores": [0.2, 0.3]} done', '{"scores":[1]}', '{"scores":[2,-1]}', "garbage", "", None]
    assert one(spark, lambda x: R.rerank_scores(x, 2), *said) == [[0.1, 0.9], [0.5, 0.25], [0.2, 0.3], None, [1.0, 0.0], None, None, None]


def test_facts_and_plans(spark):
    got = one(spark, lambda x: R.facts(x, F.lit("u")), '[{"claim": "a", "url": "b"}, {"claim": " "}]', "- one\n* two\ntext", "none", None)
    assert [[f.claim for f in g or []] for g in got] == [["a"], ["one", "two"], [], []]
    got = one(spark, R.plan, '```json\n[{"sub_task": "s", "search_query": "q"}]\n```', "1. first\n2) second", "1. alone", None)
    assert [[p.sub_task for p in g] if g else None for g in got] == [["s"], ["first", "second"], None, None]


def test_titles_and_lists(spark):
    assert one(spark, R.title, '{"title": "A plan"}', 'Title: "Cats."', "- bullet point", "I'm sorry, no", "", None) == ["A plan", "Cats", "bullet point", None, None, None]
    got = one(spark, R.bibliography, "Sources\n[1] Name - https://a.org/x\n2. https://b.org\n[1] again https://c.org")[0]
    assert [(b.number, b.url) for b in got] == [(1, "https://a.org/x"), (2, "https://b.org")]
    got = one(spark, R.command, "/search cats", "cats /search", "/kb what", "plain")
    assert [(c.tool, c.argument) if c else None for c in got] == [("web_search", "cats"), ("web_search", "cats"), ("knowledge_search", "what"), None]


def test_choices(spark):
    rows = spark.createDataFrame([("http-error", 408), ("http-error", 599), ("http-error", 404), ("server-busy", None), ("timeout", None), (None, 503)], "c string, s int")
    assert [tuple(r) for r in rows.select(R.retryable(F.col("c"), F.col("s")), R.fallback_worthy(F.col("c"), F.col("s"))).collect()] == [(True, False), (True, False), (False, True), (True, False), (False, True), (False, False)]
    rows = spark.createDataFrame([(False, 425, None), (False, 200, "Memory pressure, requeued"), (True, 503, None), (False, 500, "boom"), (None, None, "Rate-limit hit")], "ok boolean, s int, t string")
    assert [r[0] for r in rows.select(R.transient(F.col("ok"), F.col("s"), F.col("t"))).collect()] == [True, True, False, False, True]
    d = spark.createDataFrame([("7", 0, 0.0), (None, 0, 1.0), (None, 9, 0.0), ("900", 0, 0.0)], "r string, a int, j double")
    assert [r[0] for r in d.select(R.retry_delay(F.col("r"), F.col("a"), F.col("j"))).collect()] == [7.0, 2.5, 10.0, 60.0]
    t = spark.createDataFrame([("", "j", "r"), (" fit", None, None), (None, None, None)], "f string, s string, r string")
    assert [r[0] for r in t.select(R.best_text(F.col("f"), F.col("s"), F.col("r"))).collect()] == ["j", " fit", ""]
    assert one(spark, lambda x: R.crawl_text(F.lit("no code"), x), "```a```\n```b```", "x") == ["```a```\n```b```", "no code"]
    assert one(spark, R.looks_like_tool_calls, '{"name": "f", "arguments": {}}', "<tool_call>", "plain") == [True, True, False]


def test_tool_calls(spark):
    assert R.tool_calls('x {"name": "f", "arguments": {"q": "a}b"}} y {"tool": "g", "args": "{}"}') == [("f", '{"q": "a}b"}'), ("g", "{}")]
    assert [(n, json.loads(a)) for n, a in R.tool_calls("web_search(query=\"cats\", n=3)")] == [("web_search", {"query": "cats", "n": "3"})]
    assert [(n, json.loads(a)) for n, a in R.tool_calls('<invoke name="f"><parameter name="q">v</parameter></invoke>')] == [("f", {"q": "v"})]
    assert R.tool_calls(None) == [] and R.tool_calls("{ never closed") == [] and R.balanced('{"a": "\\"}"}', 0) == 12
    assert one(spark, R.tool_call_parser(), '{"name": "f", "arguments": {}}', None) == [[("f", "{}")], []]


def test_pdf(spark):
    rows = spark.createDataFrame([("http://a/x.PDF?y", b"x"), ("http://a", b"\xef\xbb\xbf %PDF-1"), ("http://a", b"<html>")], "u string, c binary")
    assert [r[0] for r in rows.select(R.is_pdf(F.col("u"), F.col("c"))).collect()] == [True, True, False]
