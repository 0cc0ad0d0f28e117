from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.functions import markdown as M
from lodestone.operators import dialects as D


def test_entities():
    assert M.decode_entities("a &amp; b &#233;tude &#x2014; &unknown; &#38;lt; &#99999999;") == "a & b étude — &unknown; < "
    assert M.decode_entities(None) == ""


def test_segments(spark):
    text = "intro\n\n| a | b |\n| --- | :---: |\n| 1 | 2 |\n| ragged |\n> quoted\n> more\n---\n```py\ncode()\n```\ntail\n```open"
    assert [(k, lang) for k, lang, _ in M.segments(text)] == [("text", ""), ("table", ""), ("text", ""), ("quote", ""), ("rule", ""), ("code", "py"), ("text", "")]
    assert M.segments(text)[3][2] == "quoted\nmore" and M.segments(text)[-1][2].endswith("```open") and M.segments(None) == []
    assert M.inline_markup("a **b** `x*y*<` *i*") == "a <b>b</b> <tt>x*y*&lt;</tt> <i>i</i>"
    got = spark.createDataFrame([("# x",), (None,)], "t string").select(M.segmenter()(F.col("t")).alias("s")).collect()
    assert [len(r.s) for r in got] == [1, 0]
    row = spark.createDataFrame([("<li>a</li><b>c</b> & <",)], "t string").select(M.strip_tags(F.col("t")), M.escape_xml(F.col("t"))).first()
    assert row[0].startswith("• a\nc") and "&amp; &lt;" in row[1]


def test_payload(spark):
    rows = [(1, 0, "user", 'say "hi"', None, None, ["ctx", ""]), (1, 1, "assistant", "ok", None, [("c1", "f", '{"a": 1}')], None), (1, 2, "tool", "", "c1", None, None), (1, 3, "assistant", None, None, [("c2", "g", "broken")], None)]
    m = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content string, tool_call_id string, tool_calls {D.CALLS}, contexts array<string>")
    read = lambda provider: [json.loads(r.message) for r in D.payload(m, provider).orderBy("turn").collect()]
    a = read("anthropic")
    assert a[0] == {"role": "user", "content": 'say "hi"\n\nctx'} and a[2] == {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "(no output)"}]}
    assert a[1]["content"] == [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "c1", "name": "f", "input": {"a": 1}}] and a[3]["content"] == [{"type": "tool_use", "id": "c2", "name": "g", "input": {}}]
    o = read("openai")
    assert o[1]["tool_calls"][0]["function"] == {"name": "f", "arguments": '{"a": 1}'} and o[2] == {"role": "tool", "content": "", "tool_call_id": "c1"} and "content" not in o[3]
    assert read("ollama")[1]["tool_calls"][0]["function"]["arguments"] == {"a": 1}


def test_captured(spark):
    rows = [(1, 0, "GET", "http://a/x?1", "application/json", "A"), (1, 1, None, "http://a/x?2", "application/json", "B"), (1, 2, None, "http://a/y", "text/html", "C"), (1, 3, None, "http://a/z", "text/JavaScript", "D" * 4000)]
    r = spark.createDataFrame(rows, "page_id long, pos int, method string, url string, content_type string, body string")
    block = D.captured_bodies(r).first().block
    assert block.startswith("// GET http://a/x?1\nA") and "B" not in block.replace("GET", "") and block.endswith("…")
    assert D.captured_bodies(r, most=40).first().block == "// GET http://a/x?1\nA"


def test_echoes(spark):
    good = ("Solar capacity grew by a fifth in 2024, as the agency reports at https://a.org. " * 8 + "\n\n" + "Wind was slower, and the reasons are several. It has been a hard year. " * 3)
    rows = spark.createDataFrame([(good,), ("10\nsolar growth 2024\nwind growth",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(D.only_echoes(F.col("t"))).collect()] == [False, True, False, False]
