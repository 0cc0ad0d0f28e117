"""Small rules of replies, budgets, memory, citations and companions on values worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import chunking as C
from lodestone.functions import replies
from lodestone.functions import results as R
from lodestone.operators import chat, collections, research, usage


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_json_within_words(spark):
    for reply in ('{"scores": [0.5]}', 'Sure:\n```json\n{"scores": [0.5]}\n```', 'The scores are {"scores": [0.5]} then'):
        assert value(spark, replies.rerank_scores(F.lit(reply), 1)) == [0.5]
    assert value(spark, replies.lenient_json(F.lit("no {json"), "struct<a:int>")) is None
    assert value(spark, replies.title(F.lit('```json\n{"title": "A fine title"}\n```'))) == "A fine title"


def test_research_checks(spark):
    plan = '[{"search_query": "a"}, {"sub_task": "b", "search_query": "b"}, {"search_query": "c"}]'
    assert [p.search_query for p in value(spark, replies.follow_ups(F.lit(plan)))] == ["a", "b"]
    assert value(spark, replies.follow_ups(F.lit("nothing"))) == [] and len(value(spark, replies.follow_ups(F.lit(plan), replies.CAUSAL_QUERIES))) == 3
    got = value(spark, replies.critique(F.lit('So {"sufficient": true, "drop_indices": [1, "x", 2.5], "new_branches": [{"sub_task": "s"}, {"search_query": "q"}]}')))
    assert got.sufficient and got.drop_indices == [1] and [b.search_query for b in got.new_branches] == ["q"] and got.adjustments == []
    assert value(spark, replies.critique(F.lit("no"))) is None
    assert value(spark, replies.outline(F.lit('{"sections": []}'))) == [] and value(spark, replies.outline(F.lit('{"sections": []}'), 1)) is None
    good = value(spark, replies.quality(F.lit('{"coverage_score": 4, "score": 1, "groundedness_score": 3, "unsupported_claims": ["", "u"]}')))
    assert (good.coverage, good.groundedness, good.unsupported, good.missing) == (4.0, 3.0, ["u"], [])
    assert value(spark, replies.quality(F.lit('{"groundedness_score": 3}'))) is None and value(spark, replies.quality(F.lit(None).cast("string"))) is None


def test_markup_goes(spark):
    strip = lambda t: value(spark, replies.without_tool_markup(F.lit(t).cast("string")))
    assert strip(None) == "" and strip("plain  text\n\n\n\nend") == "plain text\n\nend"
    assert strip('a <tool_calls><invoke name="x">1</invoke></tool_calls> b') == "a b"
    assert strip('a <invoke name="x">\n<parameter name="q">cut') == "a"
    assert strip("a <｜DSML｜invoke name=“x”>y</｜DSML｜invoke> b") == "a b"
    assert strip('a {"name": "web_search", "q": 1} read_url({"url": 2}) b') == "a b"
    assert strip("keep\nweb_search('q')\nend") == "keep\nend"


def test_texts_and_keys(spark):
    assert value(spark, R.inline_text(F.lit(" a\t b\r\n\r\n c  "))) == "a b\nc" and value(spark, R.inline_text(F.lit(None).cast("string"))) == ""
    assert value(spark, R.table_cell(F.lit(" a|b\n\\ "))) == "a\\|b \\\\"
    assert value(spark, R.json_block()(F.lit('{"a":[1.0,"ü"],"b":{}}'))) == '```json\n{\n  "a": [\n    1,\n    "ü"\n  ],\n  "b": {}\n}\n```'
    assert value(spark, R.json_block()(F.lit("words"))) == "```json\nwords\n```"
    assert value(spark, R.search_notes(F.lit(1), F.lit(0), F.lit(0))) == ""
    assert value(spark, R.plan_snapshot(F.lit(None).cast("array<struct<sub_task:string,search_query:string,hypothesis:string,evidence_needed:string>>"))) == "[]"


def test_pages_in_prompts():
    text = " ".join(f"Sentence number {i}." for i in range(300))
    cut = C.keep_ends(text, 1000)
    assert cut.startswith("Sentence number 0.") and cut.endswith("Sentence number 299.") and C.MIDDLE_MARK in cut and len(cut) <= 1000 + len(C.MIDDLE_MARK)
    assert C.keep_ends(text, 400).find(C.MIDDLE_MARK) < 0 and len(C.keep_ends(text, 400)) <= 320
    assert C.keep_ends("x" * 100, 50) == "x" * 40 + C.CUT_MARK + "x" * 10 and C.keep_ends(None, 5) == "" and C.keep_ends("abc", 3) == "abc"
    assert C.sections("intro\n# A\nx\n## B\n") == [("", "intro"), ("# A", "x"), ("## B", "")] and C.sections("no heading") == [("", "no heading")]
    page = "# A\n" + "a" * 400 + "\n# B\n" + text
    got = C.for_prompt(page, 1000)
    assert got.startswith("# A\n" + "a" * 400 + "\n\n# B\nSentence number 0.") and len(got) < 1100
    assert C.for_prompt(page, 500) == "# A\n" + "a" * 400 and C.for_prompt("short") == "short" and C.for_prompt(None) == ""
    assert C.for_prompt(text, 1000) == cut


def test_budgets_and_memory(spark):
    budget = lambda p, m=None, c=None: value(spark, chat.provider_budget(F.lit(p), F.lit(m).cast("string"), F.lit(c).cast("int")))
    assert (budget("ollama"), budget("unsloth", c=0), budget("ollama", c=10_000)) == (11468, 22937, 28000)
    assert (budget("deepseek"), budget("openai", "GPT-4o"), budget("openai"), budget("openai", ""), budget("anthropic", "x"), budget("other"), budget(None)) == (2_156_000, 358_400, 358_400, 89_600, 280_000, 200_000, 200_000)
    rows = [(1, 0, "user", "a" * 600), (1, 1, None, "b" * 600), (1, 2, "user", "last"), (2, 0, "user", None), (2, 1, "user", "x"), (3, 0, "user", "alone")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    start = spark.createDataFrame([(1, 2, "m"), (2, 1, None), (3, 0, "m")], "conv_id long, start_turn long, memory string")
    got = {r.conv_id: r.transcript for r in chat.fold_transcripts(m, start, most=0).collect()}
    whole = "[user] " + "a" * 600 + "\n\n[unknown] " + "b" * 600
    assert got == {1: chat.TRIMMED_MARK + whole[-1000:], 2: "[user] "}
    assert {r.conv_id: r.transcript for r in chat.fold_transcripts(m, start).collect()}[1] == whole
    assert chat.fold_transcripts(m.limit(0), start).count() == 0
    assert value(spark, chat.memory_reply(F.lit("  \n"))) is None and value(spark, chat.memory_reply(F.lit(" a  b"), 3)) == "a"


def test_citations(spark):
    kind = "array<struct<claim:string,numbers:array<bigint>>>"
    claim = "The station was opened in the year 1900"
    rows = [(f"{claim}. And so.", [(claim, [2, 1, 2])]), (f"{claim} [4].", [(claim, [1])]), ("Short claim.", [("Short", [1])]), (f"{claim}.", [(claim, [])]), (f"{claim}.", None), (None, [(claim, [1])])]
    t = spark.createDataFrame(rows, f"t string, c {kind}")
    assert [r.x for r in t.select(research.annotated(F.col("t"), F.col("c")).alias("x")).collect()] == [f"{claim}[1][2]. And so.", f"{claim} [4].", "Short claim.", f"{claim}.", f"{claim}.", None]
    said = [(1, 1, "tool", "[Full text scraped from https://B.org/] [Full text fetched from https://a.org]"), (1, 2, "tool", "[Full text extracted from https://b.org] [Full text scraped from https://c.org]"), (1, 3, "user", "[Full text scraped from https://d.org]"), (2, 1, "tool", None)]
    m = spark.createDataFrame(said, "run long, seq long, role string, text string")
    cited = spark.createDataFrame([(1, 1, "https://a.org/")], "run long, number long, url string")
    listed = spark.createDataFrame([(1, 3, "https://x.org", "X"), (1, 4, "https://y.org", None), (2, 1, "https://z.org", "Z")], "run long, number long, url string, title string")
    got = sorted(tuple(r) for r in research.citation_map(cited, m, listed).collect())
    assert got == [(1, 1, "https://a.org/", ""), (1, 2, "https://B.org/", ""), (1, 3, "https://c.org", ""), (1, 4, "https://y.org", ""), (2, 1, "https://z.org", "Z")]


def test_companions_and_facts(spark):
    state = value(spark, usage.stage_state(F.lit("10000.4"), F.lit(-2), F.lit(7.9), F.lit("x").try_cast("double"), F.array(*map(F.lit, ["sprout", "egg", "sprout", "sage", "dragon"]))))
    assert tuple(state) == (10000, 0, 7, 0, ["sprout", "egg"])
    assert value(spark, usage.stage_state(*[F.lit(None).cast("double")] * 4, F.lit(None).cast("array<string>"))).xp == 0
    had = spark.createDataFrame([("conversations", "update_gpu_setup", "old"), ("conversations", "s_1", "talk"), ("docs", "update_gpu_setup", "doc")], "collection string, id string, content string")
    facts = spark.createDataFrame([(" GPU  setup!", "first", 1), ("gpu setup", "second", 2), ("lang", "python", 1)], "about string, new_fact string, at long")
    now = collections.remember(had, facts)
    assert sorted(tuple(r) for r in now.collect()) == [("conversations", "s_1", "talk"), ("conversations", "update_gpu_setup", "second"), ("conversations", "update_lang", "python"), ("docs", "update_gpu_setup", "doc")]
    left = collections.forget(now, spark.createDataFrame([("GPU setup",), ("s 1",)], "about string"))
    assert sorted(r.id for r in left.collect()) == ["s_1", "update_gpu_setup", "update_lang"] and collections.forget(had.limit(0), facts).count() == 0
