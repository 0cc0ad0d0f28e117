"""Column functions on the reference vectors of the fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import pricing as P
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import chat, collections, links, research, usage
from lodestone.streaming import frames


def one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_formats(spark):
    assert one(spark, P.format_tokens, 0, 500, 1000, 5500, 10000, 999999, 10**6, 1500000, 10**9, 2500000000, kind="long") == ["0", "500", "1k", "5.5k", "10k", "1000k", "1M", "1.5M", "1B", "2.5B"]
    assert one(spark, P.format_cost, None, 0.0, 0.005, 0.5, 10.0, 10.256, kind="double") == ["—", "<$0.01", "<$0.01", "$0.50", "$10.00", "$10.26"]
    assert one(spark, lambda x: P.stage(x, P.COMPANION_STAGES), 0, 1, 49999, 50000, 5 * 10**5, 5 * 10**6, 5 * 10**7, kind="long") == ["egg", "hatchling", "hatchling", "sprout", "scholar", "sage", "archmage"]
    assert one(spark, P.trend_band, None, 0.02, 0.256, -0.5, kind="double") == [None, "flat", "up 26%", "down 50%"]


def test_prices(spark):
    m = spark.createDataFrame([("openai", "gpt-4o"), ("openai", "gpt-4o-2024-08-06"), ("openai", "gpt-4o-mini"), ("openai", "o1-mini"), ("ollama", "llama3"), ("ollama", "marco-o1"), ("other", "x"), ("openai", "")], "provider string, model string")
    got = {(r.provider, r.model): (r.rate_in, r.rate_out) for r in P.match_price(m).collect()}
    assert got["openai", "gpt-4o"] == got["openai", "gpt-4o-2024-08-06"] == (2.5, 10.0) and got["openai", "gpt-4o-mini"] == (0.15, 0.6) and got["openai", "o1-mini"] == (1.1, 4.4)
    assert got["ollama", "llama3"] == (0, 0) and got["ollama", "marco-o1"] == (15.0, 60.0) and got["other", "x"] == got["openai", ""] == (1.0, 4.0)
    t = spark.createDataFrame([("2026-09-14 12:00:00", 1000, 500, 400), ("2026-09-14 12:00:00", 1000, 500, 0), ("2026-09-14 12:00:00", 10**6, 10**6, 0)], "ts string, p long, c long, h long").withColumn("ts", F.col("ts").cast("timestamp"))
    cost = [r[0] for r in t.select(P.tiered_cost(F.lit("deepseek-flash"), F.col("p"), F.col("c"), F.col("h"), P.is_peak(F.col("ts")))).collect()]
    assert cost == pytest.approx([0.0003912, 0.00045, 0.75])
    peaks = one(spark, lambda x: P.is_peak(x.cast("timestamp")), "2026-09-14 02:00:00", "2026-09-14 12:00:00", "2026-09-13 02:00:00")
    assert peaks == [True, False, False]


def test_moods(spark):
    rows = spark.createDataFrame([(1, 0.75, None), (1, 0.74, None), (1, 0.4, None), (1, 0.39, 0.06), (1, 0.39, 0.02), (1, 0.39, None), (1, 0.0, None), (0, 0.0, None)], "t int, s double, d double")
    assert [r[0] for r in rows.select(P.mood(F.col("t"), F.col("s"), F.col("d"))).collect()] == ["Homestead Hero", "Balanced Buddy", "Balanced Buddy", "Rooting In", "Cloud Curious", "Cloud Curious", "Cloud Surfer", "Dreaming of first tokens"]


def test_html(spark):
    page = "<head><title>t</title></head><style>x</style><!-- c --><script>1</script><noscript>n</noscript><p>Visible text</p>"
    assert one(spark, T.html_to_text, page, "<p>a</p><p>b</p>", "<ul><li>One</li><li>Two</li></ul>", "Line<br>Break", "<p>&lt;tag&gt;</p>", "a<p></p><p></p>b", None) == ["Visible text", "a\nb", "- One\n\n- Two", "Line\nBreak", "<tag>", "a\n\nb", ""]


def test_urls(spark):
    assert one(spark, U.guard, "http://localhost/x", "http://127.0.0.1", "https://10.0.0.5:80/", "ftp://a.org", "", None, "http://192.0.66.7/", "http://[::1]/", "x") == ["blocked-host"] * 3 + ["bad-scheme", "no-url", "no-url", None, "blocked-host", "invalid-url"]
    base = "https://a.org/docs/guide/page.html?x=1"
    want = {"/r": "https://a.org/r", "b.html#f": "https://a.org/docs/guide/b.html", "../up": "https://a.org/docs/up", "./s/": "https://a.org/docs/guide/s/", "//c.org/x": "https://c.org/x", "mailto:a@b": "", "http://d.org/#h": "http://d.org/", "?q=2": "https://a.org/docs/guide/page.html?q=2", "": "", "tel:1": ""}
    assert one(spark, lambda x: U.resolve(x, F.lit(base)), *want) == list(want.values())
    assert one(spark, U.search_key, "HTTP://A.org/X/?q#f", "http://a.org//") == ["http://a.org/x", "http://a.org"]
    assert one(spark, lambda x: U.is_local_endpoint(F.lit("ollama"), x), None, "http://box:1", "http://api.x.org") == [True, True, False]


def test_queries(spark):
    assert one(spark, T.needs_expansion, "what is it?", "spark sql", "", "tell me how this works, please, in some more words than twelve of them are") == [True, False, False, True]
    assert one(spark, T.is_multi_part, "spark vs flink", "plain", "a and b or c", "x: y") == [True, False, True, True]
    assert one(spark, T.intent, "syntax problem", "announced", "arxiv", "capital of x", "cats") == ["code", "news", "academic", "facts", "general"]
    assert one(spark, T.reliability, "https://x.gov/a", "https://en.wikipedia.org", "https://shop.com") == ["high", "low", "medium"]
    assert one(spark, lambda x: T.ttl_hours(x), "http://a/2025/07/28/x", "http://a/b") == [6, 168]


def test_text(spark):
    assert one(spark, T.estimate_tokens, "abcd", "x" * 400, None, "abcde") == [1, 100, 0, 2]
    assert one(spark, lambda x: T.truncate_words(x, 12), "short", "one two three four", "abcdefghijklmnop") == ["short", "one two…", "abcdefghijkl…"]
    assert one(spark, T.numbers, "rose 20% to 3.5 million, 0") == [[20.0, 3.5]]
    heavy = "intro\n```\ncode();\n```\n\n```\nmore();\n```\n"
    got = one(spark, T.code_heaviness, heavy, "plain prose, nothing else", "")
    assert [(g.code_heavy, g.fence_blocks) for g in got] == [(True, 2), (False, 0), (False, 0)]
    assert one(spark, lambda x: T.occurrences(F.lower(x), T.keywords(F.lit("engine error the"))), "Engine error: engine") == [3]


def test_links(spark):
    html = '<a href="/a#x">A</a><a href=\'https://b.org/p.pdf\'>B <b>b</b></a><a href="/login">L</a><a href="/a/">again</a><a href=/x.png>i</a><a href="mailto:q@r">m</a>'
    page = spark.createDataFrame([(1, "https://s.org/d/", html)], "page_id long, url string, html string")
    got = [(r.href, r.text, r.external) for r in links.normalized(links.anchors(page), 25).orderBy("pos").collect()]
    assert got == [("https://s.org/a", "A", False), ("https://b.org/p.pdf", "B b", True)]
    assert links.normalized(links.anchors(page), 25, pdfs=False).count() == 1
    table = spark.range(1).select(links.markdown_table(F.expr("array(array('a', 'b|', ''), array('', ''), array('1'))"))).first()[0]
    assert table == "| a | b\\| |\n| --- | --- |\n| 1 |  |"
    assert one(spark, links.plain_links, "see [x](https://a.org/1) and https://b.org/2. https://a.org/1") == [["https://a.org/1", "https://b.org/2"]]


def test_research(spark):
    facts = spark.createDataFrame([(1, "c", "http://A.org/"), (2, "c", "http://a.org"), (3, "c", "http://b.org"), (4, " ", "http://c.org"), (5, "c", None)], "seq long, claim string, url string")
    cited = research.citations(facts)
    assert [(r.seq, r.number) for r in cited.orderBy("seq").collect()] == [(1, 1), (2, 1), (3, 2)]
    assert research.bibliography(cited).first()[0] == "[1] http://A.org/\n[2] http://b.org"
    marks = research.cite(spark.createDataFrame([("http://b.org/",), ("http://z.org",)], "url string"), cited)
    assert {r.mark for r in marks.collect()} == {"[2](http://b.org/)", "[?](http://z.org)"}
    claim = "global solar capacity growth reached {} percent"
    for a, b, url, n in ((20, 80, "http://b", 1), (20, 80, "http://a", 0), (20, 21, "http://b", 0)):
        rows = spark.createDataFrame([("r", 1, claim.format(a), "http://a"), ("r", 2, claim.format(b), url)], "run string, seq long, claim string, url string")
        assert research.contradiction_pairs(rows).count() == n and research.contradictions_greedy(rows).count() == n
    ranked = spark.createDataFrame([(i, float(9 - i)) for i in range(5)], "id long, score double")
    assert [r.id for r in research.sandwich(ranked).orderBy("position").collect()] == [0, 2, 4, 3, 1]


def test_thinking_and_calls(spark):
    assert frames.split_thinking("a<think>b</think>c") == ("ac", "b", False) and frames.split_thinking("b</thinking>c<think>", True) == ("c", "b", True)
    assert frames.split_thinking("<thi") == ("<thi", "", False) and frames.split_thinking("</think>x") == ("</think>x", "", False)
    rows = [(1, 1, 0, "a", "f", '{"x"'), (1, 2, 0, None, None, ":1}"), (1, 3, None, "b", "g", "{}")]
    got = frames.assemble_tool_calls(spark.createDataFrame(rows, "response_id long, seq long, index int, id string, name string, arguments string")).orderBy("index").collect()
    assert [(r["index"], r.id, r.name, r.arguments) for r in got] == [(0, "a", "f", '{"x":1}'), (1, "b", "g", "{}")]


def test_thinking_stream(spark, tmp_path):
    deltas = spark.createDataFrame([(1, 1, "a<think>b"), (1, 2, "c</think>d"), (2, 1, "x")], "response_id long, seq long, text string")
    deltas.write.parquet(str(tmp_path / "in"))
    from lodestone.streaming import ledger

    stream = spark.readStream.schema(deltas.schema).parquet(str(tmp_path / "in"))
    got = {(r.response_id, r.seq): (r.text, r.think) for r in ledger.settle(frames.thinking_stream(stream), "append").collect()}
    assert got == {(1, 1): ("a", "b"), (1, 2): ("d", "c"), (2, 1): ("x", "")}


def test_collections(spark):
    rows = [("c", "conv_a", "s", 30.0), ("c", "conv_a_chunk0", "s", 10.0), ("c", "conv_b#msg-1", "s", 20.0), ("c", "p", "update_prefs", None)]
    c = spark.createDataFrame(rows, "collection string, id string, source_id string, indexed_at double")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(collections.delete(c, prefixes=["conv_a"])) == {"conv_b#msg-1", "p"} and ids(collections.delete(c, source_ids=["update_prefs"])) == {"conv_a", "conv_a_chunk0", "conv_b#msg-1"}
    assert ids(collections.evict_oldest(c, 2)) == {"conv_a", "conv_b#msg-1"} and ids(collections.evict_oldest(c, 0)) == ids(c)
    with pytest.raises(ValueError):
        collections.delete(c)
    new = spark.createDataFrame([("c", "n1", "n", 40.0), ("c", "n2", "n", 40.0)], c.schema)
    assert ids(collections.upsert(c, new, [], cap=4)) == {"conv_a", "conv_b#msg-1", "n1", "n2"} and ids(collections.upsert(c, new.limit(0), ["conv_a"])) == ids(c)


def test_budgets(spark):
    rows = [(1, 0, "system", "s" * 10), (1, 1, "user", "u" * 50), (1, 2, "assistant", "a" * 50), (1, 3, "user", "v" * 50), (1, 4, "assistant", "b" * 5), (2, 0, "assistant", "only")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.start_turn for r in chat.budget_tail(m, 70, F.length("text")).collect()}
    assert got == {1: 3, 2: 0}
    assert {r.conv_id: r.start_turn for r in chat.budget_tail(m, 20, F.length("text")).collect()}[1] == 3
    kept = sorted(r.turn for r in chat.system_suffix(m, 75, F.length("text")).where("conv_id = 1").collect())
    assert kept == [0, 3, 4]


def test_ledger(spark):
    base = [(1, "2024-01-01 05:00:00", "openai", "gpt-4o", 5000, 1000, 0, "completed", True, False), (2, "2024-01-02 05:00:00", "openai", "gpt-4o", 3000, 1000, 0, "tool-call-turn", False, False), (3, "2024-01-02 06:00:00", " ", "m", 1, 1, 0, None, True, True), (4, "2024-01-02 07:00:00", "ollama", "llama3", 0, 0, 0, "completed", True, True)]
    e = spark.createDataFrame(base, "event_id long, ts string, provider string, model string, prompt long, completion long, cached long, status string, exact boolean, local boolean").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.to_date("ts"))
    x = usage.xp(e).collect()
    assert [(r.provider, r.xp, r.replies, r.stage) for r in x] == [("openai", 10000, 1, "sprout")]
    assert [(r.event_id, r.to_stage) for r in usage.stage_ups(e).collect()] == [(2, "sprout")]
    assert usage.local_streak(usage.daily(e)).first().local_streak == 0
