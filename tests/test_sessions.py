from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import sessions as S
from lodestone.plans import research as R


def test_folds(spark):
    rows = [(1, 0, "system", 5), (1, 1, "user", 10), (1, 2, "assistant", 10), (1, 3, "user", 90), (1, 4, "user", 5), (1, 5, "tool", 5)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, tokens long")
    assert sorted(r.turn for r in S.greedy_spans(m, 40).collect()) == [0, 1, 2, 4, 5]
    assert sorted(r.turn for r in S.greedy_spans(m, 1).collect()) == [0, 4, 5]
    p = spark.createDataFrame([("r", 1, ["a", "b", "c", "d"]), ("r", 2, ["e"]), ("r", 3, [])], "run string, seq int, facts array<string>")
    assert [r.carried for r in S.carried_facts(p, 12).orderBy("seq").collect()] == ["", "- a\n- b\n- c"[-12:], "- a\n- b\n- c\n- e"[-12:]]


def test_lifecycle(spark):
    """A request from begin to end, and every reason for which an action is out of turn."""
    acts = [
        ("begin", "enriching", "a"), ("begin", "awaiting-model", "a"), ("mark", "tool-loop", None), ("begin", "awaiting-model", "b"), ("stop", None, None), ("stop", None, None),
        ("mark", "synthesis", None), ("begin", "tool-loop", "c"), ("finish", "error", None), ("finish", None, None), ("stop", None, None), ("begin", "resting", "d"),
        ("begin", "tool-loop", None), ("begin", "synthesis", "e"), ("finish", None, None),
    ]
    e = spark.createDataFrame([(1, k, *x) for k, x in enumerate(acts)], "session_id long, seq long, action string, argument string, key string")
    got = [(r.state, r.generation, r.reason) for r in S.lifecycle(e).orderBy("seq").collect()]
    assert got == [
        ("enriching", 1, None), ("awaiting-model", 1, None), ("tool-loop", 1, None), ("awaiting-model", 2, "response-overlap"), ("stopping", 2, None), ("stopping", 2, "already-stopping"),
        ("stopping", 2, "illegal-transition"), ("tool-loop", 2, "illegal-transition"), ("error", 2, None), ("error", 2, "not-active"), ("error", 2, "not-stoppable"), ("error", 2, "invalid-phase"),
        ("tool-loop", 3, None), ("synthesis", 3, None), ("done", 3, None),
    ]


def test_truncation(spark):
    tiers = [r.t for r in spark.range(1, 9).select(S.tier(F.col("id")).alias("t")).collect()]
    assert [t.read for t in tiers] == [16_000, 16_000, 8_000, 8_000, 4_000, 4_000, 2_000, 2_000]
    assert spark.range(1).select(S.tier(F.lit(6), S.RESEARCH_TIERS).alias("t")).first().t.knowledge == 5_000
    page = "x" * 3000 + "\n\n--- Links on this page (1) ---\n1. [a](b)"
    found = "Head\n" + "".join(f"{i}. Title\n   URL: u{i}\n   {'s' * 400}\n" for i in range(1, 7))
    rows = spark.createDataFrame([("read_url", page), ("knowledge_search", page), ("web_search", found), ("document", page), ("read_url", "short")], "tool string, text string")
    got = [r[0] for r in rows.select(S.truncated(F.col("text"), F.col("tool"), F.lit(7))).collect()]
    assert got[0].endswith("re-read this page later if you need the rest.]\n\n--- Links on this page (1) ---\n1. [a](b)") and got[0].startswith("x" * 1500) and len(got[0]) <= 2000
    assert got[1].startswith("x" * 2000 + "\n\n[Content trimmed at iteration 7") and "Links" not in got[1]
    assert got[2].count("Title") == 4 and got[2].endswith("[1 more results trimmed — iteration 7.]") and max(map(len, got[2].split("\n"))) == 201
    assert got[3:] == [page, "short"]


def test_stores(spark):
    p = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "name string, n int, t double")
    assert [r.name for r in S.matches({"n": 1, "t": 0.5 + 1e-8}, p).collect()] == ["a"] and [r.name for r in S.matches({"n": 2, "t": 9.0}, p).collect()] == ["b"]
    assert {(r.name, r.n) for r in S.upsert(p, spark.createDataFrame([("a", 7, 1.0)], p.schema), "name").collect()} == {("a", 7), ("b", 2)}
    old = spark.createDataFrame([("x", "2024-01-01", 9000, None), ("x", "2024-01-02", 1000, 3)], "provider string, day string, total long, cached long")
    assert [(r.xp, r.stage, r.cached) for r in S.migrate_ledger(old).orderBy("day").collect()] == [(9000, "hatchling", 0), (10000, "sprout", 3)]
    rows = S.tool_catalog(spark).collect()
    assert len(rows) == 9 and {r.name for r in rows if r.danger == "potentially_unsafe"} == {"document", "update_knowledge", "forget_knowledge"}
    tools = {r.name: json.loads(r.function_schema) for r in rows if r.function_schema}
    assert set(tools) == {r.name for r in rows} - {"document", "deep_research"} and tools["read_url"]["function"]["parameters"]["required"] == ["url"]


def test_research_run(spark):
    html = '<p>Solar capacity growth reached {} percent.</p><a href="/more-solar">solar more</a>'

    def llm(prompt: str) -> str:
        if prompt.startswith("Plan"):
            return '[{"sub_task": "solar", "search_query": "solar"}, {"sub_task": "wind", "search_query": "wind"}]'
        return '[{"claim": "solar capacity growth reached %s percent", "url": ""}]' % ("20" if "20" in prompt else "80")

    tools = R.Tools(
        search=lambda q: spark.createDataFrame([(f"https://{q}.org/a", q, ""), ("http://localhost/x", "l", "")], "url string, title string, content string"),
        fetch=lambda urls: spark.createDataFrame([(k, u, html.format(20 if "solar.org" in u else 80)) for k, u in enumerate(urls)], "page_id long, url string, html string"), llm=llm, spark=spark,
    )
    prompt = R.run(tools, "How fast does solar grow?")
    assert "[1]" in prompt and "https://solar.org/a" in prompt and "Conflicts:" in prompt and "localhost" not in prompt
