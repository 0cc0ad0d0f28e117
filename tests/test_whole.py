"""Queries work on all rows and on whole texts; expected values are computed from the tables in plain Python."""

from __future__ import annotations

import re

from lodestone.plans import research as plans
from lodestone.plans.queries import QUERIES
from lodestone.session import table


def test_contradictions_of_all_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").collect()
    said = sorted((r.doc_id, r.doc_id % 37 + 1) for r in docs)
    apart = lambda x, y: (max(x, y) - min(x, y)) / max(x, y) > 0.15
    want = sorted((i, j) for i, x in said for j, y in said if i < j and i // 20 == j // 20 and apart(x, y))
    assert {i for pair in want for i in pair} == {r.doc_id for r in docs}
    for name in ("contradiction_pairs", "contradictions_greedy"):
        assert sorted((r.i, r.j) for r in QUERIES[name](spark, sf_dir).select("i", "j").collect()) == want, name


def test_replies_are_read_whole(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").collect()
    size = sum(len(r.text or "") for r in turns)
    assert max(len(r.text or "") for r in turns) > 40
    split = QUERIES["thinking_split"](spark, sf_dir).collect()
    assert sum(len(r.text) + len(r.think) for r in split) == size and all("think>" not in r.text + r.think for r in split)
    assert sum(len(r.arguments) for r in QUERIES["tool_call_assembly"](spark, sf_dir).collect()) == size


def test_queries_are_classified_whole(spark, sf_dir):
    texts = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    late = {i for i, t in texts.items() if i % 4 < 3 and i % 3 < 2 and len(re.findall(r"\b(?:and|or)\b", t.lower())) >= 2 > len(re.findall(r"\b(?:and|or)\b", t[: 5 + (i % 9) * 12].lower()))}
    assert late and late <= {r.item_id for r in QUERIES["query_expansion"](spark, sf_dir).where("multi").collect()}


def test_synthesis_has_all_findings_that_fit(spark):
    rows = [(i, f"finding {i:03d}" + " tulip" * (i % 50), f"https://a.org/{i % 7}") for i in range(300)]
    facts = spark.createDataFrame(rows, "seq long, claim string, url string")
    said = [x for x in plans.synthesis(facts, "tulip").splitlines() if x.startswith("- finding")]
    assert len(said) == 300
    said = plans.synthesis(facts, "tulip", budget=6000)
    kept = {i for i, claim, _ in rows if f"- {claim} [" in said}
    assert kept == set(sorted(range(300), key=lambda i: (-(i % 50), i))[: len(kept)]) and 2 < len(kept) < 300
    assert f"[+{300 - len(kept)} more facts available]" in said
