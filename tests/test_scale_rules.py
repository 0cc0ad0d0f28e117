"""Operators that replaced one-task windows and joins on common words, against plain Python."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import history, ranks, research, sessions
from lodestone.sources.store import ChunkStore


@pytest.mark.parametrize("hot", [2000, 3])
def test_overlapping_is_exact(spark, hot):
    rng = random.Random(hot)
    sets = [(i, rng.sample([f"w{int(rng.paretovariate(0.7))}" for _ in range(40)], rng.randrange(9)) + ["all"] * (i % 4 > 0)) for i in range(120)]
    sets = [(i, sorted(set(w))) for i, w in sets]
    got = {(r.i, r.j): r.shared for r in research.overlapping(spark.createDataFrame(sets, "seq long, w array<string>"), hot=hot).collect()}
    want = {(a, b): n for (a, x), (b, y) in combinations(sets, 2) if (n := len(set(x) & set(y))) >= 3}
    assert got == want and want
    assert research.overlapping(spark.createDataFrame([], "seq long, w array<string>")).count() == 0


def test_a_common_word_brings_nothing_together(spark):
    sets = spark.createDataFrame([(i, ["all", "both", f"a{i}", f"b{i}"]) for i in range(300)], "seq long, w array<string>")
    near = research.overlapping(sets)
    assert near.count() == 0
    joined = [m for m in near._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in m]
    assert joined and not any("Cartesian" in m or "NestedLoop" in m for m in joined)


def test_places(spark):
    rows = spark.range(500).select("id", (F.col("id") * 7919 % 13).alias("x"), F.lit(1).alias("_r"))
    got = ranks.placed(rows, [F.desc("x"), F.col("id")]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(500)) and [(-r.x, r.id) for r in got] == sorted((-r.x, r.id) for r in got) and got[0]._r == 1
    assert ranks.placed(rows.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("most", [5, 40, 4000])
def test_carried_facts(spark, most):
    rng = random.Random(most)
    pages = [(run, i, ["x" * rng.randrange(9) for _ in range(rng.randrange(5))] if rng.random() < 0.8 else None) for run in ("a", "b") for i in range(60)]
    frame = spark.createDataFrame(pages, "run string, seq long, facts array<string>")
    got = {(r.run, r.seq): r.carried for r in sessions.carried_facts(frame, most).collect()}
    for run in ("a", "b"):
        before: list[str] = []
        for r, i, facts in pages:
            if r == run:
                assert got[run, i] == "\n".join(t for t in before if t)[-most:], (run, i)
                before.append("\n".join(f"- {f}" for f in (facts or [])[:3]))


def test_carried_facts_of_a_long_run(spark):
    """Two hundred thousand pages of one run: nothing that a page collects grows with it."""
    pages = spark.range(200_000).select(F.lit("r").alias("run"), F.col("id").alias("seq"), F.array(F.concat(F.lit("fact "), "id")).alias("facts"))
    last = sessions.carried_facts(pages).where("seq = 199999").first()
    want = "\n".join(f"- fact {i}" for i in range(199_000, 199_999))[-4000:]
    assert last.carried == want


def test_store_opens_few_files(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=16)
    rows = lambda *ids: spark.createDataFrame([(f"i{k}", f"s{k % 40}", f"text {k}") for k in ids], "id string, source_id string, content string")
    assert store.all().count() == 0 and store.get(["i1"]).count() == 0 and store.of_sources(["s1"]).count() == 0 and store.get([]).count() == 0
    assert store.upsert(rows(*range(400)), batch=0)
    every = len(store.all().inputFiles())
    assert len(store.get(["i7"]).inputFiles()) == 1 and [r.content for r in store.get(["i7"]).collect()] == ["text 7"]
    found = store.of_sources(["s3"])
    assert len(found.inputFiles()) < every and sorted(r.id for r in found.collect()) == sorted(f"i{k}" for k in range(3, 400, 40))
    assert not store.upsert(rows(1), batch=0) and store.upsert(spark.createDataFrame([("i7", "s9", "new"), ("i7", "s9", "old"), (None, "s", "x")], "id string, source_id string, content string"), batch=1)
    again = ChunkStore(spark, str(tmp_path / "s"), buckets=16)
    assert [r.content for r in again.get(["i7"]).collect()] == ["old"] and again.all().count() == 400 and len(again.get(["i7"]).inputFiles()) <= 2
    assert {r.id for r in again.of_sources(["s9"]).collect()} == {f"i{k}" for k in range(9, 400, 40)} | {"i7"} and "i7" not in {r.id for r in again.of_sources(["s7"]).collect()}


def test_snapshot_levels(spark):
    words = F.array(*(F.lit(f"w{i}") for i in range(30)))
    branch = F.array(F.struct(F.lit("t").alias("topic"), F.repeat(F.lit("é"), 9000).alias("findings"), words.alias("facts"), words.alias("sources")))
    row = lambda most: spark.range(1).select(research.snapshot(branch, words, F.lit("why"), F.lit("around"), most).alias("s"), ).select("s.*", F.from_json("s.json", "branches array<struct<findings:string,facts:array<string>,sources:array<string>>>, citations array<string>, rationale string, context string").alias("b")).first()
    whole = row(1 << 20)
    assert whole.level == 0 and whole.bytes == len(whole.json.encode()) and whole.b.branches[0].findings == "é" * 8000 + research.CUT_MARK and len(whole.b.branches[0].facts) == 20 and whole.b.rationale == "why"
    first = row(whole.bytes - 1)
    assert first.level == 1 and first.b.branches[0].findings.endswith(research.AGAIN_MARK) and len(first.b.branches[0].facts) == 10 and len(first.b.branches[0].sources) == 10 and len(first.b.citations) == 15
    last = row(10)
    assert last.level == 3 and last.b.rationale == last.b.context == "" and len(last.b.branches[0].facts) == 4 and len(last.b.citations) == 10 and row(first.bytes - 1).level == 2


def test_history(spark):
    kind = "id string, title string, custom_title boolean, description string, archived boolean, saved_at double, place long, messages array<struct<role:string,content:string>>"
    new = lambda *rows: spark.createDataFrame([(i, float(at), [("system", "s"), ("user", text)] if text is not None else [("assistant", "x")]) for i, at, text in rows], "id string, saved_at double, messages array<struct<role:string,content:string>>")
    h = history.save(spark.createDataFrame([], kind), new(("a", 1, " one\n two "), ("b", 2, "y" * 70), ("c", 3, None), ("d", 4, "")))
    assert [(r.id, r.title) for r in history.listed(h).collect()] == [("d", ""), ("b", "y" * 60 + "…"), ("a", "one two")]
    h = history.rename(h, spark.createDataFrame([("a", " My\n title ", " about  it "), ("b", "", None), ("z", "t", None)], "id string, new_title string, new_description string"))
    h = history.archive(h, spark.createDataFrame([("a",), ("a",), ("q",)], "id string"))
    h = history.save(h, new(("a", 9, "later"), ("b", 10, "later")), most=2)
    assert [(r.id, r.title, r.custom_title, r.description, r.archived) for r in h.orderBy(F.desc("place")).collect()] == [("b", "later", False, None, False), ("a", "My title", True, "about it", True)]
    h = history.rename(history.archive(h, spark.createDataFrame([("a",)], "id string"), False), spark.createDataFrame([("a", " ", " ")], "id string, new_title string, new_description string"))
    assert [(r.id, r.title, r.description) for r in history.listed(h).collect()] == [("b", "later", None), ("a", "later", None)]
    assert [r.id for r in history.delete(h, spark.createDataFrame([("b",)], "id string")).collect()] == ["a"]
