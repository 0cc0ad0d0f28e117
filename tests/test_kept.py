"""Versioned tables that survive a crash at any step, and the kept lexical index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.operators.postings import KeptIndex
from lodestone.sources.versioned import VersionedTables, dropped


class Crash(Exception):
    pass


def rows(spark, *values):
    return spark.createDataFrame([(v, f"c{v % 2}") for v in values], "id long, c string")


def ids(frame):
    return [] if frame is None else sorted(r.id for r in frame.collect())


@pytest.mark.parametrize("step", ["staged", "manifest", "flipped"])
def test_crash_and_reopen(spark, tmp_path, step):
    root = str(tmp_path / "t")
    VersionedTables(spark, root).commit({"a": rows(spark, 1, 2), "b": rows(spark, 9)}, by={"a": ("c",)})

    def after(now):
        if now == step:
            raise Crash

    with pytest.raises(Crash):
        VersionedTables(spark, root).commit({"a": rows(spark, 3)}, after=after)
    again = VersionedTables(spark, root)
    left = again.recover()
    assert ids(again.read("a")) == ([1, 2, 3] if step == "flipped" else [1, 2]) and ids(again.read("b")) == [9]
    assert bool(left) == (step != "flipped") and not again.recover()
    again.commit({"a": rows(spark, 4)})
    assert 4 in ids(VersionedTables(spark, root).read("a"))


def test_versions(spark, tmp_path):
    t = VersionedTables(spark, str(tmp_path / "t"))
    assert t.current().number == 0 and t.read("a") is None
    one = t.commit({"a": rows(spark, 1, 2, 3)}, by={"a": ("c",)}, meta={"x": 1})
    two = t.commit({"a": rows(spark, 5)}, tables={"a": dropped(one.tables["a"], ["c1"])}, by={"a": ("c",)})
    assert ids(t.read("a")) == [2, 5] and ids(t.read("a", one)) == [1, 2, 3] and two.meta == {"x": 1}
    with pytest.raises(RuntimeError, match="another writer"):
        t.commit({"a": rows(spark, 7)}, base=one)
    assert ids(t.read("a")) == [2, 5] and t.recover()
    t.commit({}, tables={"a": two.tables["a"][1:]})
    assert t.vacuum() and ids(t.read("a")) == [5] and t.current().number == 3
    empty = t.commit({"e": rows(spark, 1).limit(0)})
    assert ids(t.read("e")) == [] and empty.tables["e"][0].rows == 0


def test_damaged_rows_are_not_committed(spark, tmp_path, monkeypatch):
    t = VersionedTables(spark, str(tmp_path / "t"))
    told = iter("ab")  # what is read back never equals what was written
    monkeypatch.setattr("lodestone.sources.versioned.checksum", lambda columns: (F.count(F.lit(1)).alias("rows"), F.max(F.lit(next(told))).alias("hash")))
    with pytest.raises(RuntimeError, match="wrote"):
        t.commit({"a": rows(spark, 1)})
    assert t.current().number == 0 and t.recover()


QUERIES = ("alpha alpha Gamma! rare", "beta")


def corpus(spark, first, last):
    text = F.concat_ws(" ", F.when(F.col("id") % 2 == 0, "alpha"), F.when(F.col("id") % 3 == 0, "beta beta"), F.when(F.col("id") % 50 == 0, "gamma"), F.when(F.col("id") == 77, "rare"), F.concat(F.lit("w"), F.col("id") % 13), F.repeat(F.lit("pad "), (F.col("id") % 7).cast("int")))
    return spark.range(first, last).select(F.concat(F.lit("c"), F.col("id") % 3).alias("collection"), "id", F.when(F.col("id") % 41 != 0, text).alias("content"))


def same(index, live, k=5):
    for q in QUERIES:
        got = [(r.collection, r.id, r.rank0, round(r.normalized, 6)) for r in index.search(q, k).orderBy("collection", "rank0").collect()]
        want = [(r.collection, r.id, r.rank0, round(r.normalized, 6)) for r in retrieval.lexical_topk(live, q, k).orderBy("collection", "rank0").collect()]
        assert got == want, q


def test_index_follows_changes(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "i"), block=16)
    assert index.search("alpha", 3).count() == 0
    index.insert(corpus(spark, 0, 300))
    index.insert(corpus(spark, 300, 400))
    assert index.search("none of these", 3).count() == index.search("", 3).count() == 0
    same(index, corpus(spark, 0, 400))
    index.delete(corpus(spark, 0, 400).where("id % 5 = 0 and collection <> 'c1'"))
    before = {p.folder for p in index.tables.current().tables["postings"]}
    live = corpus(spark, 0, 400).where("id % 5 <> 0 or collection = 'c1'")
    same(KeptIndex(spark, str(tmp_path / "i"), block=16), live)
    assert before < {p.folder for p in index.tables.current().tables["postings"]} and index.freshen() == []
    index.insert(corpus(spark, 0, 1))
    same(index, live.unionByName(corpus(spark, 0, 1)))


def test_index_skips_blocks(spark, tmp_path):
    docs = spark.range(4000).select(F.lit("c").alias("collection"), "id", F.concat(F.lit("common "), F.when(F.col("id") % 997 == 5, F.repeat(F.lit("word "), 9)).otherwise(F.when(F.col("id") % 3 == 0, "word ").otherwise("")), F.repeat(F.lit("x "), 20)).alias("content"))
    index = KeptIndex(spark, str(tmp_path / "i"), block=16)
    index.insert(docs)
    bounds, opened, _ = index.plan("word", 3)
    assert opened.count() < bounds.count() / 10
    assert [r.id for r in index.search("word", 3).orderBy("rank0").collect()] == [r.id for r in retrieval.lexical_topk(docs, "word", 3).orderBy("rank0").collect()]


def test_rows_cross_one_exchange_in_blocks(spark, tmp_path, monkeypatch):
    """F4-F7: a change's postings are exchanged once, as rows of blocks (three times before, once of them as single postings)."""
    seen, stage = [], VersionedTables.stage

    def watch(self, frame, by=(), options=None):
        if "max_tf" in frame.columns:
            seen.append((frame._jdf.queryExecution().executedPlan().toString().count("Exchange"), frame.count()))
        return stage(self, frame, by, options)

    monkeypatch.setattr(VersionedTables, "stage", watch)
    docs = corpus(spark, 0, 3000)
    index = KeptIndex(spark, str(tmp_path / "i"))
    index.insert(docs.coalesce(1))
    exchanges, rows = seen[0]
    assert exchanges == 1 and rows < retrieval.postings(docs).count() / 10


def test_blocks_wherever_they_end(spark, tmp_path, monkeypatch):
    """Blocks that end by words, by what waits, or over many batches give what whole ones give; so do rewritten ones."""
    from lodestone.operators import postings

    monkeypatch.setattr(postings, "WORDS", 40)
    monkeypatch.setattr(postings, "WAITING", 150)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index, docs = KeptIndex(spark, str(tmp_path / "i"), block=16), corpus(spark, 0, 200)
        index.insert(docs.where("id % 2 = 0"))
        index.insert(docs.where("id % 2 = 1"))
        index.delete(docs.where("id % 7 = 0").select("collection", "id").unionByName(spark.createDataFrame([("c0", 10**6), ("none", 5)], "collection string, id long")))
        live = docs.where("id % 7 <> 0")
        index.freshen()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    same(index, live)
    told = {r.collection: (r.n_docs, round(r.avg_len, 9)) for r in index.tables.read("statistics").collect()}
    assert told == {r.collection: (r.n_docs, round(r.avg_len, 9)) for r in retrieval.corpus_stats(live).collect()}
