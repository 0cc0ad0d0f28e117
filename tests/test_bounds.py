"""Work that must not gather in one task, one group or one row at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import sessions
from lodestone.plans import queries
from lodestone.sources import store
from lodestone.streaming import stateful


def test_stage_ups_hold_no_row_as_a_dict():
    """300,000 rows of one provider in three parts of a batch: as numbers they take a few megabytes."""
    import tracemalloc

    class Ups(stateful._StageUps):
        kept = 5_000

        def load(self):
            return self.kept

        def save(self, xp):
            self.kept = xp

    n, rng = 300_000, np.random.default_rng(3)
    ts, total = rng.permutation(n) // 3, rng.integers(1, 99, n)
    rows = pd.DataFrame({"ts": pd.to_datetime(ts, unit="s"), "event_id": rng.permutation(n), "total": total})
    ups = Ups()
    tracemalloc.start()
    got = pd.concat(ups.handleInputRows(("p",), iter([rows[:1000], rows[1000:200_000], rows[200_000:]]), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    upto = rows.sort_values(["ts", "event_id"]).assign(xp=lambda r: 5_000 + r["total"].cumsum())
    want = [("p", int(r.event_id), a, b, int(r.xp)) for at, a, b in ((10_000, "hatchling", "sprout"), (100_000, "sprout", "scholar"), (1_000_000, "scholar", "sage"), (10_000_000, "sage", "archmage")) for r in upto[upto.xp >= at][:1].itertuples()]
    assert list(map(tuple, got.itertuples(index=False))) == want and ups.kept == 5_000 + int(total.sum()) and peak < 40e6


def test_import_queue_has_more_files_for_more_parts(spark, sf_dir, monkeypatch):
    """A table of five parts is laid in the inbox as five files, in two batches."""
    seen = []
    real = queries.take_in
    monkeypatch.setattr(queries, "_stored", lambda s, d: real_stored(s, d).repartition(5))
    monkeypatch.setattr(queries, "take_in", lambda own, inbox, state, files: seen.append((spark.read.text(inbox).select(F.input_file_name()).distinct().count(), files)) or real(own, inbox, state, files=files))
    got = queries.import_queue(spark, sf_dir).agg(F.sum("n"), F.sum("chars")).first()
    monkeypatch.undo()
    docs = real_stored(spark, sf_dir)
    assert seen[0] == (5, 4) and tuple(got) == tuple(docs.agg(F.count("*"), F.sum(F.length("content"))).first())


real_stored = queries._stored


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own = store.ChunkStore(spark, str(tmp_path), buckets=2)
        dealt = own._dealt(spark.range(1000).select((F.col("id") % 2).cast("int").alias("bucket"), F.col("id").cast("string").alias("id")))
        rows = [p for p in dealt.rdd.glom().map(lambda p: [(r.bucket, r.id) for r in p]).collect() if p]
        assert max(map(len, rows)) < 500 and all(p == sorted(p) for p in rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("most", [3, 10_000])
def test_lifecycle_is_carried_over_batches(spark, most):
    """Sessions run over the ends of batches, and no group is a call of its own."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most))
    try:
        actions = F.element_at(F.array(*map(F.lit, ["begin", "mark", "stop", "finish"])), (F.col("seq") % 4 + 1).cast("int"))
        e = spark.range(5 * 14).select((F.col("id") % 5).alias("session_id"), F.floor(F.col("id") / 5).alias("seq")).withColumn("action", actions)
        e = e.withColumn("argument", F.when(F.col("action") == "begin", "enriching").when(F.col("action") == "mark", "tool-loop")).withColumn("key", F.lit("k"))
        plan = sessions.lifecycle(e)
        got = sorted((r.session_id, r.seq, r.state, r.generation, r.ok) for r in plan.collect())
        states = ["enriching", "tool-loop", "stopping", "done"]
        assert got == [(s, q, states[q % 4], q // 4 + 1, True) for s in range(5) for q in range(14)]
        assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
