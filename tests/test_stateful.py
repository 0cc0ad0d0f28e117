"""Streams with state: the same result in one batch, in many, and across a restart."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.streaming import stateful as S


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6), st.lists(st.integers(1, 9), min_size=1, max_size=20), st.booleans())
def test_frames_whatever_the_chunks(texts, widths, lines):
    frames = [json.dumps({"t": t}, ensure_ascii=False) for t in texts]
    data = "".join(f"{f}\r\n" if lines else f": note\nevent: x\ndata: {f}\n\n" for f in frames).encode() + (b"" if lines else b"data: [DONE]")
    rows, at, n = [], 0, 0
    while at < len(data):
        rows.append({"data": data[at : at + widths[n % len(widths)]], "dialect": "lines" if lines else "choices", "last": False})
        at, n = at + widths[n % len(widths)], n + 1
    rows.append({"data": b"", "dialect": "lines" if lines else "choices", "last": True})
    out, carry, count = S._framed(1, rows, b"", 0)
    assert [f for *_, f in out] == frames and carry == b"" and count == len(frames) and [s for _, s, *_ in out] == list(range(count))


@pytest.fixture
def chunks(spark):
    data = "".join(f"data: {json.dumps({'n': i, 't': 'é日' * i}, ensure_ascii=False)}\n" for i in range(9)).encode()
    rows = [(r, k, "choices", bytearray(data[a : a + 5 + r]), a + 5 + r >= len(data)) for r in (1, 2) for k, a in enumerate(range(0, len(data), 5 + r))]
    return spark.createDataFrame(rows, "response_id long, seq long, dialect string, data binary, last boolean")


def test_frames_over_batches(chunks):
    want = sorted(map(tuple, S.frames_batch(chunks).collect()))
    assert len(want) == 18 and sorted(map(tuple, S.replay(chunks, S.frames_stream, 3).collect())) == want


def test_recent_ids_leave_in_order(spark):
    rows = [{"id": i} for i in ("a", "b", "a", "c", "a", "d", "b", "", None, " ", "", "d")]
    assert [r["id"] for r in S.recent_fold(rows, [], 2)[0]] == ["a", "b", "c", "a", "d", "b", "", None, " ", ""]
    assert S.recent_fold(rows, [], 2)[1] == ["d", "b"] and [r["id"] for r in S.recent_fold(rows, ["a", "b", "c", "d"], 4)[0]] == ["", None, " ", ""]
    frame = spark.createDataFrame([(1, r["id"], k, k) for k, r in enumerate(rows)], "store long, id string, ts long, event_id long")
    assert [r.event_id for r in S.replay(frame, lambda d: S.recent_stream(d, 2), 3, "event_id").orderBy("event_id").collect()] == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10]


def test_cache_commands(spark):
    day = S.DAY_MS
    rows = [
        ("put", "search", " Ab ", "1", 0, None), ("get", "search", "aB", None, day, None), ("get", "search", "ab", None, day, 5), ("get", "search", "ab", None, day, None),
        ("put", "crawl", "u", "2", day, 10), ("get", "fetch", "u", None, day, None), ("get", "crawl", " u", None, day + 10, None), ("put", "fetch", "u", "3", day, None), ("get", "crawl", "u", None, day, None),
        ("put", "search", "x", "4", day, None), ("get", "fetch", "u", None, day, None), ("put", "search", "y", "5", day, None), ("get", "fetch", "u", None, day, None), ("invalidate", "search", "X", None, day, None),
        ("get", "search", "x", None, day, None), ("clear", None, None, None, day, None), ("get", "search", "y", None, day, None),
    ]
    commands = [(7, n, *r) for n, r in enumerate(rows)]
    frame = spark.createDataFrame(commands, "cache long, seq long, op string, kind string, key string, value string, at long, ttl long")
    got = sorted(map(tuple, S.replay(frame, lambda d: S.cache_stream(d, 2), 4).collect()))
    assert [(g[3], g[4]) for g in got if g[2] == "get"] == [(True, "1"), (False, None), (False, None), (False, None), (True, "2"), (False, None), (True, "3"), (False, None), (False, None), (False, None)]
    assert [g[5] for g in got] == [1, 1, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2, 1, 1, 0, 0]


def test_stage_ups_once_across_restarts(spark, tmp_path):
    from lodestone.functions.pricing import XP_STAGES

    step = XP_STAGES[3][0] // 10 + 1
    rows = [(i, "openai", step) for i in range(30)]
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))

    def go(first, last):
        frame = spark.createDataFrame([(i, p, t) for i, p, t in rows[first:last]], "event_id long, provider string, total long").withColumn("ts", F.timestamp_seconds("event_id"))
        frame.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(frame.schema).parquet(src)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", S._ROCKS)
        done = stream.groupBy("provider").transformWithStateInPandas(S._StageUps(), "provider string, event_id long, from_stage string, to_stage string, xp long", "Append", "None")
        done.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()

    go(0, 4), go(4, 5), go(5, 30)
    got = [(r.event_id, r.from_stage, r.to_stage, r.xp) for r in spark.read.parquet(out).orderBy("event_id").collect()]
    stage = lambda n: max(k for k, (least, _) in enumerate(XP_STAGES) if n >= least)
    want = [(i, XP_STAGES[stage(step * i)][1], XP_STAGES[stage(step * (i + 1))][1], step * (i + 1)) for i in range(30) if stage(step * i) < stage(step * (i + 1)) and XP_STAGES[stage(step * (i + 1))][1] != "hatchling"]
    assert got == want and want
