"""URL reputation, sharding, mixing and chat formatting on small tables with odd rows."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest

from lodestone.llm import chat, mixing, reputation, sharding


def test_urls(spark):
    urls = [
        ("HTTP://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com/de/", "example.com", "/de/", "com/", "allow"), ("http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"), ("http://x.net/de/", "x.net", "/de/", None, "allow"),
        ("http://notexample.net.org", "notexample.net.org", "", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://com", "com", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)] + [(3, urls[3][0], "x"), (None, None, None)], "page_id long, url string, host string").select("page_id", "url")
    none = spark.createDataFrame([], "host string, bad int")
    got = reputation.judge(pages, none).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:]
    assert reputation.judge(pages.limit(0), none).count() == 0


def test_reputation_shrinks(spark):
    bad = [("bad.org", 1)] * 40 + [("bad.org", 0)] * 5 + [("good.org", 0)] * 60 + [("new.org", 1)] + [(f"h{i}.org", 0) for i in range(40)]
    hosts = ("bad.org", "good.org", "new.org", "unseen.org", "sub.bad.org")
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.host: r.verdict for r in reputation.judge(pages, spark.createDataFrame(bad, "host string, bad int")).collect()}
    assert got["bad.org"] == "block" and got["good.org"] == got["new.org"] == got["unseen.org"] == "allow"


@pytest.mark.parametrize("copies", [0, 400])
def test_sharding(docs, copies):
    rows = [(i, f"text {i} " * (i % 50), "en", "s") for i in range(600)] + [(1000 + i, "a copy " * 30, "en", "s") for i in range(copies)] + [(5000, None, None, None), (5001, "", None, None), (None, "x", None, None)]
    got = sharding.assign(docs(rows)).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
        if r.doc_id is not None:
            text = dict((i, t) for i, t, *_ in rows)[r.doc_id]
            assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == (None if text is None else zlib.crc32(text.encode())) and r.law == "bytes" and r.grown_shard is None
    assert len(got) == len(rows) and set(size) <= set(range(16))
    assert max(size.values()) - min(size.values()) < 0.1 * max(size.values())
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    split = Counter(c for c, _ in {(r.text_crc32, r.shard) for r in got})
    assert sum(n > 1 for n in split.values()) <= 16
    assert sharding.assign(docs([])).count() == 0
    assert sharding.assign(docs(rows), carry=("score", "doc_id")).columns[-1] == "score"


def test_mixing(docs):
    rows = [(i, "w " * (1 + i % 40), "en", f"s{i % 5}") for i in range(3000)] + [(9000, None, None, None), (9001, "a b", None, None), (None, "c", "en", "s0")]
    frame = docs(rows)
    got = mixing.plan(frame).collect()
    again = {r.doc_id: r.taken for r in mixing.plan(frame.repartition(7)).collect()}
    assert len(got) == len(rows) and all(again[r.doc_id] == r.taken for r in got)
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9 for r in got)
    total = sum(r.size for r in got)
    per = {}
    for r in got:
        per.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert abs(sum(t for t, _ in per.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(n - t) <= 0.1 * t + 4 for t, n in per.values())
    out = mixing.emit(frame)
    assert out.columns == frame.columns and out.count() == sum(r.taken // r.size if r.size else 0 for r in got) + out.where("text is null").count()
    assert mixing.plan(docs([])).count() == 0 and mixing.plan(docs([(1, None, None, None)])).first().taken == 0


def test_chat(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", "<|end|> no"), (1, 2, "system", None), (1, None, None, "x"), (1, 1, "bob", "<|end|> no"), (2, 0, "system", "alone"), (None, 0, "ann", "lost"), (3, 0, "a|>", "")]
    frame = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, piece string").drop("piece")
    pieces = chat.perspectives(frame, block=2)
    rows = {(r.conv_id, r.participant): r for r in chat.text(pieces).collect()}
    assert set(rows) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "a|>")}
    ann = rows[1, "ann"]
    assert ann.text == "<|user name=unknown|>\nx<|end|>\n<|assistant|>\nhi<|end|>\n" + "<|user name=bob|>\n< |end|> no<|end|>\n" * 2 + "<|system|>\n<|end|>\n"
    assert [ann.text[s.start : s.end] for s in ann.spans] == ["hi"]
    bob = rows[1, "bob"]
    assert [bob.text[s.start : s.end] for s in bob.spans] == ["< |end|> no"] * 2
    for r in pieces.collect():
        whole = rows[r.conv_id, r.participant].text
        assert whole[r.span_start : r.span_end] == r.content and r.mask == (r.role == "assistant")
    assert chat.perspectives(frame.limit(0)).count() == 0


def test_sharding_cuts_rows_without_ids(docs):
    """Rows that share their text and have no id, or repeat one, are dealt like others, and a plain histogram agrees."""
    rows = [(None, "the same text " * 3, None, None)] * 400 + [(7, "another text", None, None)] * 200 + [(1000 + i, f"text {i}", None, None) for i in range(200)]
    got = sharding.assign(docs(rows)).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    share = sum(size.values()) / 16
    assert len(got) == len(rows) and all(abs(size[s] - share) <= 2 * 43 for s in range(16))
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_mixing_keeps_clashing_columns(spark):
    frame = spark.createDataFrame([(i, "a b", "s", "mine", "theirs", "x") for i in range(20)], "doc_id long, text string, source string, _size string, _source string, row string")
    out = mixing.emit(frame)
    assert out.columns == frame.columns and {(r._size, r._source, r.row) for r in out.collect()} == {("mine", "theirs", "x")}


@pytest.mark.parametrize("share", [2.0, 3.0])
def test_mixing_stops_at_the_cap(docs, share):
    frame = docs([(i, "w " * 3, "en", f"s{i % 3}") for i in range(30)])
    assert {r.target for r in mixing.targets(frame.select("source", mixing.words(frame.text).alias("size")), share=share, most=2).collect()} == {60.0}
    assert mixing.emit(frame, share=share, most=2).count() == 60
