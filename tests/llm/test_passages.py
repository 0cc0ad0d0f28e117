"""Repeated passages against brute force, with every way that a bucket can be told."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffixes


def brute(rows):
    low: dict[bytes, int] = {}
    for i, text in rows:
        for p in range(len(text or b"") - 49) if i is not None else ():
            low[text[p : p + 50]] = min(i, low.get(text[p : p + 50], i))
    out = []
    for i, text in rows:
        text = text or b""
        gone = np.zeros(len(text) + 1, dtype=bool)
        for p in range(len(text) - 49) if i is not None else ():
            if low[text[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((i, len(text), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(text) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice(["lorem", "ipsum", "é", "dolor", "sit", "amet", "consectetur", "ß", "x" * 30, "日本"])
    sentence = lambda k: " ".join(word() + str(rng.randrange(1000)) for _ in range(k))
    passages = [sentence(k) for k in (5, 9, 12, 30, 200)]
    rows = []
    for i in range(n):
        parts = [sentence(rng.randrange(12)) for _ in range(3)] + [p[rng.randrange(5) : len(p) - rng.randrange(5)] for p in rng.sample(passages, 2)]
        rng.shuffle(parts)
        rows.append((rng.randrange(n), " ".join(parts)))
    same = "a line that all of them share, whatever comes before or after it: yes"
    rows += [(1000 + i, f"{sentence(2)} {same} {sentence(2)}") for i in range(60)]
    rows += [(2000, passages[3] + passages[3]), (2001, passages[3]), (3, passages[4]), (3, passages[4]), (None, passages[4]), (2002, None), (2003, ""), (2004, "x" * 49), (2005, "x" * 50), (2006, "x" * 51), (2007, "ab" * 60), (2008, "ab" * 60), (2009, "\0" * 80), (2010, "\0" * 70 + "a")]
    return rows


@pytest.mark.parametrize("limits", [{}, {"hot": 3}, {"busy": 3}, {"hot": 5, "busy": 8, "part": 200, "asked": 20}])
def test_brute_force(docs, limits):
    rows = corpus(len(limits))
    want = brute([(i, t and t.encode()) for i, t in rows])
    frame = docs([(i, t, None, None) for i, t in rows]).repartition(5)
    assert sorted(map(tuple, suffixes.deduplicate(frame, **limits).collect()), key=str) == want
    assert suffixes.deduplicate(frame.limit(0)).count() == 0
    if not limits:
        left = suffixes.repeats(frame).collect()
        assert sorted((str(r.doc_id), sum(b - a for a, b in r.removed), hashlib.sha256(r.text).hexdigest()) for r in left) == sorted((str(w[0]), w[2], w[4]) for w in want)


def test_long_text(spark, docs, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef gh") for _ in range(300_000))
    rows = [(1, long), (2, "x" + long[70_000:250_000] + "y"), (3, long[:49] + "-" + long[100:149])]
    got = {r.doc_id: r for r in suffixes.deduplicate(docs([(i, t, None, None) for i, t in rows])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 180_000 and got[2].n_spans == 1 and got[3].n_removed == 0
    assert got[2].kept_sha256 == hashlib.sha256(b"xy").hexdigest()


def test_sampling_finds_every_equal_string():
    """Wherever a string lies, the same suffix of it is sampled."""
    rng = np.random.default_rng(3)
    string = rng.integers(97, 105, 50, dtype=np.uint8).tobytes()
    places = []
    for _ in range(200):
        before, after = (rng.integers(97, 105, rng.integers(0, 90), dtype=np.uint8).tobytes() for _ in range(2))
        s = suffixes.suffixes([b"other", before + string + after])
        at = s.at[s.of == 1] - s.start[1] - len(before)
        places.append(set(at[(at >= 0) & (at <= 21)].tolist()))
    assert set.intersection(*places)


def test_refined_compares_bytes():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 2, (60, suffixes.REACH), dtype=np.uint8)
    rows[30:, :60] = rows[:30, :60]
    left, right = rng.integers(0, 22, 60), rng.integers(0, 22, 60)
    doc = rng.permutation(60) // 2
    mask = suffixes.refined(rows, left, right, doc)
    inside = lambda i, k: k >= 21 - left[i] and k + 50 <= 50 + right[i]
    for i in range(60):
        for k in range(22):
            want = inside(i, k) and any(doc[j] < doc[i] and inside(j, q) and bytes(rows[j, q : q + 50]) == bytes(rows[i, k : k + 50]) for j in range(60) for q in range(22))
            assert bool(mask[i] >> k & 1) == want


def test_refining_a_part_and_a_batch_of_texts_fit_a_worker():
    """Of a part of surroundings as large as parts are asked to be, and of a batch of many texts, little is held together."""
    import tracemalloc

    import pyarrow as pa

    from lodestone.llm import suffixes as S

    rng = np.random.default_rng(4)
    bytes_ = rng.integers(97, 99, (S.ASKED, S.REACH)).astype(np.uint8)
    full = np.full(S.ASKED, S.SIDE, dtype=np.uint8)
    texts = ["".join(rng.choice(list("abcdefgh "), 3000)) for _ in range(40)]
    batch = pa.record_batch({"doc_id": pa.array(range(10_000)), "text": pa.array([texts[i % 40] for i in range(10_000)])})
    tracemalloc.start()
    S.refined(bytes_, full, full, np.arange(S.ASKED))
    parts = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    next(iter(S._send(8, 100)(iter([batch]))))
    sent = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts < 50e6 and sent < 45e6, (parts, sent)


def test_a_document_that_repeats_lines_is_told_once_a_name():
    """What is sent, marked and held of a document doesn't grow with the square of the times that it repeats a line."""
    import tracemalloc

    import pyarrow as pa

    from lodestone.llm import suffixes as S

    line = "a line that two documents share and that each repeats very often"
    rows = [(1, f"{line} one " * 600), (2, f"{line} two " * 600), (3, f"{line} two " * 600)]
    texts = [t.encode() for _, t in rows]
    want = {w[0]: w[2:4] for w in brute(list(zip((1, 2, 3), texts, strict=True)))}
    for hot in (S.HOT, 1):
        tracemalloc.start()
        sent = pa.Table.from_batches(S._send(1, hot)(iter([pa.record_batch({"doc_id": pa.array([1, 2, 3]), "text": pa.array([t for _, t in rows])})])))
        told = {r["doc_id"]: r for r in S._gather(S._judge(S.BUSY, 1)(sent)).to_pylist()}
        lists = {k: pa.array([told.get(i, {}).get(k) for i, _ in rows], pa.binary()) for k in ("asked", "single")}
        back = pa.Table.from_batches(S._ask(1)(iter([pa.record_batch({"doc_id": pa.array([1, 2, 3]), "text": pa.array([t for _, t in rows])} | lists)])))
        marks = {r["doc_id"]: r["marks"] for r in S._gather_marks(S._refine(1)(back)).to_pylist()}
        runs = S.spans(texts, [told.get(i, {}).get("found") for i, _ in rows], [marks.get(i) for i, _ in rows])
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {i: (int((r[:, 1] - r[:, 0]).sum()), len(r)) for (i, _), r in zip(rows, runs, strict=True)} == want
        names = len(np.unique(S.suffixes(texts[:1]).name)) + len(np.unique(S.suffixes(texts[1:2]).name))
        assert sum(map(len, back.column("data").to_pylist())) < 3 * names * (S.REACH + 18 + S.STRIDE * 36)
        assert all(len(m or b"") <= 12 * names for m in marks.values()) and all(len(r["found"] or b"") <= 8 * names for r in told.values())
        assert held < 60e6, held
