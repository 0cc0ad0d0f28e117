from __future__ import annotations

import os
import random

import numpy as np
import pytest

from lodestone.llm import pieces as Q

pytestmark = pytest.mark.skipif(not os.path.exists(Q.MODEL), reason="no tokenizer file")


def texts(n, seed):
    rnd = random.Random(seed)
    kinds = (
        lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 120))),
        lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(1, 150))),
        lambda: "".join(rnd.choice("the and ing er on  ") for _ in range(rnd.randrange(1, 150))),
        lambda: " " * rnd.randrange(1, 70) + "x" + " " * rnd.randrange(0, 40),
        lambda: "".join(rnd.choice("中文字éß🙂ab \n\t1234") for _ in range(rnd.randrange(1, 90))),
    )
    return ["".join(rnd.choice(kinds)() for _ in range(rnd.randrange(1, 5))) for _ in range(n)]


def scan(p, text, chunk):
    side, whole, rows, spans = 2 * p.widest, Q.surface(text), [], []
    for lo in range(0, len(whole), chunk):
        hi = min(lo + chunk, len(whole))
        a, b = max(0, lo - 2 * side), min(len(whole), hi + side)
        entries, exits, bits = Q.matrix(p, whole[a:b], lo - a, hi - a, lo == 0, hi == len(whole))
        move = lambda s: None if s is None else (s[0] + a, s[1] + a)  # noqa: B023, E731
        rows.append(([move(s) for s in entries], [move(s) for s in exits], bits))
        spans.append((whole[a:b], lo - a, hi - a, a))
    at = Q.combine(rows)
    back = lambda s, a: None if s is None else (s[0] - a, s[1] - a)
    return np.frombuffer(b"".join(Q.backtrace(p, t, lo, hi, back(s, a), back(e, a)) for (t, lo, hi, a), s, e in zip(spans, at[:-1], at[1:], strict=True)), dtype="<i4").tolist()


def test_scan_is_the_encoding():
    p, rnd = Q.pieces(Q.MODEL), random.Random(1)
    for t in texts(300, 2):
        want = p.sp.encode(t)
        assert np.frombuffer(Q.packed(p, t), dtype="<i4").tolist() == want
        assert scan(p, t, rnd.randrange(17, 150)) == want
        assert Q.decode(p, want) == t == p.sp.decode(want)


def test_spark(spark, docs):
    own = texts(40, 3) + ["", "▁a", "x" * 3000, None]
    frame = docs([(i, t, None, None) for i, t in enumerate(own)] + [(7, own[7], None, None), (None, "a b", None, None)])
    p = Q.pieces(Q.MODEL)
    got = Q.round_trip(frame, chunk=60).collect()
    assert len(got) == len(own) + 2
    for r in got:
        text = own[r.doc_id] if r.doc_id is not None else "a b"
        assert r.ids == (None if text is None else p.sp.encode(text))
        assert r.intact == (None if text is None else True)
    assert Q.round_trip(docs([])).count() == 0
    assert Q.encode(frame, chunk=60).columns == [*frame.columns, "ids"]


def matrices(p, text, chunk):
    side, whole, rows = 2 * p.widest, Q.surface(text), []
    for lo in range(0, len(whole), chunk):
        hi = min(lo + chunk, len(whole))
        a, b = max(0, lo - 2 * side), min(len(whole), hi + side)
        entries, exits, bits = Q.matrix(p, whole[a:b], lo - a, hi - a, lo == 0, hi == len(whole))
        rows.append(([s and (s[0] + a, s[1] + a) for s in entries], [s and (s[0] + a, s[1] + a) for s in exits], bits))
    return rows


def test_product_is_associative():
    """Any grouping of neighbouring matrices gives the same one, entry by entry that of a plain max-plus sum."""
    p, rnd = Q.pieces(Q.MODEL), random.Random(4)
    for t in texts(60, 5):
        rows = matrices(p, t * 2, rnd.randrange(17, 60))
        if len(rows) < 3:
            continue
        a, b, c = rows[:3]
        left, right = Q.product(Q.product(a, b), c), Q.product(a, Q.product(b, c))
        assert left == right
        dense = lambda m: np.array([[0.0 if bits >> i & 1 else -np.inf for bits in m[2]] for i in range(len(m[0]))])
        order = [b[0].index(s) if s in b[0] else None for s in a[1]]
        da, db = dense(a), dense(b)
        want = np.full((len(a[0]), len(b[1])), -np.inf)
        for x, y in enumerate(order):
            if y is not None:
                want = np.maximum(want, da[:, x, None] + db[y][None, :])
        assert (dense(Q.product(a, b)) == want).all()


def test_states_come_down_the_tree(spark, docs, monkeypatch):
    """Documents of many more chunks than a task joins: the scan's ids are the library's, by way of the products."""
    p, seen = Q.pieces(Q.MODEL), []
    own = [t * 20 for t in texts(4, 6)]
    real = Q._known
    monkeypatch.setattr(Q, "_known", lambda m: seen.append(m.groupBy("g").count().agg({"count": "max"}).first()[0]) or real(m))
    got = {r.doc_id: r.ids for r in Q.encode(docs([(i, t, None, None) for i, t in enumerate(own)]), chunk=70).collect()}
    assert seen and seen[0] > Q.FAN**2
    assert all(got[i] == p.sp.encode(t) for i, t in enumerate(own))


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "a b", "x", "y", 5)], "doc_id long, text string, _at string, g string, ids int")
    row = Q.encode(frame, chunk=2).first()
    assert (row._at, row.g, row.ids) == ("x", "y", Q.pieces(Q.MODEL).sp.encode("a b"))
