from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import embeddings, topk

ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [None]), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (906, [1.0, 2.0])]


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], "vec_id long, embedding array<float>, keys string, n string")

    return make


def cloud(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dim))
    return [(i, [float(x) for x in (centres[i % len(centres)] + rng.normal(size=dim) * 0.25).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("depth", [256, 8])
def test_topk(frame, depth):
    """Against brute force over rows; small lists leave blocks to the second and third phase."""
    rows = cloud(230, 1) + [(230, [1.0] * 8), (231, [1.0] * 8), (232, [1.0] * 8)]
    rows += [rows[5], (5, [4.0] * 8), rows[40]]
    v = topk.scaled(frame(rows + ODD))
    got = {}
    for r in topk.search(v, v.where("id % 20 = 0"), k=7, slices=3, depth=depth, query_block=5, row_block=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.floor(64 * np.array(x, dtype=np.float64)).astype(int)) for i, x in rows]
    for n, (q, own) in enumerate(good):
        if q % 20 == 0 and n < 230:
            best = sorted((-int(own @ c), i) for m, (i, c) in enumerate(good) if m != n)[:7]
            want = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
            assert sorted(got[q]) == sorted(want * (2 if q == 40 else 1))
    assert topk.every_twentieth(frame([])).count() == 0
    few = topk.every_twentieth(frame([(0, [1.0, 2.0]), (1, [1.0, 0.5]), (2, [-1.0, 3.0])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in few) == [(0, 1, 2, 64 * 64 * 5), (0, 2, 1, 64 * 64 * 2)]


def test_topk_lists_bound_what_they_leave_out():
    """Rows outside the lists score no more than the bound; only list entries are summed up in phase 1."""
    rng = np.random.default_rng(2)
    q, c = rng.integers(-99, 99, (6, 16)), rng.integers(-99, 99, (500, 16))
    parts = topk.partials(q, c, 2)
    at, bound = topk.lists(parts, 40)
    assert at.shape == (6, 80) and (sum(parts) == q @ c.T).all()
    for i in range(6):
        assert sum(parts)[i, np.setdiff1d(np.arange(500), at[i])].max() <= bound[i]


def test_topk_repeated_ids_and_large_integers(frame):
    got = topk.every_twentieth(frame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0])])).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 1, 8192), (2, 1, 4096)]
    big = float(2**23 + 1)
    v = topk.scaled(frame([(0, [big, 1.0])] + [(i, [big, float(i)]) for i in range(1, 40)]))
    got = {r.vec_id: r.score for r in topk.search(v, v.where("id = 0"), k=5, slices=2, depth=5, row_block=10).collect()}
    own = int(big) * 64
    assert got == {i: own * own + 64 * 64 * i for i in range(35, 40)}


@pytest.mark.parametrize("block", [2048, 9])
def test_near_duplicates(frame, block):
    rows = cloud(300, 2, 16) + [(400, [1.0] * 16), (401, [1.0] * 16), (402, [2.0] * 16)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame(rows), block=block).collect()}
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    found, true = sum(r.n_links for r in got.values()), int(link.sum())
    assert 0.98 * true <= found <= true
    ids = [i for i, _ in rows]
    for k, i in enumerate(ids):
        assert got[i].n_links <= link[k].sum() and got[i].kept == (got[i].component_id == i)
    label = np.array(ids)
    while True:
        new = np.array([min([label[k], *label[link[k]]]) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    assert np.mean([got[i].component_id == label[k] for k, i in enumerate(ids)]) > 0.98
    assert got[402].component_id == got[401].component_id == 400 and got[400].n_links == 2


def test_odd_vectors(frame):
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame(ODD + [(7, [1.0, 2.0]), (7, [1.0, 2.0])])).collect()}
    assert {(i, 0, i, True) for i in (900, 901, 902, 903, 904, 905)} <= got
    assert (None, 0, None, False) in got and (906, 2, 7, False) in got and (7, 2, 7, True) in got
    assert embeddings.near_duplicates(frame([])).count() == 0


def test_repeated_ids_are_vectors_of_their_own(frame):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.01]), (3, [0.01, 0.99]), (4, [0.02, 0.98])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(frame(rows)).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_recall_near_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(4000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    ka, kb = embeddings.bucket_keys(a), embeddings.bucket_keys(b)
    assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(ka, kb, strict=True)]) > 0.97
