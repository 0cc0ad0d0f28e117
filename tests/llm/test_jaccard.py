from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import jaccard as J
from lodestone.llm.components import components
from lodestone.llm.shingles import shingle_set, words


def brute(rows, k, percent):
    """Set sizes and components by comparing all pairs of plain Python sets."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice((0, 0, 1, 2, 5))):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w + (passage if rnd.random() < 0.3 else []))))
    return rows


@pytest.mark.parametrize("k,percent,block", [(3, 90, 2000), (5, 80, 2000), (3, 80, 7), (2, 70, 5)])
def test_against_brute_force(spark, docs, k, percent, block):
    rows = corpus(150, k * percent)
    got = J.near_duplicates(docs([(i, t, "en", "s") for i, t in rows]), k, percent, block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, percent)


def test_repeated_id_with_near_texts(spark, docs):
    """Each text of an id links with a document that the other one doesn't link with; all lie in one unit."""
    w = [f"w{i}" for i in range(40)]
    new = lambda own, s: own[:s] + [f"n{s + i}" for i in range(3)] + own[s + 3 :]
    a, b = new(w, 37), w
    rows = [(6, a), (6, b), (9, new(b, 0)), (10, a[:36] + ["m"] + a[37:])]
    got = J.near_duplicates(docs([(i, " ".join(t), "en", "s") for i, t in rows]), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(6, 6), (6, 6), (9, 6), (10, 6)]


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "A B"), (6, "x y z"), (6, "x y z"), (None, "x y z"), (7, "long " * 20_000), (8, "long " * 20_001)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs([(i, t, None, None) for i, t in rows]), 3, 90).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (None, 1, None), (7, 1, 7), (8, 1, 7)], key=str)
    assert J.near_duplicates(docs([]), 3, 90).count() == 0
    kept = J.keep_first(docs([(i, t, None, None) for i, t in rows]), 3, 90)
    assert kept.columns[:2] == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, None, 7}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 250), st.integers(0, 40), st.integers(0, 40), st.sampled_from([80, 90, 95]), st.integers(0, 10**6))
def test_keys_lose_no_link(n, gone, new, percent, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([rng.choice(a, max(0, len(a) - gone), replace=False), rng.integers(0, 2**63, new, dtype=np.uint64)]))
    if len(b) and J.linked(a, b, percent) and not np.array_equal(a, b):
        assert len(np.intersect1d(J.partition_keys(a, percent), J.partition_keys(b, percent)))
        assert len(np.intersect1d(J.set_keys(a, percent), J.set_keys(b, percent)))


def test_band_keys_tell_passages_from_copies():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    met = {0.2: 0, 0.9: 0}
    for _ in range(200):
        for share in met:
            common = draw(int(300 * share))
            a, b = (np.unique(np.concatenate([common, draw(300 - len(common))])) for _ in range(2))
            met[share] += len(np.intersect1d(J.band_keys(a, 80), J.band_keys(b, 80))) > 0
    assert met[0.9] == 200 and met[0.2] <= 2


def test_tree_prunes_only_what_cannot_link():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([rng.choice(base[i % 6], 57, replace=False), rng.integers(0, 2**63, i % 5, dtype=np.uint64)])) for i in range(200)]
    for side in (np.full(200, 2), np.arange(200) % 2):
        label = J.join(sets, side, 80)
        same = np.arange(200)
        changed = True
        while changed:
            changed = False
            for i in range(200):
                for j in range(i):
                    if (side[i] == 2 or side[i] != side[j]) and same[i] != same[j] and J.linked(sets[i], sets[j], 80):
                        low, high = min(same[i], same[j]), max(same[i], same[j])
                        same[same == high] = low
                        changed = True
        assert label.tolist() == same.tolist()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 3), (100, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_short_sequences():
    assert len(shingle_set("a b", 3)) == 1 and len(shingle_set(None, 3)) == 0 and len(shingle_set("a b a b a b", 3)) == 2
    assert words("Ab\x0bC\x0cÄ d") == [b"ab", b"c", "Ä".encode(), b"d"]


def test_a_group_of_copies_costs_a_comparison_each(spark, docs, monkeypatch):
    """All of a large group of near copies are tied to a hub, so nothing is left to deal in pairs of blocks."""
    base, dealt = [f"w{i}" for i in range(80)], []
    rows = [(i, " ".join([*base[: i % 70], f"x{i}", *base[i % 70 :]])) for i in range(300)]
    real = J._deal
    monkeypatch.setattr(J, "_deal", lambda members, *bounds: dealt.append(real(members, *bounds)) or dealt[-1])
    got = {r.component_id for r in J.near_duplicates(docs([(i, t, None, None) for i, t in rows]), 3, 80, 20).collect()}
    assert got == {0} and dealt[0].count() == 0


@pytest.mark.parametrize("percent,length", [(80, 40), (90, 70)])
def test_documents_of_different_hubs_are_compared(spark, docs, percent, length):
    """Chains in which each document links with the next only: where two hubs are three apart, those between are tied to
    different hubs and link with each other."""
    rows = []
    for c in range(15):
        own, order = [f"c{c}w{i}" for i in range(length)], list(range(12))
        random.Random(c).shuffle(order)
        for step in range(12):
            rows.append((12 * c + order[step], " ".join([*own])))
            own[2 + 3 * step] = f"c{c}n{step}"
    got = J.near_duplicates(docs([(i, t, "en", "s") for i, t in rows]), 3, percent, 10).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, percent)
    assert {r.component_id for r in got} == {12 * c for c in range(15)}


def test_units_are_bounded_by_shingles(spark, docs):
    rows = corpus(60, 11)
    got = J.near_duplicates(docs([(i, t, "en", "s") for i, t in rows]), 3, 80, 2000, 300).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 80)


def test_recall_of_the_lossy_side(spark):
    """Links of five words and 0.8 on whole documents, of which band keys may lose one in 10 ** 9 right at the threshold: all that brute force finds."""
    from collections import defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: frozenset(shingle_set(r.text, 5).tolist()) for r in docs.collect()}
    holders = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = 0
    for i, own in sets.items():
        shared = defaultdict(int)
        for s in own:
            for j in holders[s]:
                if j > i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                links += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in J.near_duplicates(docs, k=5, percent=80).collect()}
    assert links > 500 and got == {i: root(i) for i in sets}
