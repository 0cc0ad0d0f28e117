"""Language and toxicity: held-out accuracy on the driver's tables, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import language, toxicity
from lodestone.session import table


def test_language_held_out(spark, sf_dir):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, docs):
    known = [(i, ["the man and the thing of it", "der Mann und die Sache über es", "le garçon et la chose où"][i % 3] + f" {i}", ["en", "de", "fr"][i % 3], None) for i in range(60)]
    odd = [(1000, None, "en", None), (1001, "", None, None), (1002, "123 !?", "de", None), (None, "the thing and the man", None, None), (1003, "und die Sache " * 120_000, None, None), (3, known[3][1], "en", None)]
    got = {r.doc_id: r for r in language.identify(docs(known + odd)).collect()}
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and all(got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "de" and got[None].lang_pred == "en"
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in known]) > 0.95
    assert {r.lang_pred for r in language.identify(docs(odd[:3])).collect()} == {"und"}
    assert language.identify(docs([])).count() == 0


def test_language_windows_agree():
    text = "der die das und über " * 4000
    table_ = np.random.default_rng(0).normal(size=(language.WIDTH, 2)).astype(np.float32)
    whole = language._means([text], table_)
    old, language.WINDOW = language.WINDOW, 1000
    try:
        assert np.allclose(language._means([text], table_), whole, atol=1e-4)
    finally:
        language.WINDOW = old


def test_every_language_is_learnt(spark, docs):
    words = [a + b for a in "bdfgklmn" for b in "aeiouyäöü"][: language.LANGUAGES + 3]
    rows = [(0, f"{w}{w} {w} " * (3 + i), f"x{k:02d}", None) for k, w in enumerate(words) for i in range(12 if k < 3 else 4)]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    learnt = language.sample(docs(rows)).collect()
    langs = [r.lang for r in learnt]
    got = language.fit([r.text for r in learnt], langs)
    assert len(set(langs)) > language.LANGUAGES and {c for own in got.families.values() for c in own} == set(langs)
    said = {r.doc_id: r.lang_pred for r in language.identify(docs(rows), got).collect()}
    assert np.mean([said[r[0]] == r[2] for r in rows if r[2] in set(langs)]) > 0.95


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(1)
    syllables = ["ka", "to", "mi", "ren", "sol", "vu", "par", "ne", "li", "dor"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, toxic = [], []
    for i in range(500):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w[rng.integers(60)] = ["idiot", "moron", "scumbag"][rng.integers(3)]
        texts.append(" ".join(w).capitalize() + ".")
        toxic.append(i % 4 == 0)
    return toxicity.fit(texts, toxic), texts, toxic


def test_toxicity_learns_and_tolerates(machine):
    m, texts, toxic = machine
    score = m.scores(m.bests(texts))
    assert np.mean((score >= 0.7) == np.array(toxic)) > 0.98
    for insult in ("you idiot", "i.d.i.o.t", "i d i o t", "IDI0T!", "mor-on", "m o r o n", "scum_bag"):
        assert m.scores(m.bests([f"kato mi {insult} sol"]))[0] >= 0.7, insult
    for clean in ("kato miren soldor", "", None, "123 ---"):
        assert m.scores(m.bests([clean]))[0] < 0.5
    for gapped in ("idiiot", "moroon", "scuumbag"):
        assert m.best(gapped) > m.best("soldorka")


def test_toxicity_finds_inserted_letters_and_blanks(machine):
    m, texts, _ = machine
    for insult in ("ixdxixoxt", "mzozrzozn", "sxcxuxmxbxaxg", "xixdxixoxt", "id iot", "mor on", "scum bag", "sc um bag", "ID iot!"):
        assert m.scores(m.bests([f"kato mi {insult} sol"]))[0] >= 0.7, insult
    for clean in ("kato mi soldor vu", "ka to mi ren sol", "kxaxtxoxmxi"):
        assert m.scores(m.bests([clean]))[0] < 0.5, clean


def test_toxicity_held_out(spark):
    """Documents that nothing was learnt from, in each language; some labelled ones of sf0.1 hold no toxic word any more."""
    d, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.judge(d.join(labels, "doc_id", "left_semi"), labels).join(labels, "doc_id").join(d.select("doc_id", "lang"), "doc_id").where("held_out and toxic is not null").collect()
    said, toxic = np.array([r.predicted for r in got]), np.array([r.toxic for r in got])
    assert said[toxic == 1].mean() >= 0.9 and toxic[said == 1].mean() >= 0.95 and said[toxic == 0].mean() <= 0.01
    for lang in {r.lang for r in got}:
        own = np.array([r.lang == lang for r in got])
        assert said[own & (toxic == 1)].mean() >= 0.85 and toxic[own & (said == 1)].mean() >= 0.85, lang


def test_toxicity_evidence_adds_up():
    m = toxicity.Machine(np.random.default_rng(6).normal(size=toxicity.WIDTH).astype(np.float32), 0.1)
    one, many = m.read(["kato idiot mi sol.", "kato idiot mi sol.\n" * 5])
    assert np.isclose(many[1], 5 * one[1], atol=1e-3) and many[2] == 5 * one[2] and np.isclose(one[0], many[0], atol=1e-5)


def test_toxicity_edges(spark, docs):
    frame = docs([(1, None, None, None), (2, "", None, None), (None, "x", None, None), (2, "y", None, None)])
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.judge(frame, labels).collect()
    assert len(got) == 4 and all(r.score == 0.0 and r.predicted == 0 for r in got)
    assert toxicity.judge(docs([]), labels).count() == 0


def test_machine_is_its_kernel(machine):
    """The folded weights give the same values as the kernel against the landmarks."""
    marks = toxicity.Landmarks(toxicity.packed(["^idiot", "^katomi", "idiot", "^soldor"]))
    beta = np.array([1.0, -0.5, 0.25, -2.0])
    strings = toxicity.packed(["^idiotka", "^kato", "dorsol", "^id1"[:3] + "xy"])
    direct = marks.kernel(strings) @ beta
    folded = toxicity.Machine(marks.fold(beta), 0.0).values(strings)
    assert np.allclose(direct, folded, atol=1e-5)


def test_kernel_is_the_subsequence_kernel():
    """Kernel values against a plain sum over pairs of subsequences, over the norms of strings without repeats."""
    from itertools import combinations

    def features(s):
        out = {}
        for at in combinations(range(len(s)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                u = "".join(s[i] for i in at)
                out[u] = out.get(u, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER)
        return out

    dot = lambda a, b: sum(w * b.get(u, 0.0) for u, w in a.items())
    norm = lambda s: dot(features("abcdefgh"[: len(s)]), features("abcdefgh"[: len(s)])) ** 0.5
    marks, strings = ["^idiot", "^katomi", "idiotkat", "^aaaa"], ["^idiotka", "^kato", "dorsol", "^idxiot", "aaaaaaaa"]
    want = [[dot(features(s), features(m)) / norm(s) / norm(m) for m in marks] for s in strings]
    assert np.allclose(toxicity.Landmarks(toxicity.packed(marks)).kernel(toxicity.packed(strings)), want, atol=1e-5)


def test_toxicity_scores_every_window():
    """Texts read together score as each window of each sentence does by itself."""
    rng = np.random.default_rng(5)
    m = toxicity.Machine(rng.normal(size=toxicity.WIDTH).astype(np.float32), -0.2)
    m.weights[[c for c in range(toxicity.WIDTH) if toxicity.BEHIND in (c % toxicity.LETTERS, c // toxicity.LETTERS % toxicity.LETTERS, c // toxicity.LETTERS**2 % toxicity.LETTERS)]] = 0
    signs = list("abcdeiotsé  ..!?\n1043@$,-ß ÄЖ　𝐢İ")
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(400)] + ["", None, "i d i o t", "worthlessworthless you.", "x" * 40]
    got = m.bests(texts)
    for text, value in zip(texts, got, strict=True):
        own = toxicity.packed(toxicity.windows_of(text))
        assert np.isclose(value, max(m.values(own), default=toxicity.FLOOR), atol=1e-4), text
    assert np.allclose([m.best(t) for t in texts], got)


def test_toxicity_long_text():
    m = toxicity.Machine(np.random.default_rng(5).normal(size=toxicity.WIDTH).astype(np.float32), -0.2)
    old, toxicity.PART = toxicity.PART, 500
    try:
        parts = m.best("kato idiot mi sol. " * 3000)
    finally:
        toxicity.PART = old
    assert np.isclose(parts, m.best("kato idiot mi sol. " * 3000))
