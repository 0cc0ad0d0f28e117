"""Spelling variants and phrases on small tables with odd rows, and the parts that they are made of."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm import phrases, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_error(u: str, v: str) -> bool:
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def variants(rows):
    n: Counter = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= 6 and k >= 5})
    near = {u: [v for v in n if one_error(u, v)] for u in n}
    form = {u: min(vs, key=lambda v: (-n[v], v)) for u, vs in near.items() if vs}
    form = {u: v for u, v in form.items() if n[v] >= 5 * n[u]}

    def root(u):
        return root(form[u]) if u in form else u

    return sorted(((u, form.get(u), root(u), n[u], len(near[u]), n[form[u]] if u in form else None) for u in n), key=str)


@pytest.mark.parametrize("block", [40_000, 4])
def test_variants(docs, block):
    rng = random.Random(block)
    words = ["banana", "Banane", "ananas", "überall", "ÜBERALL", "straße", "aaaaaa", "aaaaaaa", "aaaaaaaa", "strasse", "color×y", "colour"]
    words += ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    text = lambda k: " ".join(w for w in rng.choices(words, [1 + 30 * (i % 7 == 0) for i in range(len(words))], k=k))
    rows = [(i, text(rng.randrange(40)), "en", "s") for i in range(300)] + [(None, text(40), None, None), (7, None, None, None), (8, "", "en", None), (9, "abcdef" * 20_000, "en", "s")]
    rows += [(11, "kitten " * 5, "en", "s")] * 2 + [(12, "mitten " * 60, "en", "s"), (13, "mittens " * 400, "en", "s")]
    assert sorted(map(tuple, spelling.variants(docs(rows), block).collect()), key=str) == variants(rows)
    assert spelling.variants(docs([])).count() == 0


def test_automaton_numbers_words_and_completes():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(400)})
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("zzz") == -1
    assert len(a.edges) < len({w[:k] for w in words for k in range(len(w) + 1)})
    for w in words[:100]:
        half = len(w) // 2
        assert {words[k] for k in a.one_error(w, half)} == {v for v in words if one_error(w, v) and v[:half] == w[:half] and any(c(v) for c in _later(w, half))}
    assert spelling.Automaton([]).one_error("abc", 1) == set()


def _later(w, half):
    """Ways in which a word may differ from `w` behind its half."""
    yield lambda v: len(v) == len(w)
    yield lambda v: any(w[:i] + w[i + 1 :] == v for i in range(half, len(w)))
    yield lambda v: any(v[:i] + v[i + 1 :] == w for i in range(half, len(v)))


def collocations(rows, least, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        within = {p[s : s + k] for p, a in found.items() for k in range(2, len(p)) for s in range(len(p) - k + 1) if a >= own[p[s : s + k]]}
        scored = []
        for p, a in found.items():
            if p not in within:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("dictionary", [1 << 20, 5])
def test_collocations(docs, dictionary):
    rng = random.Random(9)
    words = ["The", "the", "of", "new", "york", "a\x01b", "über", "ÉTÉ", "x|y", "\xa0", "to", "be"]
    piece = lambda: " ".join(rng.choices(words, [2 + i % 5 for i in range(len(words))], k=rng.randrange(9)))
    text = lambda: "".join(piece() + rng.choice([". ", "\n", "\t", "\r", ", ", " ", "!"]) for _ in range(rng.randrange(8)))
    rows = [(i, text(), rng.choice(["en", "de", None, "und"]), "s") for i in range(400)] + [(1, None, "en", None), (None, "the the the the the the", "en", "s"), (3, "", None, None), (4, "one only", "xx", "s")]
    rows += [(5, "to be or not to be, " * 30_000, "en", "s")] + [(6, "same line of text", "fr", "s")] * 50
    got = sorted(map(tuple, phrases.collocations(docs(rows), least=12, dictionary=dictionary).collect()))
    assert got == collocations(rows, 12)
    assert sorted(map(tuple, phrases.collocations(docs(rows), least=12, most=3, dictionary=dictionary).collect())) == collocations(rows, 12, 3)
    assert phrases.collocations(docs([])).count() == 0


def test_slices_end_between_words(monkeypatch):
    text = ("alpha beta\tgamma. " * 40 + "z" * 300 + " end").encode()
    whole = [w for some in phrases.tokens(text) for w in some]
    monkeypatch.setattr(phrases, "SLICE", 7)
    assert [w for some in phrases.tokens(text) for w in some] == whole


def test_scores_beyond_64_bits(spark):
    a, n, l, r = 10**12, 10**14, 10**13 + 1, 10**13 + 7
    e = "CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))"
    assert e in open(phrases.__file__).read()
    assert spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(f"{e} AS s").first().s == 1000 * a * n // (l * r)
