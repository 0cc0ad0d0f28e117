"""Toxicity by a support vector machine on a subsequence string kernel, with Nystrom landmarks.

The kernel compares strings by their common subsequences of four letters: an occurrence weighs `DECAY` for each letter
that its span is longer than four, up to a span of `SPAN`, so gapped insults and insults with characters put in stay
close to the plain ones; values are over the norms that strings of their lengths have when nothing repeats in them. A
machine on Nystrom features (the kernel against landmark strings, whitened by the landmarks' own kernel) folds exactly
into one weight for each subsequence, so scoring is a table lookup for each subsequence of a text's letters.

Training data are the windows of labelled documents' sentences. Words are folded to plain letters (accents dropped,
look-alike digits and signs read as letters between letters, other signs left out). A window begins with a word, marked
by a sign for its start, and goes on over the words that follow in the sentence until it is full or a word ends; long
words have windows further in; and every second letter of a word gives windows too. So insults with a letter in every gap
or broken by blanks give the plain one's window. A toxic document is represented by its witnesses, windows or beginnings
of words whose documents are toxic beyond chance, the most telling first, until `COVER` of them explain the document;
all windows that begin with a telling beginning are positives, and no negatives. Windows of clean documents are
negatives, and those that the machine likes most go into its next round.

One window that the machine likes proves little where toxic words resemble clean ones, several do; and long texts hold
some by chance. So a text's score is a logistic function of its best window, of its evidence (all windows above `BAR`,
each up to one) and of its length, fitted to documents that the machine behind those numbers has not seen. The fit is
one task's work on a bounded sample: `TOXIC` and `CLEAN` documents of at most `LONGEST` characters each and `BYTES` in all
by class; only the weights reach the driver.

Defined results: null and empty text and text without windows have no evidence and the best window of the
negative limit; without both labels to learn from every score is 0; labels that are null or contradict each other are
not learnt from; of rows that repeat an id the smallest text is learnt from; repeated rows are each scored; empty tables
give no rows; other columns are never read. A text of more than `PART` characters is read in parts that end at blanks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import svm
from lodestone.llm.common import cut, fit_in_task, held_out, lowest_hashes, sampled_texts

ORDER, SPAN, DECAY = 4, 6, 0.6
WIDE = 8
#: Bounds of the training sample: labelled documents of either class, their characters one by one and by class; clean
#: ones whose joined and spread windows are learnt from; landmarks; negatives in all and new ones a round.
TOXIC, CLEAN, LONGEST, BYTES, JOINED, LANDMARKS, NEGATIVES, HARD, ROUNDS = 1200, 1800, 1 << 16, 1 << 24, 600, 960, 5000, 3000, 5
COVER, THRESHOLD, FLOOR = 3, 0.7, -3.0
#: Windows above it are evidence; words of a text of which nothing is told.
BAR, COMMON = 0.5, 100.0
#: Letters, with the sign, of word beginnings that can be witnesses for all windows that begin so.
STEMS = (6, 7)
#: Characters that are scored together, and the most of one text at a time.
PART = 1 << 20

#: Letters beside a to z that are told apart; `{` stands for every other one, `^` for a word's start.
OWN = "äöüßéèçñó"
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + OWN + "^{"
#: One more than there are signs: the last number stands for the place behind a text's end, of which no weight is learnt.
LETTERS = len(ALPHABET) + 1
WIDTH = LETTERS**ORDER
START, BEHIND = ALPHABET.index("^"), LETTERS - 1
#: Signs that are read as letters within a word.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_SENTENCE = re.compile(r"[.!?](?=\s|$)|\n")


@lru_cache(maxsize=1 << 16)
def _plain(ch: str) -> str:
    """A letter of the alphabet for a lower-cased sign, without its accent unless told apart; nothing for a sign that is no letter."""
    if ch in OWN:
        return ch
    base = unicodedata.normalize("NFKD", ch)[:1].lower()
    return base if "a" <= base <= "z" else "{" if ch.isalpha() else ""


@lru_cache(maxsize=1 << 16)
def fold(token: str) -> str:
    """A token as plain letters. Look-alikes count between letters, so `idi0t!` is `idiot`."""
    if token.isascii() and token.isalpha():
        return token.lower()
    low = [ch.lower()[0] for ch in token]
    real = [i for i, ch in enumerate(low) if ch not in LOOKALIKES and _plain(ch)]
    return "".join(LOOKALIKES.get(ch) or _plain(ch) for ch in low[real[0] : real[-1] + 1]) if real else ""


def _further(own: str) -> list[str]:
    """Windows further in a word with its sign, each shared by half with the next."""
    return [own[i : i + WIDE] for i in range(WIDE // 2, len(own) - WIDE // 2, WIDE // 2)]


def windows(token: str) -> list[str]:
    """Windows of WIDE letters of one folded word; the first begins with the sign for its start."""
    own = "^" + token
    return [w for w in (own[:WIDE], *_further(own)) if len(w) >= ORDER]


def stems(token: str) -> list[str]:
    """Beginnings of a word that goes on, with its sign."""
    return ["^" + token[: n - 1] for n in STEMS if len(token) >= n]


def _begins(strings: np.ndarray, witness: np.ndarray) -> np.ndarray:
    """Which packed windows begin with a witness that is as long as a stem and marked by the sign."""
    out = np.zeros(len(strings), dtype=bool)
    for n in STEMS:
        short = witness[(np.char.str_len(witness) == n) & np.char.startswith(witness, b"^")].astype(f"S{n}")
        out |= np.isin(strings.astype(f"S{n}"), short)
    return out


def spread(token: str) -> list[str]:
    """Windows of every second letter, from the first and from the second: a letter put into every gap is left out there."""
    return [w for half in (token[::2], token[1::2]) if len(half) >= ORDER for w in windows(half)]


def joined(words: list[str]) -> Iterator[str]:
    """Windows that begin with a word of the sentence and end with a later one or when full: `id iot of` has those of `idiot` and `idiotof`."""
    for i, word in enumerate(words):
        own, k = "^" + word, i + 1
        while len(own) < WIDE and k < len(words):
            own, k = own + words[k], k + 1
            if len(own) >= ORDER:
                yield own[:WIDE]


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as lists of folded words, by line ends and by `.!?` before blanks."""
    folded = ([f for t in s.split() if (f := fold(t))] for s in _SENTENCE.split(text))
    return [own for own in folded if own]


def windows_of(text: str | None) -> set[str]:
    """All windows of a text, as scoring sees them."""
    return {w for s in sentences(text or "") for ws in (joined(s), *map(windows, s), *map(spread, s)) for w in ws}


_CODES = np.full(256, ALPHABET.index("{"), dtype=np.int64)
for _i, _ch in enumerate(ALPHABET):
    _CODES[ord(_ch)] = _i


@lru_cache(maxsize=64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a string of n letters within the span, and their weights over the string's norm."""
    at = np.array([p for p in combinations(range(n), ORDER) if p[-1] - p[0] < SPAN], dtype=np.int64).reshape(-1, ORDER)
    w = DECAY ** (at[:, -1] - at[:, 0] + 1 - ORDER).astype(np.float64)
    return at, w / np.sqrt(w @ w)


def packed(strings: Iterable[str]) -> np.ndarray:
    """Windows as eight bytes each."""
    return np.array([w.encode("latin-1") for w in strings], dtype=f"S{WIDE}")


def by_length(strings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Packed windows by their length, some thousand at a time: their places, the numbers of their features (windows x
    subsequences), and the subsequences' weights."""
    letters = strings.view(np.uint8).reshape(-1, WIDE)
    size = np.count_nonzero(letters, axis=1)
    for n in range(ORDER, WIDE + 1):
        every = np.flatnonzero(size == n)
        at, w = _places(n)
        for s in range(0, len(every), 5000):
            own = every[s : s + 5000]
            code = _CODES[letters[own, :n]]
            features = code[:, at[:, 0]]
            for k in range(1, ORDER):
                features = features * LETTERS + code[:, at[:, k]]
            yield own, features, w


class Landmarks:
    """Landmark strings, by the features that they have: `row` finds a feature's row in `table` (features x landmarks)."""

    def __init__(self, strings: np.ndarray):
        found = [(i, c, w) for own, codes, w in by_length(strings) for i, c in zip(own, codes, strict=True)]
        every = np.unique(np.concatenate([c for _, c, _ in found]))
        self.features, self.row = every, np.zeros(WIDTH, dtype=np.int32)
        self.row[every] = np.arange(1, len(every) + 1)
        self.table = np.zeros((len(every) + 1, len(strings)), dtype=np.float32)
        for i, c, w in found:
            np.add.at(self.table[:, i], self.row[c], w)

    def kernel(self, strings: np.ndarray) -> np.ndarray:
        """Kernel values of packed windows against the landmarks."""
        out = np.zeros((len(strings), self.table.shape[1]), dtype=np.float32)
        for own, codes, w in by_length(strings):
            for s in range(0, len(own), 200):
                out[own[s : s + 200]] = np.einsum("stl,t->sl", self.table[self.row[codes[s : s + 200]]], w.astype(np.float32))
        return out

    def fold(self, beta: np.ndarray) -> np.ndarray:
        """Weights of all features of the combination `beta` of the landmarks."""
        out = np.zeros(WIDTH, dtype=np.float32)
        out[self.features] = self.table[1:] @ beta
        return out


SPACE, SKIP, LIKE = 255, 254, 100


def _kind(ch: str) -> int:
    """A character's letter, a look-alike's letter and LIKE, SPACE or SKIP."""
    if ch.isspace():
        return SPACE
    low = ch.lower()[0]
    if low in LOOKALIKES:
        return LIKE + ALPHABET.index(LOOKALIKES[low])
    own = _plain(low)
    return ALPHABET.index(own) if own else SKIP


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    return np.array([_kind(chr(c)) for c in range(1 << 16)], dtype=np.uint8)


@dataclass
class Letters:
    """Letters of many texts on end, and their words: first place, length, the place where windows from it must end, and text."""

    codes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    stop: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Letters:
        """As `sentences` reads each of the texts."""
        raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = _kinds()[np.minimum(raw, 0xFFFF)]
        for c in np.unique(raw[raw > 0xFFFF]):
            kind[raw == c] = _kind(chr(c))
        space = kind == SPACE
        begins = ~space
        begins[1:] &= space[:-1]
        word = np.cumsum(begins, dtype=np.int32)
        letter = kind < LIKE
        like = np.flatnonzero((kind >= LIKE) & (kind < SKIP))
        if len(like):  # those between letters of their word
            upto = np.cumsum(letter, dtype=np.int32)
            heads = np.flatnonzero(begins)
            before = np.concatenate([[0], (upto - letter)[heads], upto[-1:]])
            own = word[like]
            like = like[(upto[like] > before[own]) & (upto[like] < before[own + 1])]
            kind[like] -= LIKE
            letter[like] = True
        ends = np.isin(raw, np.frombuffer(".!?".encode("utf-32-le"), dtype=np.uint32))
        ends[:-1] &= space[1:]
        sentence = np.cumsum(ends | (raw == 10), dtype=np.int32)
        at = np.flatnonzero(letter)
        word, codes = word[at], kind[at].astype(np.int64)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(word)), bool), word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(codes)))
        sentence = sentence[at[first]]
        last = np.flatnonzero(np.append(sentence[1:] != sentence[:-1], np.ones(min(1, len(first)), bool)))
        stop = np.repeat((first + size)[last], np.diff(np.append(-1, last)))
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        return cls(codes, first, size, stop, np.searchsorted(starts, at[first], side="right") - 1)

    def halves(self) -> Letters:
        """Every second letter of each word that is long enough, from the first and from the second; no window crosses words here."""
        inside = np.arange(len(self.codes)) - np.repeat(self.first, self.size)
        parts = []
        for odd in (0, 1):
            size = (self.size + 1 - odd) // 2
            long = size >= ORDER
            keep = np.repeat(long, self.size) & (inside % 2 == odd)
            parts.append((self.codes[keep], size[long], self.text[long]))
        codes, size, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        stop = np.cumsum(size)
        return Letters(codes, stop - size, size, stop, text)


@dataclass
class Machine:
    """weights: one for each subsequence; a window's value is their weighted sum plus the bias.

    chance: weights of a text's signs (see `signs`) and their offset, of which its score is the logistic function.
    """

    weights: np.ndarray
    bias: float
    chance: tuple[float, ...] = (1.0, 1.0, -0.3, -1.0)

    def __getstate__(self) -> tuple:
        at = np.flatnonzero(self.weights)
        return at.astype(np.int32), self.weights[at].astype(np.float32), self.bias, self.chance

    def __setstate__(self, state: tuple) -> None:
        at, values, self.bias, self.chance = state
        self.weights = np.zeros(WIDTH, dtype=np.float32)
        self.weights[at] = values

    def values(self, strings: np.ndarray) -> np.ndarray:
        """Values of packed windows."""
        out = np.full(len(strings), FLOOR)
        for own, codes, w in by_length(strings):
            out[own] = np.maximum(FLOOR, self.weights[codes] @ w + self.bias)
        return out

    def best(self, text: str | None) -> float:
        """The value of a whole text's best window."""
        return float(self.bests([text])[0])

    def bests(self, texts: list[str | None]) -> np.ndarray:
        """As `best`."""
        return self.read(texts)[:, 0]

    def read(self, texts: list[str | None]) -> np.ndarray:
        """For each text the value of its best window, its evidence (windows above BAR, each up to one), and its words;
        texts are read together, up to PART characters at a time."""
        out, now, size = np.zeros((len(texts), 3)), [], 0
        out[:, 0] = FLOOR
        for i, text in enumerate(texts):
            for part in _parts(text or ""):
                if size + len(part) > PART:
                    self._together(now, out)
                    now, size = [], 0
                now.append((i, part))
                size += len(part) + 1
        self._together(now, out)
        return out

    def _together(self, parts: list[tuple[int, str]], out: np.ndarray) -> None:
        if not parts:
            return
        own, of = Letters.of([t for _, t in parts]), np.array([i for i, _ in parts])
        if len(own.first):
            np.add.at(out[:, 2], of[own.text], 1.0)
        for letters in (own, own.halves()) if len(own.first) else ():
            value, text = self._words(letters), of[letters.text]
            np.maximum.at(out[:, 0], text, value)
            above = value > BAR
            np.add.at(out[:, 1], text[above], np.minimum(1.0, (value[above] - BAR) / (1 - BAR)))

    def _words(self, x: Letters) -> np.ndarray:
        """For each word the best of the windows that begin in it.

        Sums of weights are taken once for each letter, by the distance d of a subsequence's last letter from its first;
        a window's value adds those that lie in it, letter by letter.
        """
        behind = np.full(WIDE + SPAN, BEHIND, dtype=np.int64)
        codes = np.concatenate([x.codes, behind])
        n = len(codes) - SPAN
        pair = {k: codes[: n + SPAN - k] * LETTERS + codes[k : n + SPAN] for k in range(1, SPAN - 2)}
        gap = lambda d: np.float32(DECAY ** (d + 1 - ORDER))
        by_end = {}
        for d in range(ORDER - 1, SPAN):
            total = np.zeros(n, dtype=np.float32)
            for a, b in combinations(range(1, d), 2):
                total += np.take(self.weights, pair[a][:n] * LETTERS**2 + pair[d - b][b : b + n], mode="clip")
            by_end[d] = total * gap(d)
        marked = {}  # the word's sign and three letters, the last of them d places behind the sign
        for d in range(ORDER - 1, SPAN):
            total = np.zeros(len(x.first), dtype=np.float32)
            for a, b in combinations(range(1, d), 2):
                total += np.take(self.weights, (START * LETTERS + codes[x.first + a - 1]) * LETTERS**2 + pair[d - b][x.first + b - 1], mode="clip")
            marked[d] = total * gap(d)

        def grown(at: np.ndarray, m: int) -> np.ndarray:
            """What the m-th letter from `at` adds."""
            return sum((by_end[d][at + m - 1 - d] for d in by_end if d < m), np.zeros(len(at))).astype(np.float64)

        norm = {m: np.sqrt(float(np.sum(DECAY ** (2.0 * (_places(m)[0][:, -1] - _places(m)[0][:, 0] + 1 - ORDER))))) for m in range(ORDER, WIDE + 1)}
        best, total = np.full(len(x.first), FLOOR), np.zeros(len(x.first))
        ends = np.zeros(len(codes), dtype=bool)
        ends[x.first + x.size - 1] = True
        full = np.minimum(WIDE - 1, x.stop - x.first)
        for m in range(1, WIDE):
            total = total + grown(x.first, m) + marked.get(m, 0.0)
            if m + 1 >= ORDER:
                here = (m <= full) & (m >= np.minimum(x.size, WIDE - 1)) & (ends[x.first + m - 1] | (m == full))
                best = np.where(here, np.maximum(best, total / norm[m + 1] + self.bias), best)
        # windows further in a word
        count = np.maximum(0, -(-(x.size + 1 - WIDE) // (WIDE // 2)))
        word = np.repeat(np.arange(len(x.first)), count)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        at = x.first[word] + (nth + 1) * (WIDE // 2) - 1
        long, total = np.minimum(WIDE, x.first[word] + x.size[word] - at), np.zeros(len(word))
        for m in range(ORDER, WIDE + 1):
            total = total + grown(at, m)
            here = long == m
            np.maximum.at(best, word[here], total[here] / norm[m] + self.bias)
        return best

    def scores(self, best: np.ndarray, evidence: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
        """Scores by what `read` tells; of a best window alone as if it were all the evidence of a text of COMMON words."""
        evidence = np.clip((best - BAR) / (1 - BAR), 0.0, 1.0) if evidence is None else evidence
        z = signs(best, evidence, np.full(len(best), COMMON) if words is None else words) @ np.array(self.chance[:-1]) + self.chance[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def signs(best: np.ndarray, evidence: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a text's score rests on: its best window, and its evidence against its length, for a long text has some by chance."""
    return np.stack([np.clip(best, -1.0, 1.0), np.log1p(evidence), np.log(words + COMMON)], axis=1)


def _parts(text: str) -> Iterator[str]:
    """A text in parts of at most PART characters, cut at blanks where there are any."""
    while len(text) > PART:
        at = max(text.rfind("\n", 0, PART), text.rfind(" ", 0, PART))
        at = at if at > 0 else PART
        yield text[:at]
        text = text[at:]
    yield text


def _train(texts: list[str], toxic: np.ndarray, seed: int = 3) -> Machine | None:
    """A machine of labelled documents; its scores aren't fitted yet."""
    own = [packed({w for t in {t for s in sentences(text) for t in s} for w in (*windows(t), *stems(t))}) for text in texts]
    window, of = np.unique(np.concatenate(own), return_inverse=True)
    if not len(window):
        return None
    of = of.astype(np.int32)
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in own])
    del own
    hot, cold = np.bincount(of[toxic[doc]], minlength=len(window)), np.bincount(of[~toxic[doc]], minlength=len(window))
    share, bar = float(toxic.mean()), np.log(max(2, len(window)))

    def telling(h: int, c: int) -> float:
        """How far a window's documents, h toxic and c clean, are toxic beyond chance; above 0 hardly any window is so by luck."""
        n = h + c
        if not h or h <= n * share:
            return -1.0
        r = h / n
        return n * (r * np.log(r / share) + ((1 - r) * np.log((1 - r) / (1 - share)) if r < 1 else 0.0)) - bar

    # witnesses, the most telling first; a toxic document that has COVER of them tells for no other, as long documents would
    holds: dict[int, set[int]] = {int(w): set() for w in np.flatnonzero(hot > cold * share) if telling(hot[w], cold[w]) > 0}
    for w, i in zip(of[toxic[doc]].tolist(), doc[toxic[doc]].tolist(), strict=True):
        if w in holds:
            holds[w].add(i)
    witness: list[int] = []
    covered: Counter[int] = Counter()
    while holds:
        w = max(holds, key=lambda w: (telling(len(holds[w]), cold[w]) + window[w].startswith(b"^"), window[w]))  # a word's start rather than its end
        docs = holds.pop(w)
        if telling(len(docs), cold[w]) <= 0:
            break
        witness.append(w)
        covered.update(docs)
        done = {i for i in docs if covered[i] == COVER}
        for left in holds.values() if done else ():
            left -= done
    if not witness:
        return None
    begun = _begins(window, window[witness])
    positive = np.flatnonzero(begun & (hot > 0))
    positive = window[sorted({*positive.tolist(), *witness}, key=lambda w: (-hot[w], window[w]))[: NEGATIVES // 2]]
    clean = np.unique(np.concatenate([window[cold > 0], *(packed(windows_of(texts[i])) for i in np.flatnonzero(~toxic)[:JOINED])]))
    clean = np.setdiff1d(clean[~_begins(clean, window[witness])], window[witness], assume_unique=True)
    del window, of, doc, hot, cold, holds
    rng = np.random.default_rng(seed)
    chosen = rng.permutation(len(clean))[:NEGATIVES].tolist()
    machine, hard = None, {}
    for _ in range(ROUNDS):
        pool = clean[chosen]
        marks = np.concatenate([positive[: LANDMARKS // 2], pool[rng.permutation(len(pool))[: LANDMARKS // 8]], pool[-(LANDMARKS * 3 // 8) :]])
        marks = Landmarks(marks[np.sort(np.unique(marks, return_index=True)[1])])
        own = (marks.table[1:].T @ marks.table[1:]).astype(np.float64)
        whiten = np.linalg.inv(np.linalg.cholesky(own + 1e-4 * np.trace(own) / len(own) * np.eye(len(own)))).T.astype(np.float32)
        x = marks.kernel(np.concatenate([positive, pool])) @ whiten
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(pool))])
        cost = np.where(y > 0, len(pool) / (len(positive) * 8.0), 1.0).clip(1.0, 50.0)
        w, b = svm.train_dense(x, y, c=20.0, weight=cost)
        machine = Machine(marks.fold(whiten @ w), b)
        del marks, own, whiten, x
        value = machine.values(clean)
        worst = np.flatnonzero(value > -1.0)
        hard |= dict.fromkeys(worst[np.argsort(value[worst], kind="stable")][-HARD:].tolist())
        chosen = [c for c in chosen if c not in hard][:NEGATIVES] + sorted(hard, key=lambda c: value[c])
    return machine


def fit(texts: list[str], toxic: list[bool]) -> Machine | None:
    """A machine trained on all; the weights of a text's signs come from what a machine of two thirds reads in the others."""
    y = np.array(toxic, dtype=bool)
    if not y.any() or y.all():
        return None
    test = np.arange(len(texts)) % 3 == 0
    part = _train([texts[i] for i in np.flatnonzero(~test)], y[~test]) if y[~test].any() and not y[~test].all() else None
    machine = _train(texts, y)
    if machine is not None and part is not None and y[test].any() and not y[test].all():
        machine.chance = svm.logistic(signs(*part.read([texts[i] for i in np.flatnonzero(test)]).T), y[test])
    return machine


def sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(id, y, text) of labelled documents that are learnt from: the lowest hashes of each class, never of held-out rows.

    Ids are chosen from the labels first; text is read for the chosen ones only.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
        .where("lo = hi").select(F.col("doc_id").alias("i"), (F.col("lo") == 1).alias("y")).where(~held_out(F.col("i")))
    )
    present = cut(known.join(docs.select(F.col("doc_id").alias("i")).distinct(), "i"))
    chosen = lowest_hashes(present, "y", "i", {True: toxic, False: clean}, 13).select(F.col("i").alias("id"), "y")
    return sampled_texts(docs, chosen, "y", LONGEST, BYTES)


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids, so that halves of a sample are alike."""
    return (int(doc_id) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def _fit_rows(rows: list[dict]) -> Machine | None:
    rows = sorted(rows, key=lambda r: (hash_order(r["id"]), r["text"]))
    return fit([r["text"] for r in rows], [r["y"] for r in rows])


def train(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine, fitted by a task: neither texts nor the fit's own tables reach the driver."""
    return fit_in_task(sample(docs, labels), _fit_rows)


def score(spark, text: Column, machine: Machine | None) -> Column:
    """A double column: the toxicity score of a text column."""
    if machine is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            parts = [m.scores(*m.read(batch.slice(s, 500).to_pylist()).T) for s in range(0, len(batch), 500)]
            yield pa.array(np.concatenate([*parts, np.zeros(0)]))
            pa.default_memory_pool().release_unused()

    return scored(text)


def judge(docs: DataFrame, labels: DataFrame | None = None, machine: Machine | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`; trained on `docs` and `labels` unless given a machine."""
    machine = machine or train(docs, labels)
    s = score(docs.sparkSession, F.col("text"), machine)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
