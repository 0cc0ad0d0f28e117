"""Language identification by hierarchical discrimination.

The family of a text is predicted first, by one-versus-rest linear support vector machines; within that family,
one-versus-one machines separate its closely related languages. All of them see the same features, the shares of
hashed byte bigrams and trigrams of the folded text, so scoring a text is one pass: a table row for each n-gram,
summed, divided by the number of n-grams.

Defined results: null text and text without a letter get `und` and score 0; so does every text when there is nothing
to learn from. Empty tables give no rows, repeated rows are each judged, and other columns, whatever their names, are
neither read nor changed by `predict`. A text of any length is read whole, in windows of `WINDOW` bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import svm
from lodestone.llm.common import fit_in_task, held_out, lowest_hashes, sampled_texts

#: The family of each language code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

BITS = 16
SCALE = 40.0
WINDOW = 1 << 20
#: The bounds of the sample that is learnt from: so many labelled texts of each of so many languages (of more languages,
#: fewer each), the characters of a text, and those of all texts, which languages share evenly.
PER_LANGUAGE, LANGUAGES, LONGEST, BYTES = 400, 64, 1 << 16, 1 << 26

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
_LETTERISH = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in _LETTERISH.finditer(text))


def ngram_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the bigrams and trigrams that start at each byte of `data`, both below 2 ** BITS + 2 ** BITS."""
    b = _FOLD[data]
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = ((two[:-1] * np.uint32(2654435761) + b[2:] * np.uint32(2246822519)) >> np.uint32(32 - BITS)) + np.uint32(1 << BITS)
    return two, three


WIDTH = 2 << BITS


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse n-gram shares of a whole text, with a space at either end; they sum to SCALE."""
    data = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", dtype=np.uint8)
    at, n = np.unique(np.concatenate(ngram_codes(data)), return_counts=True)
    return at.astype(np.int32), (n * (SCALE / max(1, n.sum()))).astype(np.float32)


@dataclass
class Model:
    """families: their languages; columns: the machines' targets, ('family', f) or ('pair', a, b); table: a row of weights for each n-gram."""

    families: dict[str, list[str]]
    columns: list[tuple]
    table: np.ndarray
    bias: np.ndarray
    scale: np.ndarray

    def decide(self, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores from each text's mean weights (texts x machines)."""
        z = (sums + self.bias) * self.scale[:, 0] + self.scale[:, 1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        names, n = list(self.families), len(sums)
        if len(names) > 1:
            fam = np.stack([p[:, self.columns.index(("family", f))] for f in names], axis=1) if len(names) > 2 else np.stack([p[:, 0], 1 - p[:, 0]], axis=1)
            fam = fam / fam.sum(axis=1, keepdims=True)
        else:
            fam = np.ones((n, 1))
        best, out, score = fam.argmax(axis=1), np.empty(n, dtype=object), np.zeros(n)
        for k, f in enumerate(names):
            rows, langs = np.flatnonzero(best == k), self.families[f]
            votes, share = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for i, a in enumerate(langs):
                for j in range(i + 1, len(langs)):
                    q = p[rows, self.columns.index(("pair", a, langs[j]))]
                    votes[:, i] += q >= 0.5
                    votes[:, j] += q < 0.5
                    share[:, i] += q
                    share[:, j] += 1 - q
            won = (votes + 1e-3 * share).argmax(axis=1)
            sure = share[np.arange(len(rows)), won] / (len(langs) - 1) if len(langs) > 1 else np.ones(len(rows))
            out[rows] = np.array(langs, dtype=object)[won]
            score[rows] = fam[rows, k] * sure
        return list(out), score


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """A model of labelled texts, or None where there are none."""
    known = sorted(set(langs))
    if not known:
        return None
    families: dict[str, list[str]] = {}
    for code in known:
        families.setdefault(FAMILY_OF.get(code, f"only {code}"), []).append(code)
    rows, y = [features(t) for t in texts], np.array(langs, dtype=object)
    of = np.array([FAMILY_OF.get(code, f"only {code}") for code in langs], dtype=object)
    tasks: list[tuple[tuple, np.ndarray, np.ndarray]] = []
    names = list(families)
    for f in [] if len(names) < 2 else names[:1] if len(names) == 2 else names:
        tasks.append((("family", f), np.arange(len(rows)), of == f))
    for own in families.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                at = np.flatnonzero((y == a) | (y == b))
                tasks.append((("pair", a, b), at, y[at] == a))
    table, bias, scale = np.zeros((WIDTH, max(1, len(tasks))), dtype=np.float32), np.zeros(max(1, len(tasks))), np.ones((max(1, len(tasks)), 2))
    for k, (_, at, positive) in enumerate(tasks):
        chosen = [rows[i] for i in at]
        sign = np.where(positive, 1.0, -1.0)
        fold = np.arange(len(at)) % 2
        margin = np.zeros(len(at))
        for side in (0, 1):  # margins of texts that the machine hasn't seen
            part = np.flatnonzero(fold != side)
            if len(set(sign[part])) == 2:
                w, b = svm.train([chosen[i] for i in part], sign[part], WIDTH)
                for i in np.flatnonzero(fold == side):
                    margin[i] = w[chosen[i][0]] @ chosen[i][1] + b
        w, bias[k] = svm.train(chosen, sign, WIDTH)
        table[:, k] = w * SCALE
        scale[k] = svm.calibrate(margin, positive)
    return Model(families, [t[0] for t in tasks], table, bias, scale)


def _means(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The mean table row of each text's n-grams. Texts are joined up to WINDOW bytes; a longer one is read in windows."""
    out = np.zeros((len(texts), table.shape[1]))
    data = [b" " + t.encode("utf-8", "replace") + b" " for t in texts]
    i = 0
    while i < len(data):
        j, size = i, 0
        while j < len(data) and (j == i or size + len(data[j]) <= WINDOW):
            size += len(data[j])
            j += 1
        joined = np.frombuffer(b"".join(data[i:j]), dtype=np.uint8)
        if j == i + 1 and size > WINDOW:
            total, count = np.zeros(table.shape[1]), 2 * size - 3
            for s in range(0, size, WINDOW):
                two, three = ngram_codes(joined[s : s + WINDOW + 2])
                last = s + WINDOW + 2 >= size
                total += table[two if last else two[:-1]].sum(axis=0, dtype=np.float64) + table[three].sum(axis=0, dtype=np.float64)
                if last:
                    break
            out[i] = total / count
        else:
            two, three = ngram_codes(joined)
            ends = np.cumsum([len(d) for d in data[i:j]])
            starts = ends - [len(d) for d in data[i:j]]
            for codes, short in ((two, 1), (three, 2)):
                bounds = np.stack([starts, np.maximum(ends - short, starts)], axis=1).ravel()
                got = np.add.reduceat(np.concatenate([table[codes], np.zeros((short + 1, table.shape[1]), np.float32)]), bounds, axis=0)[::2]
                out[i:j] += np.where((ends - short > starts)[:, None], got, 0.0)
            out[i:j] /= np.maximum(1, 2 * (ends - starts) - 3)[:, None]
        i = j
    return out


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame | None:
    """(id, lang, text) of the texts that are learnt from: the lowest hashes of each language, never of held-out rows; None of none.

    Ids are chosen from narrow columns first; text is read for the chosen ones only. Every language is learnt; where there
    are more than `languages`, each has fewer texts, eight at least. An id that stands in two languages is left out.
    """
    ids = docs.select(F.col("doc_id").alias("i"), "lang").where("lang is not null and i is not null").where(~held_out(F.col("i")))
    every = [r.lang for r in ids.select("lang").distinct().collect()]
    if not every:
        return None
    most = min(per_language, max(8, per_language * languages // len(every)))
    chosen = lowest_hashes(ids, "lang", "i", dict.fromkeys(every, most), 11)
    chosen = chosen.groupBy(F.col("i").alias("id")).agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other").select("id", "lang")
    return sampled_texts(docs, chosen, "lang", LONGEST, max(LONGEST, BYTES // len(every)))


def _fit_rows(rows: list[dict]) -> Model | None:
    rows = sorted((r for r in rows if has_letter(r["text"])), key=lambda r: (r["id"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model | None:
    """The model, fitted by a task: the driver sees the weights only."""
    rows = sample(docs, per_language, languages)
    return None if rows is None else fit_in_task(rows, _fit_rows)


def predict(spark, text: Column, model: Model | None) -> Column:
    """A struct column (lang_pred, score) for a text column."""
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            texts = batch.to_pylist()
            at = [i for i, t in enumerate(texts) if has_letter(t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if at:
                got, score[at] = m.decide(_means([texts[i] for i in at], m.table))
                for i, x in zip(at, got, strict=True):
                    lang[i] = x
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=["lang_pred", "score"])

    return judged(text)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs`; the model is trained on `docs` unless given."""
    model = model or train(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(docs.sparkSession, F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
