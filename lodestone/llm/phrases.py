"""Phrase collocations by pivot partitioning.

Words are counted by language first; the frequent ones get numbers by falling frequency. A phrase belongs to its pivot,
its rarest word (the leftmost of them). Every occurrence of a frequent word sends the fragment around it that phrases
of that pivot can lie in: up to four words to either side, rewritten to numbers and cut where a piece ends, where a word is
too rare for any phrase, where two neighbours aren't a frequent pair, or where a word is rarer than the pivot, whose own
fragment covers that phrase. Pairs are counted first, by pivot too; a bitmap of fixed size tells the frequent ones, and
where hashes meet there it cuts less than it could, never more. Equal fragments are counted before the exchange, so a line that very many documents share is one fragment a task. Fragments meet by their
pivot; phrases grow there from the pivot to the right and then to the left, each step by one exact count that drops what
isn't frequent, and only phrases of that pivot come out. The rarer a pivot, the fewer its occurrences; the more common,
the fewer words are left in its fragments: so no pivot holds more than a small share.

Numbers of the `DICTIONARY` most frequent words travel in a broadcast, which that bounds; frequent words beyond it are
numbered by a 62-bit hash of language and word, and rarer than all of the dictionary.

Scores are exact: integer division of decimals of 38 digits, enough for products of 10 ** 38 (10 ** 13 words, a phrase
in each of them and a factor of a thousand are 10 ** 29).

Defined results: null text has no words; a null lang is `und`, and so is a lang of that name; repeated rows and rows with
null ids all count; a word that no separator ends goes on to the text's end; phrases never cross pieces or documents; an
empty table gives no rows; other columns are never read. Texts of any length are read in slices that end between words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, mix64

LONGEST, LEAST, MOST = 5, 100, 2000
DICTIONARY = 1 << 20
#: Words of a slice of text, tokens whose fragments are counted together, distinct words that a task counts at a time,
#: occurrences for each part of the exchange.
SLICE, TOGETHER, COUNTED, PART = 1 << 22, 1 << 20, 300_000, 500_000
TAIL = 1 << 62
#: Bits of the bitmap of frequent pairs, and of each of the blocks that make it up.
BITS, BLOCK_BITS = 26, 15
#: A-Z are lowered, `.,;:!?` and line ends end a piece, tabs are blanks.
_READ = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
#: Stands for the end of a piece; no UTF-8 text holds this byte.
BREAK = b"\xff"


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and BREAK between its pieces, some at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            ends = [e for sep in (b" ", b"\n", b"\t", b".", b",") if (e := text.find(sep, end)) >= 0]
            end = min(ends, default=len(text))
        yield text[at:end].translate(_READ).replace(b"\n", b" \xff ").split()
        at = end


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        if text:
            yield lang, text


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            langs = [lang for lang, own in counts.items() for _ in own]
            words = [w for own in counts.values() for w in own]
            return pa.record_batch({"lang": pa.array(langs, pa.string()), "word": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array([n for own in counts.values() for n in own.values()], pa.int64())})

        for batch in batches:
            for lang, text in _texts(batch):
                own = counts.setdefault(lang, Counter())
                for some in tokens(text):
                    own.update(some)
                own.pop(BREAK, None)
                if sum(map(len, counts.values())) > COUNTED:
                    yield rows()
                    counts.clear()
        yield rows()

    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return read.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def tail_number(lang: str, word: bytes) -> int:
    """The number of a word beyond the dictionary."""
    return TAIL | (xxhash.xxh3_64_intdigest(lang.encode() + b"\xff" + word) >> 2)


def numbered(words: DataFrame, least: int, most: int = DICTIONARY) -> tuple[DataFrame, dict[str, dict[bytes, int]], bool]:
    """(lang, word, n, id) of the frequent words, the dictionary by language, and whether words are beyond it.

    The driver gets at most `most` words.
    """
    frequent = words.where(F.col("n") >= least)
    top = frequent.orderBy(F.desc("n"), "lang", "word").limit(most).select("lang", "word").collect()
    book: dict[str, dict[bytes, int]] = {}
    for k, r in enumerate(top):
        book.setdefault(r.lang, {})[r.word.encode()] = k
    beyond = len(top) == most and frequent.count() > most
    shared = words.sparkSession.sparkContext.broadcast(book)

    @F.arrow_udf("long")
    def number(lang: pa.Array, word: pa.Array) -> pa.Array:
        pairs = zip(lang.to_pylist(), word.cast(pa.binary()).to_pylist(), strict=True)
        return pa.array([shared.value.get(x, {}).get(w, None if not beyond else tail_number(x, w)) for x, w in pairs], pa.int64())

    return frequent.withColumn("id", number("lang", "word")), book, beyond


def _fragments(seq: np.ndarray, reach: int) -> np.ndarray:
    """Rows of (pivot, 1st to left, 1st to right, 2nd to left, ...) for numbers with -1 at breaks; -1 where a fragment ends."""
    pad = np.full(reach, -1, dtype=np.int64)
    wide = np.concatenate([pad, seq, pad])
    at = np.flatnonzero(seq >= 0)
    pivot = seq[at]
    left1, right1 = wide[at + reach - 1], wide[at + reach + 1]
    some = ((left1 >= 0) & (left1 < pivot)) | ((right1 >= 0) & (right1 <= pivot))
    at, pivot = at[some], pivot[some]
    rows = np.full((len(at), 1 + 2 * reach), -1, dtype=np.int64)
    rows[:, 0] = pivot
    left = right = np.ones(len(at), dtype=bool)
    for k in range(1, reach + 1):
        before, after = wide[at + reach - k], wide[at + reach + k]
        left = left & (before >= 0) & (before < pivot)
        right = right & (after >= 0) & (after <= pivot)
        rows[left, 2 * k - 1] = before[left]
        rows[right, 2 * k] = after[right]
    return rows


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs. Equal rows lie side by side by a hash and are compared whole."""
    h = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        h = mix64(h ^ rows[:, k].astype(np.uint64)) + np.uint64(k)
    rows = rows[np.argsort(h, kind="stable")]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.diff(np.append(first, len(rows)))


def _pairs(seq: np.ndarray) -> np.ndarray:
    """Rows of neighbouring numbers."""
    both = (seq[:-1] >= 0) & (seq[1:] >= 0)
    return np.stack([seq[:-1][both], seq[1:][both]], axis=1)


def _bit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The place of a pair in the bitmap of frequent ones."""
    return (mix64(mix64(left.astype(np.uint64)) + right.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _broken(seq: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Breaks put between neighbours that aren't a frequent pair."""
    left, right = seq[:-1], seq[1:]
    at = np.flatnonzero((left >= 0) & (right >= 0))
    bit = _bit(left[at], right[at])
    rare = bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 0
    return np.insert(seq, at[rare] + 1, -1)


def _sent(book, beyond: bool, parts: int, kind: str, rows_of: Callable[[np.ndarray], np.ndarray]):
    """Rows of batches of documents, packed by the part of their rarest number: columns of numbers plus one, then counts."""

    def packed(seq: list[np.ndarray]) -> pa.RecordBatch:
        rows, n = _counted(rows_of(np.concatenate([np.zeros(0, np.int64), *seq])))
        part = (mix64(rows.max(axis=1, initial=-1).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((*rows.T[::-1], part))
        rows, n, part = rows[order], n[order], part[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
        ends = [*start[1:], len(part)]
        data = [(rows[i:j] + 1).astype(kind).T.tobytes() + n[i:j].astype("<u4").tobytes() for i, j in zip(start, ends, strict=False)]
        return pa.record_batch({"part": pa.array(part[start], pa.int64()), "data": pa.array(data, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap, seq, size = np.array([-1], dtype=np.int64), [], 0
        for batch in batches:
            for lang, text in _texts(batch):
                own = book.value.get(lang, {})
                for some in tokens(text):
                    ids = [own.get(w, -1) for w in some] if not beyond else [own[w] if w in own else -1 if w == BREAK else tail_number(lang, w) for w in some]
                    seq.append(np.array(ids, dtype=np.int64))
                    size += len(ids)
                seq.append(gap)
                if size > TOGETHER:
                    yield packed(seq)
                    seq, size = [], 0
        yield packed(seq)

    return run


def _received(table: pa.Table, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A part's rows and their counts."""
    each = np.dtype(kind).itemsize * width + 4
    rows, weight = [np.zeros((0, width), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for data in table.column("data").to_pylist():
        n = len(data) // each
        rows.append(np.frombuffer(data, dtype=kind, count=n * width).reshape(width, n).T.astype(np.int64) - 1)
        weight.append(np.frombuffer(data, dtype="<u4", offset=n * (each - 4)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(weight)


def _frequent_pairs(sent: DataFrame, kind: str, least: int) -> np.ndarray:
    """A bitmap of 2 ** BITS bits, set for every pair that is frequent; whatever the corpus, that is all the driver gets."""

    def bits(table: pa.Table) -> pa.Table:
        rows, weight = _received(table, 2, kind)
        known, local = np.unique(rows, return_inverse=True)
        key, of = np.unique(local.reshape(rows.shape) @ np.array([max(1, len(known)), 1]), return_inverse=True)
        some = key[np.bincount(of, weights=weight, minlength=len(key)) >= least]
        bit = np.unique(_bit(known[some // max(1, len(known))], known[some % max(1, len(known))])) if len(some) else np.zeros(0, np.int64)
        return pa.table({"block": pa.array(bit >> BLOCK_BITS, pa.int64()), "bit": pa.array((bit & (1 << BLOCK_BITS) - 1).astype(np.int32), pa.int32())})

    def block(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        own[table.column("bit").to_numpy()] = 1
        return pa.table({"block": table.column("block")[:1], "data": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    found = sent.groupBy("part").applyInArrow(bits, "block long, bit int").distinct().groupBy("block").applyInArrow(block, "block long, data binary")
    out = np.zeros(1 << BITS - 3, dtype=np.uint8)
    for r in found.collect():
        out[r.block << BLOCK_BITS - 3 : r.block + 1 << BLOCK_BITS - 3] = np.frombuffer(r.data, dtype=np.uint8)
    return out


def _grown(rows: np.ndarray, weight: np.ndarray, least: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of numbers, their counts) of the fragments' pivots, for each pair of words to the left and right."""
    known, local = np.unique(rows, return_inverse=True)
    local = local.reshape(rows.shape)
    blank = known == -1

    def step(at: np.ndarray, key: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        word = local[at, column]
        some = ~blank[word]
        at, longer = at[some], key[some] * len(known) + word[some]
        every, first, of = np.unique(longer, return_index=True, return_inverse=True)
        n = np.bincount(of, weights=weight[at], minlength=len(every)).astype(np.int64)
        keep = n >= least
        number = np.cumsum(keep) - 1
        some = keep[of]
        return at[some], number[of[some]], at[first[keep]], n[keep]

    at, key = np.arange(len(rows)), local[:, 0].astype(np.int64)
    for right in range(reach + 1):
        if right:
            at, key, example, n = step(at, key, 2 * right)
            yield rows[example][:, [0, *range(2, 2 * right + 1, 2)]], n
        there, longer = at, key
        for left in range(1, reach + 1 - right):
            there, longer, example, n = step(there, longer, 2 * left - 1)
            yield rows[example][:, [*range(2 * left - 1, 0, -2), 0, *range(2, 2 * right + 1, 2)]], n


def frequent_phrases(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, dictionary: int = DICTIONARY) -> tuple[DataFrame, DataFrame]:
    """(p: numbers of the words, f) of every phrase of 2 to `longest` words that occurs `least` times in its language, and the frequent words' numbers."""
    spark, reach = docs.sparkSession, longest - 1
    ids, book, beyond = numbered(words, least, dictionary)
    size = sum(map(len, book.values()))
    kind = "<i8" if beyond else "<u2" if size < 65535 else "<u4"
    total = ids.agg(F.sum("n")).first()[0] or 0
    parts, shared = int(max(1, -(-total // PART))), spark.sparkContext.broadcast(book)
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    sent = lambda rows_of: read.mapInArrow(_sent(shared, beyond, parts, kind, rows_of), "part long, data binary")
    pairs = spark.sparkContext.broadcast(_frequent_pairs(sent(_pairs), kind, least))

    def mine(table: pa.Table) -> pa.Table:
        found = list(_grown(*_received(table, 1 + 2 * reach, kind), least, reach))
        return pa.table({"p": pa.array([p for ps, _ in found for p in ps.tolist()], pa.list_(pa.int64())), "f": pa.array([n for _, ns in found for n in ns.tolist()], pa.int64())})

    return sent(lambda seq: _fragments(_broken(seq, pairs.value), reach)).groupBy("part").applyInArrow(mine, "p array<long>, f long"), ids


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, dictionary: int = DICTIONARY) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `most` phrases."""
    words = cut(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases, ids = frequent_phrases(docs, words, least, longest, dictionary)
    phrases, ids = cut(phrases), cut(ids)
    every = phrases.union(ids.select(F.array("id").alias("p"), F.col("n").alias("f")))
    # words of a longer phrase that is as frequent: one word less at a time is enough, for counts never grow with words
    parts = F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))
    within = phrases.where(F.size("p") > 2).select(F.explode(parts).alias("q"), F.col("f").alias("g")).groupBy("q").agg(F.max("g").alias("g"))
    left = phrases.join(within, F.col("p") == F.col("q"), "left").where("g is null or 100 * g < 100 * f").select("p", F.col("f").alias("a"))
    cuts = left.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumn("x", F.expr("slice(p, 1, k)")).withColumn("y", F.expr("slice(p, k + 1, size(p) - k)"))
    cuts = cuts.join(every.select(F.col("p").alias("x"), F.col("f").alias("l")), "x").join(every.select(F.col("p").alias("y"), F.col("f").alias("r")), "y")
    named = ids.select(F.col("id").alias("_id"), "lang", "word")
    lang = named.select("_id", "lang").join(totals, "lang")
    cuts = cuts.join(lang, F.col("p")[0] == F.col("_id"))
    score = F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(18,0)))")
    least_cut = cuts.withColumn("score", score).groupBy("p", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    spelled = (
        least_cut.select("p", "a", "lang", "n", "m.score", "m.l", "m.r", F.posexplode("p").alias("at", "_w"))
        .join(named.select(F.col("_id").alias("_w"), "word"), "_w")
        .groupBy("p", "a", "lang", "n", "score", "l", "r")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), totals AS (
  SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS p FROM w, range(1, 6) AS r(k) WHERE len(ws) >= k
), f AS (
  SELECT lang, p, len(p) AS k, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 100
), c AS (
  SELECT a.lang, a.p, a.f AS a, l.f AS l, r.f AS r, n.n, l.k AS cut,
    (1000::HUGEINT * a.f::HUGEINT * n.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM f a JOIN totals n ON n.lang = a.lang
  JOIN f l ON l.lang = a.lang AND l.k < a.k AND l.p = a.p[1:l.k]
  JOIN f r ON r.lang = a.lang AND r.k = a.k - l.k AND r.p = a.p[l.k + 1:a.k]
), least AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), longer AS (
  SELECT b.lang, b.p[s.s:s.s + m.m - 1] AS q, max(b.f) AS g FROM f b, range(2, 5) AS m(m), range(1, 5) AS s(s)
  WHERE m.m < b.k AND s.s + m.m - 1 <= b.k GROUP BY ALL
), kept AS (
  SELECT x.lang, array_to_string(x.p, ' ') AS phrase, a, l, r, n, score
  FROM least x LEFT JOIN longer g ON g.lang = x.lang AND g.q = x.p WHERE g.g IS NULL OR 100 * g.g < 100 * x.a
)
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""
