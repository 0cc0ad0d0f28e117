"""Spelling variants by forward and backward minimal acyclic automata.

Two words are near if one error (a letter put in, left out or replaced) leads from one to the other. The error lies in the
first or in the second half of a word, so the other half is met exactly: words meet by their first halves in one direction
and by their last halves, read backward, in the other. Where they meet, the words held there make a minimal acyclic
automaton whose edges carry how many words they skip, so a path adds up to a word's number; a word that asks follows its
half letter by letter and is completed with exactly one error. Pairs found in both directions count once.

Halves are dealt by hash into parts of about `BLOCK` words. A half that more words share is split into blocks of words held
times blocks of words that ask, so no automaton and no task grows with one beginning or ending.

Occurrences are taken in the JVM: runs, their hashes and the deleted letter are column expressions.

Defined results: null text has no words; a null doc_id is the empty text in the hash; repeated rows count again; letters
beyond A-Z keep their case; near words of equal count are chosen by code-point order; a word without near words has no
form and is its own root; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

LETTERS, OCCURRENCES, TIMES, EVERY = 6, 5, 5, 199
BLOCK = 40_000
#: Counts grow by `TIMES` from a word to its form, so below 2 ** 63 no chain has more than 27 steps; doublings for those.
DOUBLINGS = 5


def word_counts(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, after the deletions."""
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(rf"([A-Za-zÀ-ÿ]{{{letters},}}+)"), F.lit(1))).alias("run"))
    low = runs.select("id", F.when(run.rlike("[A-Z]"), F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(run).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    word = F.when(h % EVERY == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))).otherwise(run)
    return low.select(word.alias("word")).where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words: `edges[state]` maps a letter to (state, words skipped)."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # the states of the last word's path that may still grow: final, (letter, state) pairs
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, out = path.pop()
                key = (final, tuple(out))
                state = known.get(key)
                if state is None:
                    state = known[key] = self._new(final, out)
                path[-1][1].append((last[len(path) - 1], state))

        for word in words:
            common = 0
            while common < len(last) and common < len(word) and last[common] == word[common]:
                common += 1
            close(common)
            path.extend([False, []] for _ in word[common:])
            path[-1][0], last = True, word
        close(0)
        self.root = self._new(*path[0])

    def _new(self, final: bool, out: list[tuple[str, int]]) -> int:
        skipped, edges = int(final), {}
        for letter, state in out:
            edges[letter] = (state, skipped)
            skipped += self._size[state]
        self.edges.append(edges)
        self.final.append(final)
        self._size.append(skipped)
        return len(self.edges) - 1

    def _rest(self, state: int, number: int, rest: str) -> int:
        """The number of the word that goes on with `rest`, or -1."""
        for letter in rest:
            edge = self.edges[state].get(letter)
            if edge is None:
                return -1
            state, number = edge[0], number + edge[1]
        return number if self.final[state] else -1

    def number(self, word: str) -> int:
        return self._rest(self.root, 0, word)

    def one_error(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with the first `half` letters and go on with exactly one error."""
        state, number, found = self.root, 0, set()
        for at in range(len(word) + 1):
            here = self.edges[state]
            if at >= half:
                if at < len(word):
                    found.add(self._rest(state, number, word[at + 1 :]))
                for letter, (after, skipped) in here.items():
                    found.add(self._rest(after, number + skipped, word[at:]))
                    if at < len(word) and letter != word[at]:
                        found.add(self._rest(after, number + skipped, word[at + 1 :]))
            edge = here.get(word[at]) if at < len(word) else None
            if edge is None:
                break
            state, number = edge[0], number + edge[1]
        found.discard(-1)
        return found


def _meet(table: pa.Table) -> pa.Table:
    """Near pairs of one part: rows that hold make the automaton, the others ask."""
    backward = bool(table.num_rows) and table.column("backward")[0].as_py()
    rows = zip(table.column("word").to_pylist(), table.column("n").to_pylist(), table.column("half").to_pylist(), table.column("asks").to_pylist(), strict=True)
    held, asking = {}, set()
    for word, n, half, asks in rows:
        own = word[::-1] if backward else word
        if asks:
            asking.add((own, half))
        else:
            held[own] = n
    words = sorted(held)
    automaton = Automaton(words)
    found = [(own, words[k]) for own, half in asking for k in automaton.one_error(own, half)]
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    return pa.table({"word": pa.array([turn(u) for u, _ in found], pa.string()), "near": pa.array([turn(v) for _, v in found], pa.string()), "n": pa.array([held[v] for _, v in found], pa.int64())})


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, n of near) of all pairs of `words(word, n)` that are one error apart, in both directions."""
    size = F.char_length("word")

    def halves(backward: bool, sizes: list[Column], asks: bool) -> DataFrame:
        length = [F.floor((s + int(backward)) / 2).cast("int") for s in sizes]
        out = words.select("word", "n", F.explode(F.array_distinct(F.array(*length))).alias("half"))
        text = F.reverse("word") if backward else F.col("word")
        return out.select("word", "n", "half", F.lit(backward).alias("backward"), F.lit(asks).alias("asks"), text.substr(F.lit(1), F.col("half")).alias("key"))

    rows = None
    for backward in (False, True):
        for asks, sizes in ((True, [size]), (False, [size - 1, size, size + 1])):
            some = halves(backward, sizes, asks)
            rows = some if rows is None else rows.union(some)
    count = words.count()
    parts = max(1, -(-2 * count // block))
    hot = rows.groupBy("backward", "key").agg(F.greatest(F.count_if("asks"), F.count_if(~F.col("asks"))).alias("most")).where(F.col("most") > block)
    hot = hot.select("backward", "key", F.ceil(F.col("most") / block).cast("int").alias("blocks"))
    dealt = rows.join(hot, ["backward", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word", F.lit(5)), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.when(F.col("blocks") > 1, F.xxhash64("key")).otherwise(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(parts)))
    dealt = dealt.select(
        "backward", part.alias("part"), F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")).alias("j"),
        "word", "n", "half", "asks",
    )
    return dealt.groupBy("backward", "part", "i", "j").applyInArrow(_meet, "word string, near string, n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms(word, form)`: forms followed to the last, twice as far with each join."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        now = cut(now)
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        if not now.join(on, F.col("root") == F.col("_w"), "left_semi").head(1):
            return now
        now = now.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"))
    return now


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `docs(doc_id, text)`."""
    words = cut(word_counts(docs))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best)
    judged = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    has = F.col("form_n") >= TIMES * F.col("n")
    judged = cut(judged.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")))
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), own AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), coded AS (
  SELECT run, n, hex(encode(id || ':' || run)) AS x FROM own
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM coded, tab
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), gone AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM gone a JOIN gone b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gone g JOIN words w ON g.s = w.word
  UNION SELECT w.word, g.word FROM gone g JOIN words w ON g.s = w.word
), best AS (
  SELECT p.word, p.near, w.n AS form_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS k FROM pairs p JOIN words w ON w.word = p.near
), forms AS (
  SELECT w.word, w.n, CASE WHEN form_n >= 5 * w.n THEN near END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n, coalesce(n_near, 0) AS n_near
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.k = 1
), chain AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms g ON g.word = c.at WHERE g.form IS NULL
"""
