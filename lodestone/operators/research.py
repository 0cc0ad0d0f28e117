"""Research: citation numbers, contradictions, ordering by relevance, budgets and checkpoints.

WIN-06/11/14/15, AGG-19, JN-03/09/10/14/16, SET-03, PIP-04/05/06, SNK-08, MSC-09, SCA-56, TOP-10.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators.ranks import placed

SHARED_WORDS, TOLERANCE, MIN_FINDINGS = 3, 0.15, 100
#: Claims that a word brings together before it is split.
HOT_WORD = 2000
#: What a snapshot keeps of each part, its room in bytes, and what marks a cut.
SNAPSHOT = {"findings": 8000, "facts": 20, "sources": 50, "citations": 200, "rationale": 2000, "context": 500}
SNAPSHOT_BYTES, SNAPSHOT_PASSES = 2 * 1024 * 1024, 3
CUT_MARK, AGAIN_MARK = "\n[...checkpoint truncated...]", "\n[...aggressively trimmed...]"


def citations(facts: DataFrame) -> DataFrame:
    """WIN-06: (seq, claim, url, number): numbers by the first place of a url's key; blank claims and urls have none."""
    named = facts.where((F.coalesce(F.trim("claim"), F.lit("")) != "") & (F.coalesce(F.trim("url"), F.lit("")) != "")).withColumn("_k", U.branch_key(F.col("url")))
    first = named.groupBy("_k").agg(F.min("seq").alias("_at"))
    number = placed(first, [F.col("_at"), F.col("_k")]).select("_k", (F.col("place") + 1).alias("number"))
    return named.join(number, "_k").select("seq", "claim", "url", "number")


def sources(cited: DataFrame) -> DataFrame:
    """AGG-19: each number's first url and how many claims it carries."""
    return cited.groupBy("number").agg(F.min_by("url", "seq").alias("url"), F.count("*").alias("claims"))


def bibliography(cited: DataFrame) -> DataFrame:
    """MSC-09: one text, a line a source."""
    lines = sources(cited).select("number", F.format_string("[%d] %s", "number", "url").alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("bibliography"))


def cite(text: DataFrame, cited: DataFrame) -> DataFrame:
    """JN-03: `[n](url)` for known urls, `[?](url)` for others."""
    known = cited.groupBy(U.branch_key(F.col("url")).alias("_k")).agg(F.min("number").alias("_n"))
    met = text.withColumn("_k", U.branch_key(F.col("url"))).join(known, "_k", "left")
    return met.withColumn("mark", F.concat(F.lit("["), F.coalesce(F.col("_n").cast("string"), F.lit("?")), F.lit("]("), F.col("url"), F.lit(")"))).drop("_k", "_n")


def annotated(text: Column, claims: Column, least: int = 30) -> Column:
    """JN-14: the text with `[n]` behind the first place of each claim in turn: `claims` is an array of (claim, numbers).

    Claims shorter than `least`, ones without numbers and ones that marks follow already add nothing.
    """

    def step(t: Column, c: Column) -> Column:
        claim, numbers = c["claim"], F.array_sort(F.array_distinct(F.filter(c["numbers"], lambda n: n > 0)))
        at = F.position(claim, t)
        end = at + F.length(claim)
        marks = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
        new = (F.length(claim) >= least) & (at > 0) & (marks != "") & ~F.substring(t, end, F.lit(20)).rlike(r"^(\s*\[\d+\])+")
        return F.when(new, F.concat(F.substring(t, F.lit(1), end - 1), marks, F.substring(t, end, F.length(t)))).otherwise(t)

    return F.aggregate(F.coalesce(claims, F.array().cast("array<struct<claim:string,numbers:array<bigint>>>")), text, step)


def _plain_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"/+$", ""))


def citation_map(cited: DataFrame, messages: DataFrame, listed: DataFrame) -> DataFrame:
    """JN-16: (run, number, url, title): what a mark points to, for each run.

    Numbers of the tracker `cited(run, number, url)` come first; then addresses that tool messages (run, seq, role, text) say
    were read in full, in order, each once and with the next numbers; last the model's own list (run, number, url, title),
    for numbers that nothing has yet.
    """
    tracked = cited.groupBy("run", "number").agg(F.min("url").alias("url")).select("run", F.col("number").cast("long").alias("number"), "url", F.lit("").alias("title"), F.lit(0).alias("source"))
    read = F.regexp_extract_all("text", F.lit(r"\[Full text (?:scraped|extracted|fetched) from\s+(https?://[^\]]+)\]"), F.lit(1))
    found = messages.where("role = 'tool'").select("run", "seq", F.posexplode(read).alias("pos", "url")).withColumn("key", _plain_key(F.col("url")))
    first = found.groupBy("run", "key").agg(F.min(F.struct("seq", "pos", "url")).alias("f")).join(tracked.select("run", _plain_key(F.col("url")).alias("key")).distinct(), ["run", "key"], "left_anti")
    held = tracked.groupBy("run").agg(F.count("*").alias("held"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("f.seq", "f.pos"))
    scraped = first.withColumn("place", place).join(held, "run", "left").select("run", (F.coalesce("held", F.lit(0)) + F.col("place")).cast("long").alias("number"), "f.url", F.lit("").alias("title"), F.lit(1).alias("source"))
    own = listed.select("run", F.col("number").cast("long").alias("number"), "url", F.coalesce("title", F.lit("")).alias("title"), F.lit(2).alias("source"))
    every = tracked.unionByName(scraped).unionByName(own)
    return every.groupBy("run", "number").agg(F.min(F.struct("source", "url", "title")).alias("m")).select("run", "number", "m.url", "m.title")


def sandwich(ranked: DataFrame, score: str = "score") -> DataFrame:
    """WIN-11: the best first, the second last, and so inwards: `position` from 0."""
    out = placed(ranked, [F.desc(score), F.col("id")], "_r")
    n = out.agg(F.count("*").alias("_n"))  # one row
    return out.crossJoin(F.broadcast(n)).withColumn("position", F.when(F.col("_r") % 2 == 0, F.col("_r") / 2).otherwise(F.col("_n") - 1 - (F.col("_r") - 1) / 2).cast("long")).drop("_r", "_n")


def scaled_budgets(branches: DataFrame, budget: int) -> DataFrame:
    """WIN-14: characters for each branch in proportion to its findings and facts, two thousand at least."""
    want = F.length("findings") + 100 * F.col("n_facts")
    total = branches.agg(F.sum(want).alias("_all"))  # one row
    scale = F.least(F.lit(1.0), F.lit(float(budget)) / F.col("_all"))
    return branches.crossJoin(F.broadcast(total)).withColumn("chars", F.greatest(F.lit(2000), F.floor(want * scale)).cast("long")).drop("_all")


def kept_facts(facts: DataFrame, share: float = 0.4) -> DataFrame:
    """WIN-15: facts of a branch in order while their characters fit in its share; the first three always."""
    upto = Window.partitionBy("branch").orderBy("seq")
    return facts.withColumn("_c", F.sum(F.length("claim")).over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.row_number().over(upto)).where((F.col("_r") <= 3) | (F.col("_c") <= F.col("chars") * share)).drop("_c", "_r")


def overlapping(sets: DataFrame, least: int = SHARED_WORDS, hot: int = HOT_WORD) -> DataFrame:
    """JN-09: (i, j, shared): pairs i < j of `sets(seq, w)`, arrays without repeats, that share `least` words or more.

    Two sets that share that many share one of each other's rarest words: of n words the n - `least` + 1 rarest are enough.
    So sets meet by those only, a word of all sets brings hardly any together, and the shared words of a pair that meets are
    counted in full. Words that more than `hot` sets still meet by are split: one side's rows to one of several salts, the other's to all.
    """
    word = sets.select("seq", F.explode("w").alias("word"))
    often = word.groupBy("word").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("seq").orderBy("df", "word"))
    rare = word.join(often, "word").withColumn("r", rank).withColumn("n", F.count("*").over(Window.partitionBy("seq"))).where(F.col("r") <= F.col("n") - least + 1)
    salts = F.ceil(F.col("df") / hot).cast("int")
    left = rare.select("word", F.col("seq").alias("i"), F.pmod(F.xxhash64("seq"), salts).cast("int").alias("salt"))
    right = rare.select("word", F.col("seq").alias("j"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = left.join(right, ["word", "salt"]).where("i < j").select("i", "j").distinct()
    own = lambda name: sets.select(F.col("seq").alias(name), F.col("w").alias(f"w_{name}"))
    counted = met.join(own("i"), "i").join(own("j"), "j").withColumn("shared", F.size(F.array_intersect("w_i", "w_j")).cast("long"))
    return counted.where(F.col("shared") >= least).select("i", "j", "shared")


def contradiction_pairs(facts: DataFrame) -> DataFrame:
    """JN-09/10, the pairwise form: claims of different sources that share three words or more and numbers that diverge.

    Claims without a number can't contradict and never meet.
    """
    f = facts.select("seq", "url", T.keyword_set(F.col("claim")).alias("w"), T.numbers(F.col("claim")).alias("x")).where(F.size("x") > 0)
    near = overlapping(f.select("seq", "w"))
    n = f.select("seq", "url", F.explode("x").alias("x"))
    left, right = n.select(F.col("seq").alias("i"), F.col("url").alias("url_a"), F.col("x").alias("a")), n.select(F.col("seq").alias("j"), F.col("url").alias("url_b"), F.col("x").alias("b"))
    met = near.join(left, "i").join(right, "j").where("url_a <> url_b")
    return met.withColumn("divergence", (F.greatest("a", "b") - F.least("a", "b")) / F.greatest("a", "b")).where(F.col("divergence") > TOLERANCE).select("i", "j", "shared", "a", "b", "divergence")


def contradictions_greedy(facts: DataFrame, run: str = "run") -> DataFrame:
    """PIP-04: clusters around seeds in order, each claim in the first cluster whose seed it shares three words with.

    The assignment depends on its order, so one research run is a fold of its own; a run has tens of claims.
    """
    prepared = facts.select(run, "seq", "url", T.keyword_set(F.col("claim")).alias("w"), T.numbers(F.col("claim")).alias("x"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("seq").to_dict("records")
        free, out = [set(r["w"]) for r in rows], []
        taken = [False] * len(rows)
        for i, seed in enumerate(free):
            if taken[i] or len(seed) < 2:
                continue
            own = [i] + [j for j in range(i + 1, len(rows)) if not taken[j] and len(seed & free[j]) >= SHARED_WORDS]
            for j in own:
                taken[j] = True
            said = [(rows[j], x) for j in own for x in rows[j]["x"]]
            for k, (a, x) in enumerate(said):
                for b, y in said[k + 1 :]:
                    if a["url"] != b["url"] and (max(x, y) - min(x, y)) / max(x, y) > TOLERANCE:
                        out.append({run: a[run], "i": a["seq"], "j": b["seq"], "a": x, "b": y})
        return pd.DataFrame(out, columns=[run, "i", "j", "a", "b"])

    kind = dict(facts.dtypes)
    return prepared.groupBy(run).applyInPandas(fold, f"{run} {kind[run]}, i {kind['seq']}, j {kind['seq']}, a double, b double")


def checkpoint(branches: DataFrame, findings: int = 8000, facts: int = 20, links: int = 50) -> DataFrame:
    """SNK-08: branches trimmed for a snapshot."""
    return branches.select("branch", F.substring("findings", 1, findings).alias("findings"), F.slice("facts", 1, facts).alias("facts"), F.slice("sources", 1, links).alias("sources"))


def snapshot(branches: Column, citations: Column, rationale: Column, context: Column, most: int = SNAPSHOT_BYTES) -> Column:
    """SNK-08: (level, bytes, json) of a run's state in as many halvings as its room asks for, three at most.

    branches: array of (topic, findings, facts, sources); citations: array. Each level halves the findings, the facts (four at least)
    and the citations (ten at least) of the one before and keeps ten sources; the last drops context and rationale. Levels
    follow each other, and the first that fits is taken, else the last.
    """
    text = lambda x, n: F.substring(F.coalesce(x, F.lit("")), F.lit(1), n)
    some = lambda x, n: F.slice(F.coalesce(x, F.array().cast("array<string>")), F.lit(1), n)
    half = lambda x, least: F.greatest(F.lit(least), F.floor(F.size(x) / 2).cast("int"))
    none = F.array().cast("array<struct<topic:string,findings:string,facts:array<string>,sources:array<string>>>")

    def branch(topic: Column, findings: Column, facts: Column, sources: Column) -> Column:
        return F.struct(topic.alias("topic"), findings.alias("findings"), facts.alias("facts"), sources.alias("sources"))

    def first(b: Column) -> Column:
        full = F.coalesce(b["findings"], F.lit(""))
        cut = F.when(F.length(full) > SNAPSHOT["findings"], F.concat(text(full, F.lit(SNAPSHOT["findings"])), F.lit(CUT_MARK))).otherwise(full)
        return branch(F.coalesce(b["topic"], F.lit("")), cut, some(b["facts"], F.lit(SNAPSHOT["facts"])), some(b["sources"], F.lit(SNAPSHOT["sources"])))

    def less(b: Column, mark: str) -> Column:
        cut = F.concat(text(b["findings"], F.floor(F.length(b["findings"]) / 2).cast("int")), F.lit(mark))
        return branch(b["topic"], cut, F.slice(b["facts"], F.lit(1), half(b["facts"], 4)), F.slice(b["sources"], 1, 10))

    def state(bs: Column, cs: Column, why: Column, around: Column, level: int) -> Column:
        body = F.struct(bs.alias("branches"), cs.alias("citations"), why.alias("rationale"), around.alias("context"))
        return F.struct(F.lit(level).alias("level"), body.alias("body"), F.octet_length(F.to_json(body)).alias("bytes"))

    start = state(F.transform(F.coalesce(branches, none), first), some(citations, F.lit(SNAPSHOT["citations"])), text(rationale, F.lit(SNAPSHOT["rationale"])), text(context, F.lit(SNAPSHOT["context"])), 0)

    def step(now: Column, level: Column) -> Column:
        b = now["body"]

        def at(n: int) -> Column:
            gone = F.lit("") if n == SNAPSHOT_PASSES else None
            return state(F.transform(b["branches"], lambda x: less(x, AGAIN_MARK if n == 1 else "")), F.slice(b["citations"], F.lit(1), half(b["citations"], 10)), b["rationale"] if gone is None else gone, b["context"] if gone is None else gone, n)

        out = now
        for n in range(SNAPSHOT_PASSES, 0, -1):
            out = F.when((level == n) & (now["bytes"] > most), at(n)).otherwise(out)
        return out

    made = F.aggregate(F.sequence(F.lit(1), F.lit(SNAPSHOT_PASSES)), start, step)
    return T.bound(made, lambda x: F.struct(x["level"].alias("level"), x["bytes"].alias("bytes"), F.to_json(x["body"]).alias("json")))


def totals(branches: DataFrame, by: str = "branch") -> DataFrame:
    """AGG-20: pages and facts of each branch's steps (branch, pages, facts), missing ones as none."""
    return branches.groupBy(by).agg(F.sum(F.coalesce("pages", F.lit(0))).cast("long").alias("pages"), F.sum(F.coalesce("facts", F.lit(0))).cast("long").alias("facts"))


def usable(branches: DataFrame, least: int = MIN_FINDINGS) -> DataFrame:
    """FLT-05: branches whose findings are longer than `least`."""
    return branches.where(F.length("findings") > least)
