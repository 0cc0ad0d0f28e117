"""Order-dependent folds over one conversation, run or request, and small keyed stores.

WIN-09/13/16, STR-12, DML-10/11, UDF-01/02, FLT-20, MSC-06. A fold sees one natural key's rows; keyed stores are unions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import pricing as P

#: Request states; those that a request works in, and those that it has come to rest in.
STATES = ("idle", "enriching", "awaiting-model", "tool-loop", "synthesis", "stopping", "done", "error")
PHASES, SETTLED = ("enriching", "awaiting-model", "tool-loop", "synthesis"), ("idle", "done", "error")
#: Last iteration of a tier, search results, characters of a snippet, of a page read, of a page crawled and of knowledge.
CHAT_TIERS = ((2, 10, 500, 16_000, 32_000, 8_000), (4, 8, 400, 8_000, 16_000, 5_000), (6, 6, 300, 4_000, 8_000, 3_000), (None, 4, 200, 2_000, 4_000, 2_000))
RESEARCH_TIERS = ((3, 15, 500, 16_000, 32_000, 10_000), (5, 12, 450, 10_000, 20_000, 8_000), (8, 10, 350, 6_000, 12_000, 5_000), (None, 6, 250, 4_000, 8_000, 3_000))
LINKS_MARK = "--- Links on this page"


def greedy_spans(messages: DataFrame, budget: int) -> DataFrame:
    """WIN-09: the kept turns: leading system turns, the last span, then the newest spans that fit, larger ones skipped.

    A span is a user turn and what follows it, so tool calls and their results stay together.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("turn").to_dict("records")
        lead = 0
        while lead < len(rows) and rows[lead]["role"] == "system":
            lead += 1
        spans: list[list[dict]] = []
        for r in rows[lead:]:
            if r["role"] == "user" or not spans:
                spans.append([])
            spans[-1].append(r)
        left = budget - sum(int(r["tokens"]) for r in rows[:lead])
        kept = list(rows[:lead])
        for k, span in enumerate(reversed(spans)):
            cost = sum(int(r["tokens"]) for r in span)
            if k == 0 or cost <= left:
                kept += span
                left -= cost
        return pd.DataFrame([(r["conv_id"], r["turn"], r["role"]) for r in kept], columns=["conv_id", "turn", "role"])

    return messages.select("conv_id", "turn", "role", "tokens").groupBy("conv_id").applyInPandas(fold, "conv_id long, turn long, role string")


def tier(iteration: Column, tiers: tuple = CHAT_TIERS) -> Column:
    """WIN-16: the limits of the first tier that holds at an iteration: results, snippet, read, crawl and knowledge."""
    limits = lambda t: F.struct(*(F.lit(v).alias(n) for n, v in zip(("results", "snippet", "read", "crawl", "knowledge"), t[1:], strict=True)))
    out = limits(tiers[-1])
    for t in reversed(tiers[:-1]):
        out = F.when(iteration <= t[0], limits(t)).otherwise(out)
    return out


def truncated(text: Column, tool: Column, iteration: Column, tiers: tuple = CHAT_TIERS) -> Column:
    """WIN-16: a tool's result as an iteration keeps it.

    Pages and knowledge are cut to the tier's characters with a note; a page's list of links stays whole behind it. Of
    searches the first results are kept, their lines cut. Other tools' results stay as they are.
    """
    t = tier(iteration, tiers)
    end = lambda x: F.regexp_replace(x, r"\s+$", "")
    note = F.concat(F.lit("[Content trimmed at iteration "), iteration.cast("string"), F.lit(" to manage context — re-read this page later if you need the rest.]"))
    most = F.when(tool == "read_url", t["read"]).when(tool.isin("crawl_url", "explore_docs"), t["crawl"]).otherwise(t["knowledge"])
    mark = F.locate(LINKS_MARK, text)
    head, tail = F.when(mark > 0, end(F.substring(text, F.lit(1), mark - 1))), F.when(mark > 0, F.substring(text, mark, F.length(text)))
    kept = F.greatest(F.lit(200), most - F.length(tail) - F.length(note) - 4)
    page = F.when((tool != "knowledge_search") & (mark > 0), F.concat_ws("\n\n", end(F.substring(head, F.lit(1), kept)), note, tail)).otherwise(F.concat_ws("\n\n", end(F.substring(text, F.lit(1), most)), note))
    lines = F.split(text, "\n")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        head_line = line.rlike(r"^[0-9]+\.\s")
        n = acc["n"] + head_line.cast("int")
        short = F.when(~head_line & (n > 0) & line.startswith("   ") & (F.length(line) > t["snippet"] + 3), F.concat(end(F.substring(line, F.lit(1), t["snippet"])), F.lit("…"))).otherwise(line)
        done = acc["n"] > t["results"]  # nothing behind the first result too many is read
        return F.struct(F.when(done, acc["n"]).otherwise(n).alias("n"), F.when(done | (n > t["results"]), acc["out"]).otherwise(F.concat(acc["out"], F.array(short))).alias("out"))

    read = F.aggregate(lines, start, step)
    left = F.concat(F.lit("\n["), (read["n"] - t["results"]).cast("string"), F.lit(" more results trimmed — iteration "), iteration.cast("string"), F.lit(".]"))
    search = F.array_join(F.when(read["n"] > t["results"], F.concat(read["out"], F.array(left))).otherwise(read["out"]), "\n")
    paged = tool.isin("read_url", "crawl_url", "explore_docs", "knowledge_search")
    return F.when(paged & (F.length(text) > most), page).when(tool == "web_search", search).otherwise(text)


def carried_facts(pages: DataFrame, most: int = 4000, each: int = 3) -> DataFrame:
    """WIN-13: before each page of a run, the last characters of the first facts of the pages before it.

    A scan in blocks: pages are numbered by the characters before them, `most` and a few to a block, so the last `most` before a
    page lie in its own block and the two before. What a page collects is bounded by that, however long the run.
    """
    width = most + 2  # a page's part with its line end is shorter, so no block of a run is left out
    said = F.array_join(F.transform(F.slice("facts", 1, each), lambda f: F.concat(F.lit("- "), f)), "\n")
    tail = lambda t: F.substring(t, F.greatest(F.lit(1), F.length(t) - most + 1), F.lit(most))
    size = F.when(F.length("_t") > 0, F.length("_t") + 1).otherwise(0)
    before = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cut = pages.withColumn("_t", tail(F.coalesce(said, F.lit("")))).withColumn("_b", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / width))
    joined = lambda c: F.array_join(F.filter(c, lambda t: t != ""), "\n")
    blocks = cut.groupBy("run", "_b").agg(joined(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t") != "", F.struct("seq", "_t")))), lambda x: x["_t"])).alias("_x"))
    in_turn = Window.partitionBy("run").orderBy("_b")
    carried = blocks.select("run", "_b", joined(F.array(F.coalesce(F.lag("_x", 2).over(in_turn), F.lit("")), F.coalesce(F.lag("_x", 1).over(in_turn), F.lit("")))).alias("_c"))
    own = Window.partitionBy("run", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    met = cut.withColumn("_o", joined(F.collect_list(F.when(F.col("_t") != "", F.col("_t"))).over(own))).join(carried, ["run", "_b"])
    return met.withColumn("carried", tail(joined(F.array("_c", "_o")))).select(*pages.columns, "carried")


def lifecycle(events: DataFrame) -> DataFrame:
    """STR-12: what each action does to a session's request: (session_id, seq, state, generation, ok, reason).

    events: (session_id, seq, action, argument, key). Actions: `begin` a phase (argument) of the response `key`, `mark` a
    phase, `stop`, and `finish` with `error` or anything else. From a settled state a request begins anew and counts a
    generation; a different response while one is at work counts one too and is told as an overlap, unless the one at work has
    no name yet. Actions out of turn change nothing and have a reason, but `begin` while stopping, which does.
    """

    names = ("session_id", "seq", "state", "generation", "ok", "reason")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sessions lie on end, in order, so one at a time is carried from batch to batch."""
        session, (state, response, generation) = object(), ("idle", None, 0)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for own, seq, action, argument, key in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if own != session:
                    session, (state, response, generation) = own, ("idle", None, 0)
                reason = None
                if action == "begin":
                    if argument not in PHASES:
                        reason = "invalid-phase"
                    else:
                        if state == "stopping":
                            reason = "illegal-transition"
                        elif state in SETTLED:
                            generation, response = generation + 1, key
                        elif key is not None and key != response:
                            if response is not None:
                                reason, generation = "response-overlap", generation + 1
                            response = key
                        state = argument
                elif action == "mark":
                    if argument in PHASES and state in PHASES:
                        state = argument
                    else:
                        reason = "illegal-transition"
                elif action == "stop":
                    reason = "already-stopping" if state == "stopping" else None if state in PHASES else "not-stoppable"
                    state = state if reason else "stopping"
                else:
                    reason = "not-active" if state in SETTLED else None
                    state = state if reason else "error" if argument == "error" else "done"
                for name, value in zip(names, (own, seq, state, generation, reason is None, reason), strict=True):
                    out[name].append(value)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string())
            yield pa.record_batch([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names=list(names))

    e = events.select(F.col("session_id").cast("long").alias("session_id"), F.col("seq").cast("long").alias("seq"), "action", "argument", F.col("key").cast("string").alias("key"))
    dealt = e.repartition("session_id").sortWithinPartitions("session_id", F.asc_nulls_last("seq"))
    return dealt.mapInArrow(run, "session_id long, seq long, state string, generation int, ok boolean, reason string")


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """DML-10: rows of `new` in place of those with their keys."""
    return store.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def matches(settings: dict, preset: DataFrame) -> DataFrame:
    """FLT-20: presets whose stored values all equal the settings; null ones don't count, doubles within a millionth."""
    same = F.lit(True)
    for name, value in settings.items():
        if name in preset.columns:
            equal = F.abs(F.col(name) - value) < 1e-6 if isinstance(value, float) else F.col(name) == value
            same = same & F.coalesce(equal, F.col(name).isNull())
    return preset.where(same)


def migrate_ledger(old: DataFrame) -> DataFrame:
    """DML-11: day rows of an earlier version with missing counts filled in, and each provider's experience so far and stage."""
    filled = old.fillna(0)
    run = Window.partitionBy("provider").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("xp", F.sum("total").over(run)).withColumn("stage", P.stage(F.col("xp"))).withColumn("version", F.lit(3))


def active_companion(pinned: Column, provider: Column, providers: tuple[str, ...] = ("ollama", "unsloth", "openai", "anthropic", "deepseek")) -> Column:
    """MSC-06: the pinned companion if there is one of that name, else the provider's, else the first."""
    known = lambda c: F.when(c.isin(*providers), c)
    return F.coalesce(known(pinned), known(provider), F.lit(providers[0]))


#: Tools by name, how dangerous they are, and their required parameters.
TOOLS = (
    ("web_search", "read_only", ("query",)), ("read_url", "read_only", ("url",)), ("crawl_url", "read_only", ("url",)), ("document", "potentially_unsafe", ()), ("deep_research", "read_only", ()),
    ("knowledge_search", "read_only", ("query",)), ("update_knowledge", "potentially_unsafe", ("about", "new_fact")), ("forget_knowledge", "potentially_unsafe", ("about",)), ("explore_docs", "read_only", ("url",)),
)


def tool_catalog(spark) -> DataFrame:
    """UDF-01/02: the tools as a dimension, with their JSON schemas in either dialect; tools without parameters have none."""
    t = spark.createDataFrame([(n, d, list(p)) for n, d, p in TOOLS], "name string, danger string, required array<string>")
    props = F.map_from_entries(F.transform("required", lambda p: F.struct(p, F.struct(F.lit("string").alias("type")))))
    schema = F.struct(F.lit("object").alias("type"), props.alias("properties"), F.col("required"))
    function = F.to_json(F.struct(F.lit("function").alias("type"), F.struct("name", schema.alias("parameters")).alias("function")))
    some = F.size("required") > 0
    return t.withColumn("function_schema", F.when(some, function)).withColumn("input_schema", F.when(some, F.to_json(F.struct("name", schema.alias("input_schema")))))
