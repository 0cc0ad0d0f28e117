"""Results of searches, crawls and extraction jobs as rows and text: projections and small rules.

PRJ-01/02, AGG-18/24, MSC-03/05/07/08, SCA-16/22/24/57/67, TOP-10, SET-06.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import clean

#: Characters of a snippet, of a link's label, of a section of links and of a code excerpt; links in a section.
SNIPPET, LABEL, SECTION, EXCERPT, MOST_LINKS = 500, 90, 3000, 6000, 25
LINKS_MARK = "--- Links on this page"


def _end(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+$", "")


def search_result(title: Column, url: Column, content: Column, engine: Column, score: Column) -> Column:
    """PRJ-01: a search result as it is shown: a clean title or the address, a snippet, engine and score; null without an address."""
    said = clean(F.coalesce(content, F.lit("")))
    snippet = F.when(F.length(said) > SNIPPET, F.concat(_end(F.substring(said, 1, SNIPPET)), F.lit("…"))).otherwise(said)
    name = clean(F.coalesce(title, F.lit("")))
    made = F.struct(
        F.when(name != "", name).otherwise(url).alias("title"), url.alias("url"), snippet.alias("content"), F.coalesce(engine, F.lit("")).alias("engine"), F.coalesce(score.cast("double"), F.lit(0.0)).alias("score")
    )
    return F.when(F.coalesce(url, F.lit("")) != "", made)


def distinct_strings(values: Column) -> Column:
    """AGG-18: clean strings, each once, in order of their first occurrence; blank ones go."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: clean(F.coalesce(v, F.lit("")))), lambda v: v != ""))


def job_result(result: Column) -> Column:
    """MSC-03: an extraction job's JSON reply: structured if an object or a list, else a reply; nothing is a failure."""
    blank = result.isNull() | (result == "") | (result == "null")
    structured = result.rlike(r"^\s*[\[{]")
    return F.struct(
        (~blank).alias("success"), F.when(blank, "The LLM extraction returned no content.").alias("error"),
        F.when(~blank & structured, result).alias("structured"), F.when(~blank & ~structured, result).alias("reply"),
    )


def is_internal(*flags: Column) -> Column:
    """MSC-05: whether any internal mark of a message is set."""
    out = F.lit(False)
    for flag in flags:
        out = out | F.coalesce(flag, F.lit(False))
    return out


def is_model(installed: Column, name: Column) -> Column:
    """MSC-07: whether an installed model is the one asked for, with or without its tag."""
    return F.coalesce((installed == name) | installed.startswith(F.concat(name, F.lit(":"))), F.lit(False))


def links_section(links: Column, most: int = MOST_LINKS) -> Column:
    """SCA-16: an array of links (href, text, title, external) as a numbered section; '' without links."""
    own = F.slice(F.coalesce(links, F.array().cast("array<struct<href:string,text:string,title:string,external:boolean>>")), 1, most)

    def line(x: Column, i: Column) -> Column:
        filled = lambda c: F.when(x[c] != "", x[c])
        label = F.translate(F.regexp_replace(F.coalesce(filled("text"), filled("title"), filled("href"), F.lit("")), r"\s+", " "), "[]", "()")
        label = F.when(F.length(label) > LABEL, F.concat(_end(F.substring(label, 1, LABEL - 1)), F.lit("…"))).otherwise(label)
        return F.concat((i + 1).cast("string"), F.lit(". ["), label, F.lit("]("), F.coalesce(x["href"], F.lit("")), F.lit(")"), F.when(x["external"], " (external)").otherwise(""))

    head = F.concat(F.lit(f"{LINKS_MARK} ("), F.size(own).cast("string"), F.lit(") ---"))
    section = F.array_join(F.concat(F.array(head), F.transform(own, line)), "\n")
    section = F.when(F.length(section) > SECTION, F.concat(_end(F.substring(section, 1, SECTION)), F.lit("\n[...links trimmed]"))).otherwise(section)
    return F.when(F.size(own) > 0, section).otherwise("")


def split_links(text: Column) -> Column:
    """SCA-16: (head, tail) of a result at its section of links; the tail is '' where there is none."""
    t = F.coalesce(text, F.lit(""))
    at = F.locate(LINKS_MARK, t)
    return F.struct(F.when(at > 0, _end(F.substring(t, F.lit(1), at - 1))).otherwise(t).alias("head"), F.when(at > 0, F.substring(t, at, F.length(t))).otherwise("").alias("tail"))


def code_excerpt(text: Column, most: int = EXCERPT) -> Column:
    """SCA-22: headings and fenced lines of a page; of one that has none its start; cut with a note."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        fence = line.rlike(r"^\s*```")
        keep = fence | acc["inside"] | line.rlike(r"^#{1,6}\s")
        return F.struct(F.when(fence, ~acc["inside"]).otherwise(acc["inside"]).alias("inside"), F.when(keep, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"))

    own = F.regexp_replace(F.array_join(F.aggregate(lines, start, step, lambda acc: acc["kept"]), "\n"), r"^\s+|\s+$", "")
    return F.when(own == "", _end(F.substring(t, 1, most))).when(F.length(own) > most, F.concat(_end(F.substring(own, 1, most)), F.lit("\n[...raw excerpt trimmed]"))).otherwise(own)


def first_items(items: Column, most: int) -> Column:
    """TOP-10: the first items of a list, in its order."""
    return F.slice(F.coalesce(items, F.array()), 1, most)


def stage_keys(old: Column, new: Column) -> Column:
    """SET-06: stages reached so far and new ones, each once."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(old, none), F.coalesce(new, none))


def plan_snapshot(tasks: Column) -> Column:
    """PRJ-02: an array of tasks (sub_task, search_query, hypothesis, evidence_needed) as JSON, blank optional fields left out."""
    filled = lambda c: F.when(c != "", c)
    each = lambda t: F.struct(t["sub_task"].alias("sub_task"), t["search_query"].alias("search_query"), filled(t["hypothesis"]).alias("hypothesis"), filled(t["evidence_needed"]).alias("evidence_needed"))
    return F.coalesce(F.to_json(F.transform(tasks, each)), F.lit("[]"))


def usage_total(provider: Column, prompt_evals: Column, evals: Column, inputs: Column, outputs: Column, prompt: Column, completion: Column) -> Column:
    """AGG-24: tokens of a whole reply by the fields that its provider fills; missing ones count nothing."""
    both = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.when(provider == "ollama", both(prompt_evals, evals)).when(provider == "anthropic", both(inputs, outputs)).otherwise(both(prompt, completion))


def inline_text(x: Column) -> Column:
    """SCA-24: spaces, tabs and fixed spaces as one space, lines trimmed, blank lines gone; '' for null."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\r\n?", "\n"), r"[ \t\x{A0}]+", " ")
    lines = F.transform(F.split(t, "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def table_cell(x: Column) -> Column:
    """SCA-24: a cell of a Markdown table: one line, backslashes and bars escaped."""
    return F.replace(F.replace(clean(x), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def cache_key(url: Column, *config: Column) -> Column:
    """SCA-57: the SHA-256 of an address, or with extraction settings of the JSON list of it and them; null counts as blank."""
    parts = [F.trim(F.coalesce(url, F.lit(""))), *(F.coalesce(c, F.lit("")) for c in config)]
    return F.sha2(F.to_json(F.array(*parts)) if config else parts[0], 256)


def json_block():
    """SCA-67: a column function from JSON to a fenced block of it, indented by two; what is no JSON stays as it is."""

    def shown(text: str | None) -> str:
        whole = lambda s: int(float(s)) if float(s).is_integer() and abs(float(s)) < 1e21 else float(s)
        try:
            text = json.dumps(json.loads(text or "null", parse_float=whole), indent=2, ensure_ascii=False)
        except ValueError:
            pass
        return f"```json\n{text}\n```"

    @F.arrow_udf("string")
    def block(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shown(t) for t in batch.to_pylist()], pa.string())

    return block


#: Searches of one turn from which each note is given, and the notes.
SEARCH_NOTES = (
    (5, "\nYou have run {n} web searches this turn. If you are on a close trail to the information, keep using read_url/crawl_url on specific pages and following links from pages you have opened; run another search if it targets a concrete gap."),
    (3, "\nYou have already run {n} web searches this turn. Reading pages (and following links you find in them) often yields more than another search."),
    (2, "You have already run {n} web search(es) this turn. Consider reading pages with read_url before searching again."),
)
UNREAD_NOTE = "\nYou have searched {n} times without reading any pages yet. Reading at least one promising URL (with read_url or crawl_url) — and following the links it lists — often yields more than another search."
FAILED_NOTE = "\nNOTE: {n} page-reading attempts have failed this turn. These sites may block scraping — try crawl_url for JavaScript-heavy pages, different sources, or the information you already have."


def search_notes(searches: Column, reads: Column, failures: Column) -> Column:
    """MSC-08: the notes that follow a list of results, by the turn's searches, pages read and pages that failed; '' without any."""
    said = lambda note, n: F.replace(F.lit(note), F.lit("{n}"), n.cast("string"))
    many = F.lit(None).cast("string")
    for least, note in reversed(SEARCH_NOTES):
        many = F.when(searches >= least, said(note, searches)).otherwise(many)
    return F.concat_ws("\n", many, F.when((searches >= 2) & (reads == 0), said(UNREAD_NOTE, searches)), F.when(failures >= 2, said(FAILED_NOTE, failures)))
