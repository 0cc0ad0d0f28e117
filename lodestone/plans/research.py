"""Deep research as steps over tables: plan, search, select, compress, refine; models and fetchers are given as callables.

PIP-02/03/05/10, UDF-05, SNK-07. Branches run one behind the other by design; what a branch reads, ranks and cites is a plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import chunking, replies, results, text
from lodestone.functions import urls as U
from lodestone.operators import links, research
from lodestone.streaming.ledger import shared_folder

#: Characters of findings in a synthesis prompt, at most, as the reference has it.
FINDINGS_CHARS = 80_000


@dataclass
class Tools:
    """search(query) and fetch(urls) give frames (url, title, content) and (page_id, url, html); llm(prompt) gives text."""

    search: Callable[[str], DataFrame]
    fetch: Callable[[list[str]], DataFrame]
    llm: Callable[[str], str]
    spark: SparkSession
    covered: list[str] = field(default_factory=list)


def ask(tools: Tools, prompt: str, schema: str) -> list:
    """UDF-05, SCA-60: a model's reply as rows of the schema; no rows if it can't be read."""
    reply = tools.spark.createDataFrame([(tools.llm(prompt),)], "reply string")
    found = reply.select(replies.lenient_json(F.col("reply"), schema).alias("x")).first().x
    return found or []


def plan(tools: Tools, question: str, angles: int = 5) -> list:
    reply = tools.spark.createDataFrame([(tools.llm(f"Plan up to {angles} research angles as JSON for: {question}"),)], "reply string")
    return (reply.select(replies.plan(F.col("reply")).alias("p")).first().p or [])[:angles]


def crawl(tools: Tools, urls: list[str], cache: DataFrame | None = None, rounds: int = 2) -> DataFrame:
    """PIP-10/11: guarded addresses only, cached pages first, transient failures fetched again up to `rounds` times.

    A fetcher gives (page_id, url, html) and perhaps status and error of pages that failed; without those any failure is transient.
    """
    asked = tools.spark.createDataFrame([(u,) for u in urls], "url string").where(U.guard(F.col("url")).isNull())
    have = asked.join(cache, "url").select("page_id", "url", "html") if cache is not None else None
    todo = [r.url for r in (asked.join(have, "url", "left_anti") if have is not None else asked).collect()]
    got = have
    for _ in range(rounds + 1):
        if not todo:
            break
        part = tools.fetch(todo)
        read = part.where("html is not null").select("page_id", "url", "html")
        got = read if got is None else got.unionByName(read)
        known = {"status", "error"} <= set(part.columns)
        over = part.where(~replies.transient(F.col("html").isNotNull(), F.col("status"), F.col("error"))) if known else read
        done = {r.url for r in over.select("url").collect()}
        todo = [u for u in todo if u not in done]
    return got if got is not None else tools.spark.createDataFrame([], "page_id long, url string, html string")


def compress(tools: Tools, pages: DataFrame, topic: str) -> DataFrame:
    """PIP-02: code-heavy pages as their headings and fenced lines, prose as facts of a model's reply for each page: (url, claim).

    A long page goes to the model by whole sections, then sentences, up to the prompt's room; the model is asked page by
    page from the driver, for it is an outside service, and pages of one branch are few by its plan.
    """
    read = pages.select("url", text.html_to_text(F.col("html")).alias("t")).withColumn("heavy", text.code_heaviness(F.col("t"))["code_heavy"])
    asked = read.where("not heavy").select("url", chunking.chunker(lambda t: [chunking.for_prompt(t)])(F.col("t"))[0].alias("t"))
    prose = [(r.url, tools.llm(f"Facts about {topic} as JSON from:\n{r.t}")) for r in asked.collect()]
    said = tools.spark.createDataFrame(prose, "url string, reply string").select("url", F.explode(replies.facts(F.col("reply"), F.col("url"))).alias("f")).select("url", F.col("f.claim").alias("claim"))
    return said.unionByName(read.where("heavy").select("url", results.code_excerpt(F.col("t")).alias("claim")))


def branch(tools: Tools, topic: str, query: str, reads: int = 3, follows: int = 3) -> DataFrame:
    """PIP-03: search, read the best new pages, follow their best links, and compress: (url, claim)."""
    found = tools.search(query).withColumn("list", F.lit(0)).withColumn("pos", F.monotonically_increasing_id()).withColumn("score", F.lit(0.0))
    seen = tools.spark.createDataFrame([(u,) for u in tools.covered], "url string")
    best = links.best_results(links.merge(links.novel_or_all(found, seen)), 10)
    urls = [r.url for r in best.limit(reads).collect()]
    pages = crawl(tools, urls)
    tools.covered += urls
    onward = links.follow(links.scored(links.anchors(pages), topic), tools.spark.createDataFrame([(u,) for u in tools.covered], "url string"), 10)
    more = [r.href for r in onward.limit(follows).collect()]
    tools.covered += more
    return compress(tools, pages.unionByName(crawl(tools, more)) if more else pages, topic)


def run(tools: Tools, question: str, angles: int = 5) -> str:
    """The synthesis prompt of a whole run: findings by relevance, numbered sources, contradictions."""
    facts: DataFrame | None = None
    for k, step in enumerate(plan(tools, question, angles)):
        own = branch(tools, step.sub_task, step.search_query or step.sub_task).withColumn("run", F.lit(k))
        facts = own if facts is None else facts.unionByName(own)
    if facts is None:
        return f"Question: {question}\n\nNothing was found."
    numbered = facts.withColumn("seq", F.monotonically_increasing_id())
    return synthesis(numbered, question)


def synthesis(facts: DataFrame, question: str, budget: int = FINDINGS_CHARS) -> str:
    """PIP-05: the prompt from facts (seq, claim, url and perhaps run): claims with citation marks in sandwich order, conflicts, sources.

    All claims are in it while they fit the budget. Beyond it each run keeps its most relevant ones within its share
    (WIN-14/15; there are no summaries, so facts have all of it), and a line says how many others there are.
    """
    folder = shared_folder(facts.sparkSession)
    (facts if "run" in facts.columns else facts.withColumn("run", F.lit(0))).write.parquet(folder)  # read several times, numbered once
    facts = facts.sparkSession.read.parquet(folder)
    cited = research.citations(facts)
    words = text.keywords(F.lit(question))
    scored = cited.join(facts.select("seq", "run"), "seq").select(F.col("seq").alias("id"), F.col("run").alias("branch"), "claim", "number", text.occurrences(F.lower("claim"), words).alias("score"))
    ranked = scored.withColumn("seq", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("score"), "id")))
    branches = ranked.groupBy("branch").agg(F.array_join(F.collect_list("claim"), "").alias("findings"), F.count("*").alias("n_facts"))
    kept = research.kept_facts(ranked.join(research.scaled_budgets(branches, budget).select("branch", "chars"), "branch"), share=1.0)
    lines = [f"- {r.claim} [{r.number}]" for r in research.sandwich(kept).orderBy("position").collect()]
    more = ranked.count() - len(lines)
    lines += [f"- [+{more} more facts available]"] if more else []
    conflicts = [f"- {r.a:g} against {r.b:g}" for r in research.contradiction_pairs(facts).orderBy("i", "j").limit(5).collect()]
    sources = research.bibliography(cited).first().bibliography or ""
    return "\n\n".join(filter(None, [f"Question: {question}", "Findings:\n" + "\n".join(lines), "Conflicts:\n" + "\n".join(conflicts) if conflicts else "", "Sources:\n" + sources]))
