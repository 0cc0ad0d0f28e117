"""Links of pages: extraction, filters, ranking, merging of result lists.

TAB-01/09/16/17, TOP-05/06/11, AGG-16, JN-06/07, SET-01/04/05, PIP-07, SNK-06. Pages are (page_id, url, html).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import urls as U

MOST_LINKS = 25
_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a>"""


def anchors(pages: DataFrame, most: int | None = None) -> DataFrame:
    """TAB-01: (page_id, url, pos, href, text, external) of the http(s) links of a page, in order.

    With `most`, reading stops after twice as many links that are neither navigation nor assets, as `normalized` wants them.
    """
    group = lambda k: F.regexp_extract_all("html", F.lit(_ANCHOR), k)
    zipped = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"), group(4).alias("t"))
    flat = pages.select("page_id", "url", F.posexplode(zipped).alias("pos", "m"))
    raw = F.coalesce(*[F.nullif(F.col(f"m.{c}"), F.lit("")) for c in "abc"])
    out = flat.select("page_id", "url", "pos", U.resolve(raw, F.col("url")).alias("href"), T.clean(T.decoded(F.regexp_replace("m.t", r"(?s)<[^>]+>", " "))).alias("text"))
    out = out.where("href <> ''").withColumn("external", U.is_external(F.col("href"), F.col("url")))
    if most is None:
        return out
    found = out.where(~F.col("href").rlike(U.NOISE) & ~F.col("href").rlike(U.ASSET))
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("_r") <= 2 * most).drop("_r")


def crawled(results: DataFrame, external: bool = False) -> DataFrame:
    """TAB-16: (page_id, url, pos, href, text, title, external) of the links that a crawl's result lists, internal ones first.

    results: (page_id, url, internal, external), arrays of structs with href, text and title; links without an address go.
    """
    own = F.transform(F.coalesce("internal", F.array()), lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"), x["title"].alias("title"), F.lit(False).alias("external")))
    if external:
        own = F.concat(own, F.transform(F.coalesce("external", F.array()), lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"), x["title"].alias("title"), F.lit(True).alias("external"))))
    flat = results.select("page_id", "url", F.posexplode(own).alias("pos", "m"))
    trimmed = lambda c: F.trim(F.coalesce(F.col(f"m.{c}"), F.lit("")))
    return flat.select("page_id", "url", "pos", trimmed("href").alias("href"), trimmed("text").alias("text"), trimmed("title").alias("title"), F.col("m.external").alias("external")).where("href <> ''")


def normalized(links: DataFrame, most: int, pdfs: bool = True) -> DataFrame:
    """TAB-17, SET-05: without navigation, assets (and PDFs), the first of each key, the first `most` of each page."""
    ok = ~F.col("href").rlike(U.NOISE) & ~F.col("href").rlike(U.ASSET)
    if not pdfs:
        ok = ok & ~F.col("href").rlike(U.PDF)
    first = Window.partitionBy("page_id", "_k").orderBy("pos")
    kept = links.where(ok).withColumn("_k", U.link_key(F.col("href"))).withColumn("_f", F.row_number().over(first)).where("_f = 1")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).drop("_k", "_f")


def scored(links: DataFrame, query: str) -> DataFrame:
    """SCA-09, TOP-06: occurrences of the query's keywords in text and address; without keywords every score is 0."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.lit(""), F.coalesce("href", F.lit(""))))
    return links.withColumn("score", T.occurrences(hay, T.keywords(F.lit(query))))


def follow(links: DataFrame, covered: DataFrame, most: int = 10) -> DataFrame:
    """JN-07, TOP-06: links with a score that are not covered, best first, then internal, the first of each key."""
    key = U.branch_key(F.col("href"))
    new = links.where("score > 0").withColumn("_k", key).join(covered.select(U.branch_key(F.col("url")).alias("_k")).distinct(), "_k", "left_anti")
    first = Window.partitionBy("_k").orderBy(F.desc("score"), F.col("external").cast("int"), "href", "page_id", "pos")
    kept = new.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return kept.orderBy(F.desc("score"), F.col("external").cast("int"), "href").limit(most).drop("_k", "_r")


def novel_or_all(results: DataFrame, covered: DataFrame) -> DataFrame:
    """JN-06, SET-04: results whose url is not covered; where none is new, all of them."""
    seen = covered.select(U.branch_key(F.col("url")).alias("_k")).distinct().withColumn("_seen", F.lit(True))
    met = results.withColumn("_k", U.branch_key(F.col("url"))).join(seen, "_k", "left").withColumn("_new", F.col("_seen").isNull())
    some = met.agg(F.max(F.col("_new").cast("int")).alias("_any"))
    return met.crossJoin(F.broadcast(some)).where(F.col("_new") | (F.col("_any") == 0)).drop("_k", "_seen", "_new", "_any")


def merge(results: DataFrame) -> DataFrame:
    """AGG-16, TOP-05: results (list, pos, url, title, score) by key: how often found, in which lists, the first one's values."""
    at = F.struct("list", "pos")
    by = results.withColumn("key", U.search_key(F.col("url"))).groupBy("key").agg(
        F.count("*").alias("count"), F.array_sort(F.collect_set("list")).alias("matched_by"), F.min_by("url", at).alias("url"), F.min_by("title", at).alias("title"), F.min_by("score", at).alias("score"), F.min(at).alias("first"),
    )
    return by.select("key", "count", F.array_join(F.transform("matched_by", lambda x: x.cast("string")), ",").alias("matched_by"), "url", "title", "score", "first")


def best_results(merged: DataFrame, limit: int = 5) -> DataFrame:
    return merged.orderBy(F.desc("count"), F.desc("score"), "first").limit(max(1, min(30, limit))).drop("first")


def table_of_contents(links: DataFrame, query: str, most: int = 50, suggestions: int = 5) -> DataFrame:
    """PIP-07, TOP-11: a page's internal links without PDFs, and which of them the query suggests."""
    own = scored(normalized(links.where("not external"), most, pdfs=False), query)
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "href")
    return own.withColumn("suggested", (F.col("score") > 0) & (F.row_number().over(order) <= suggestions))


def plain_links(text: Column) -> Column:
    """TAB-09: addresses in Markdown and plain text, first occurrences, without trailing punctuation."""
    marked = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\((https?://[^\s)]+)\)"), 1)
    bare = F.regexp_extract_all(F.regexp_replace(text, r"\[[^\]]*\]\([^)]*\)", " "), F.lit(r"https?://[^\s<>\"')\]]+"), 0)
    return F.array_distinct(F.filter(F.transform(F.concat(marked, bare), U.render_url), lambda x: x.isNotNull()))


def markdown_table(rows: Column) -> Column:
    """SNK-06: rows of cells as a Markdown table: the first row heads it, empty rows and trailing empty columns go."""
    safe = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))))
    full = F.filter(safe, lambda r: F.exists(r, lambda c: c != ""))
    used = lambda r: F.coalesce(F.array_max(F.transform(r, lambda c, i: F.when(c != "", i + 1).otherwise(0))), F.lit(0))
    wide = F.coalesce(F.array_max(F.transform(full, used)), F.lit(0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), wide), lambda i: F.coalesce(F.try_element_at(r, i.cast("int")), F.lit(""))), " | "), F.lit(" |"))
    lines = F.transform(full, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide.cast("int")), " | "), F.lit(" |"))
    return F.when(F.size(full) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))), "\n"))
