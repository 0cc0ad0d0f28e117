"""Rules whose expected values are worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import results as R
from lodestone.functions import text as T
from lodestone.operators import links, retrieval, usage


def test_entities(spark):
    said = ["It&#39;s &#x2014; ok", "&#38;lt;b&gt;", "&amp;#39;", "&#x110000;a&#55296;b&#99999999999999999999;c", "&unknown; &nbsp;&#x1F600;", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(T.decoded(F.col("t"))).collect()] == ["It's — ok", "<b>", "&#39;", "abc", "&unknown;  😀", None]
    assert rows.limit(1).select(T.html_to_text(F.concat(F.lit("<p>"), "t", F.lit("</p>")))).first()[0] == "It's — ok"


def test_anchors_decode_and_count_what_they_find(spark):
    html = "".join(f'<a href="javascript:{i}">no</a><a href="/i{i}.png">img</a>' for i in range(9)) + '<a href="/x">Caf&#233; &amp; <b>bar</b></a><a href="/y">Y</a>'
    pages = spark.createDataFrame([(1, "https://a.org/p", html)], "page_id long, url string, html string")
    got = [(r.href, r.text) for r in links.anchors(pages, most=1).orderBy("pos").collect()]
    assert got == [("https://a.org/x", "Café & bar"), ("https://a.org/y", "Y")]


def test_dedup_window_remembers_what_was_sent(spark):
    """0, 5, 10, 18 s: 5 goes, 10 is eight and more after 0, 18 is exactly eight after 10; other keys and missing times stand alone."""
    rows = [(1, "q", 0), (2, "q", 5), (3, "q", 10), (4, "q", 18), (5, "r", 6), (6, None, 0), (7, None, 3), (8, "q", None), (9, "q", 18)]
    e = spark.createDataFrame(rows, "event_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.event_id for r in usage.dedup_window(e, "key", "ts").collect()) == [1, 3, 4, 5, 6, 8]
    assert usage.dedup_window(e.limit(0), "key", "ts").count() == 0 and usage.dedup_window(e, "key", "ts").columns == e.columns


def test_dedup_events_break_ties(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "event_id long, v string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    assert len({usage.dedup_events(e.repartition(n)).first().v for n in (1, 2, 3)}) == 1


def test_results(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    r = one(R.search_result(F.lit(" A \n b "), F.lit("u"), F.lit("w " * 400), F.lit(None).cast("string"), F.lit(2)))
    assert (r.title, r.engine, r.score) == ("A b", "", 2.0) and r.content == ("w " * 250).strip() + "…"
    assert one(R.search_result(F.lit("t"), F.lit(""), F.lit("c"), F.lit("e"), F.lit(1))) is None
    assert one(R.distinct_strings(F.array(*map(F.lit, [" b", "a  c", "b ", "", "a c"])))) == ["b", "a c"]
    assert [tuple(one(R.job_result(F.lit(x).cast("string")))) for x in (None, ' {"a": 1}', "words")] == [(False, "The LLM extraction returned no content.", None, None), (True, None, ' {"a": 1}', None), (True, None, None, "words")]
    assert one(R.is_internal(F.lit(None).cast("boolean"), F.lit(True))) and not one(R.is_internal(F.lit(False)))
    assert one(R.is_model(F.lit("m:7b"), F.lit("m"))) and one(R.is_model(F.lit("m"), F.lit("m"))) and not one(R.is_model(F.lit("mx"), F.lit("m")))
    assert one(R.stage_keys(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == ["a", "b", "c"] and one(R.first_items(F.array(*map(F.lit, range(9))), 5)) == [0, 1, 2, 3, 4]
    many = F.array(*(F.struct(F.lit(f"/{i}").alias("href"), F.lit("[x]").alias("text"), F.lit("").alias("title"), F.lit(i == 0).alias("external")) for i in range(30)))
    section = one(R.links_section(many))
    assert section.startswith("--- Links on this page (25) ---\n1. [(x)](/0) (external)\n2. [(x)](/1)\n") and section.endswith("25. [(x)](/24)")
    assert tuple(one(R.split_links(F.lit("body \n\n" + section)))) == ("body", section) and tuple(one(R.split_links(F.lit("body")))) == ("body", "")
    assert one(R.code_excerpt(F.lit("a\n# H\nb\n```\nc\n```\nd"))) == "# H\n```\nc\n```" and one(R.code_excerpt(F.lit("x" * 7000))) == "x" * 6000


def test_crawled_links(spark):
    kind = "array<struct<href:string,text:string,title:string>>"
    rows = spark.createDataFrame([(1, "u", [(" /a ", " A", None), ("", "x", None)], [("https://b.org", "B", "t")]), (2, "u", None, None)], f"page_id long, url string, internal {kind}, external {kind}")
    assert [(r.href, r.text, r.title, r.external) for r in links.crawled(rows, external=True).orderBy("pos").collect()] == [("/a", "A", "", False), ("https://b.org", "B", "t", True)]
    assert links.crawled(rows).count() == 1


def test_hybrid_reranks(spark):
    docs = spark.createDataFrame([("c", i, f"solar word{i} " * (i + 1), [1.0, float(i)]) for i in range(6)], "collection string, id long, content string, embedding array<float>")
    vector = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    plain = [r.id for r in retrieval.hybrid(docs, "solar", vector, 3).collect()]
    again = retrieval.hybrid(docs, "solar", vector, 3, score=lambda texts: [len(t) / 1000 for t in texts], rerank_k=6).collect()
    assert len(plain) == 3 and [r.id for r in again] == [5, 4, 3] and all(r.score == round(r.score, 4) for r in again)
    assert [r.id for r in retrieval.hybrid(docs, "solar", vector, 3, score=lambda texts: None, rerank_k=6).collect()][0] == 0
    assert retrieval.bm25_scores(docs, "!!").count() == 0
