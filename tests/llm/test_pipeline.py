from __future__ import annotations

import corpus_pipeline as pipeline


def test_pipeline(spark):
    """Stages keep the columns of documents, take only what was kept, and end in intact pieces."""
    sf_dir = "/root/testdata/sf0.01"  # the smallest folder has too few labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, seen = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir).cache()
        assert out.columns == docs.columns, name
        assert out.join(kept, "doc_id", "left_anti").count() == 0
        seen.append(out.count())
        kept = out
    assert seen[0] >= 0.98 * docs.count() and seen[1] < seen[0] and seen[2] < seen[1]
    last = pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert last.count() == seen[3] and last.where("not intact").count() == 0


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0 and pipeline.ORACLE_SQL is None
    assert [n for n, _ in pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixing", "pieces"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables: no stage fails, and columns stay."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = docs.selectExpr("doc_id", "text").where("text is not null").limit(1).selectExpr("cast(-1 as bigint) as doc_id", "repeat(text, 500) as text")
    odd = spark.createDataFrame([(-2, None), (-3, ""), (-4, "..."), (None, "the thing and the other"), (-5, "twice the same"), (-5, "twice the same")], "doc_id long, text string")
    more = odd.union(long).selectExpr("doc_id", "text", "'en' as lang", "cast(null as string) as source", "length(text) as n_chars")
    clash = {c: "mine" for c in ("_size", "row", "said", "component_id", "copies", "g")}
    for rows in (docs.unionByName(more, allowMissingColumns=True), docs.limit(0)):
        kept = rows.selectExpr("*", *[f"'{v}' as {c}" for c, v in clash.items()])
        for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
            out = stage(spark, kept, sf_dir)
            assert out.columns == kept.columns, name
            out.write.parquet(f"{tmp_path}/{rows is docs}-{k}-{id(rows)}")
            kept = spark.read.parquet(f"{tmp_path}/{rows is docs}-{k}-{id(rows)}")
            assert kept.where("_size <> 'mine'").count() == 0
            if name == "near_duplicates":
                assert kept.where("doc_id = -5").count() in (0, 2)
        last = pipeline.STAGES[-1][1](spark, kept, sf_dir)
        assert last.where("not intact").count() == 0
