from __future__ import annotations

from lodestone.plans import catalog


def test_sql_names(spark):
    assert set(catalog.register(spark)) == set(catalog.register(spark))
    row = spark.sql("SELECT chunk_text('a b') AS c, decode_entities('&#233;') AS e, size(tool_calls('{\"name\": \"f\", \"args\": {}}')) AS n, markdown_segments('---')[0].kind AS k").first()
    assert (row.c, row.e, row.n, row.k) == (["a b"], "é", 1, "rule")
    text = "word " * 60
    got = spark.sql(f"SELECT * FROM text_chunks('{text}', 100, 10)").collect()
    assert len(got) > 2 and [r.chunk_index for r in got] == list(range(len(got)))
