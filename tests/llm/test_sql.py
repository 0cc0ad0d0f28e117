"""Corpus queries that SQL can express give its rows."""

from __future__ import annotations

import pytest

from lodestone.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, sf_dir, tmp_path, name):
    queries()[name](spark, sf_dir).write.parquet(str(tmp_path / "got"))
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    duck.execute(f"CREATE OR REPLACE TABLE want AS {oracle_sql()[name]}")
    columns = lambda t: [r[0] for r in duck.execute(f"SELECT column_name FROM information_schema.columns WHERE table_name = '{t}' ORDER BY 1").fetchall()]
    assert columns("got") == columns("want")
    c = ", ".join(columns("got"))
    for a, b in (("got", "want"), ("want", "got")):
        assert not duck.execute(f"SELECT {c} FROM {a} EXCEPT ALL SELECT {c} FROM {b} LIMIT 3").fetchall()
