"""Every query that has SQL gives the same rows as DuckDB on the smallest data folder."""

from __future__ import annotations

import os

import duckdb
import pytest

from lodestone.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, tmp_path, name):
    QUERIES[name](spark, sf_dir).write.parquet(str(tmp_path / "got"))
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    if name not in SQL:
        return
    duck.execute(f"CREATE OR REPLACE TABLE want AS {SQL[name]}")
    columns = lambda t: [r[0] for r in duck.execute(f"SELECT column_name FROM information_schema.columns WHERE table_name = '{t}' ORDER BY 1").fetchall()]
    assert columns("got") == columns("want")
    c = ", ".join(f'"{x}"' for x in columns("got"))
    for a, b in (("got", "want"), ("want", "got")):
        extra = duck.execute(f"SELECT {c} FROM {a} EXCEPT ALL SELECT {c} FROM {b} LIMIT 3").fetchall()
        assert not extra, (a, extra)


def test_entry_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(__spark_entry__.__file__)
