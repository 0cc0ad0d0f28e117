from __future__ import annotations


import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text, lang, source) and a column whose name clashes with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, "x", "y") for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, score string, _size string")

    return make


