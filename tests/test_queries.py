"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from plumbline import queries as reference

SQL = reference.oracle_sql()
QUERIES = reference.queries()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{f}'")
    return con


def plain(v):
    if v is None or pd.isna(v):
        return None
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows_of(frame):
    cols = sorted(frame.columns)
    return sorted([tuple(plain(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, tiny, name):
    got, want = QUERIES[name](spark, tiny).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_source_lines_with_block_comments(spark, tmp_path):
    """Documents with block comments have a row too, and lines inside comments don't count."""
    rows = [(1, "a\n/* b\nc */\nd // e\n"), (2, "/* all\nof it */"), (3, "x\ny"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sloc for r in QUERIES["a3_source_lines"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 0, 3: 2, 4: 0}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
