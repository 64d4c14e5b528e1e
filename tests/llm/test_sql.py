"""Queries whose whole result SQL can say, against DuckDB on the tables that the driver compares on."""

import duckdb
import pytest

from paperloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf_dir, name, size):
    folder = sf_dir.replace("sf0.001", size)
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(expected, key=str)
