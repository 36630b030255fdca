"""Numbered queries against DuckDB running their SQL on the same tables."""

import duckdb
import pandas as pd
import pytest

from lekha.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got, want = QUERIES[name](spark, folder).toPandas(), c.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    whole = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v  # noqa: E731  a column of integers with nulls comes as floats
    a, b = (sorted((tuple(map(whole, r)) for r in x[columns].itertuples(index=False)), key=repr) for x in (got, want))
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_a_row_for_each_input_row(spark, folder, name):
    table = "pages" if name.startswith("op5_") else "documents"
    assert QUERIES[name](spark, folder).count() == spark.read.parquet(f"{folder}/{table}.parquet").count()
