"""Every query against DuckDB running its SQL on the same tables."""

import builtins
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lekha.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, duck, name):
    got, want = QUERIES[name](spark, folder).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    whole = lambda v: "None" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)  # noqa: E731  a column of integers with nulls comes as floats
    a, b = (sorted(tuple(map(whole, r)) for r in x[columns].itertuples(index=False)) for x in (got, want))
    assert a == b


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_assets_are_the_tables(spark, folder):
    got = {r.name: (r.length, r.kind) for r in QUERIES["asset_bytes"](spark, folder).collect()}
    assert got == {f.name: (f.stat().st_size, "50415231") for f in Path(folder).glob("*.parquet")}


def test_entry_without_optional_parts(monkeypatch):
    """A part whose modules cannot be imported is left out; the rest stays."""
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.startswith(("lekha.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for m in [m for m in sys.modules if m.startswith(("lekha.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", refuse)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
