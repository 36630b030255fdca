"""Fixing the cells of tables, nested or wide."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.functions.bangla import fix


def fix_table(table: Column) -> Column:
    """array<array<string>> with every cell fixed; rows of any length, empty rows and null cells stay as they are."""
    return F.transform(table, lambda row: F.transform(row, lambda cell: fix(cell)))


def fix_columns(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The frame with its string columns fixed, or those named."""
    own = set(columns) if columns is not None else {n for n, t in df.dtypes if t == "string"}
    if unknown := own - set(df.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.select(*[fix(F.col(f"`{c}`")).alias(c) if c in own else F.col(f"`{c}`") for c in df.columns])
