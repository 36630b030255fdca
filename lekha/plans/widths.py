"""Widths of table columns by kind, resolved over all rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed: so much; fraction: a part of the table's width; intrinsic: what the longest cell needs; flex: a share of what the others leave.
KINDS = ("fixed", "fraction", "intrinsic", "flex")
WIDTH = "struct<kind:string,value:double>"


def width(kind: str, value: float | Column | None = None) -> Column:
    if kind not in KINDS:
        raise ValueError(f"no such kind of width: {kind}")
    return F.struct(F.lit(kind).alias("kind"), (value if isinstance(value, Column) else F.lit(value)).cast("double").alias("value")).cast(WIDTH)


def column_widths(df: DataFrame, block_id: Column, data: Column, widths: Column, table_width: float, char_width: float = 7.0, padding: float = 12.0) -> DataFrame:
    """(block_id, col_ord, kind, n_cells, natural, width) of each column of each table, one row a column.

    data: array<array<string>>, rows of any length; widths: map<int, WIDTH>, columns that it lacks and unknown
    kinds are intrinsic. An intrinsic column needs char_width for each character of its longest cell and the
    padding, a null cell has no characters. If columns that are not flexible need more than the table's
    width, all of them shrink in proportion; flexible ones share what is left, nothing if there is none. A flex
    or fraction without a value counts as 0. A table without cells has no columns. The table's columns
    are summed by cell counts and longest cells, so rows are aggregated before anything moves.
    """
    rows = df.select(block_id.alias("block_id"), F.explode(data).alias("cells"), widths.alias("widths"))
    cells = rows.select("block_id", F.posexplode("cells").alias("col_ord", "cell"), "widths").select("block_id", "col_ord", F.coalesce(F.length("cell"), F.lit(0)).alias("n"), F.try_element_at("widths", F.col("col_ord")).alias("w"))
    out = cells.groupBy("block_id", "col_ord").agg(F.count("*").alias("n_cells"), F.max("n").alias("n"), F.first("w").alias("w"))
    kind, value = F.col("w.kind"), F.coalesce(F.col("w.value"), F.lit(0.0))
    kind = F.when(kind.isin(*KINDS), kind).otherwise(F.lit("intrinsic"))
    natural = F.when(kind == "fixed", value).when(kind == "fraction", value * table_width).when(kind == "flex", F.lit(0.0)).otherwise(F.col("n") * char_width + padding)
    out = out.select("block_id", "col_ord", kind.alias("kind"), "n_cells", natural.alias("natural"), F.when(kind == "flex", value).otherwise(F.lit(0.0)).alias("flex"))
    table = Window.partitionBy("block_id")
    out = out.withColumn("needed", F.sum("natural").over(table)).withColumn("shares", F.sum("flex").over(table))
    stiff = F.when(F.col("needed") > table_width, F.col("natural") * table_width / F.col("needed")).otherwise(F.col("natural"))
    left = F.greatest(F.lit(0.0), F.lit(table_width) - F.col("needed"))
    resolved = F.when(F.col("kind") != "flex", stiff).when(F.col("shares") > 0, left * F.col("flex") / F.col("shares")).otherwise(F.lit(0.0))
    return out.select("block_id", "col_ord", "kind", "n_cells", "natural", resolved.alias("width"))
