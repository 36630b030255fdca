"""Reading tables and binary assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A table of fewer rows, in files of fewer bytes, is not worth moving.
FEW_ROWS, FEW_BYTES = 1_000, 1 << 20
#: Parts of so many rows at least, where there are more parts than tasks.
PART_ROWS = 250


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table of files dealt over all tasks, unless they lie so: reordering and transcoding cost far more than moving a text.

    Files are split by their bytes, but a row group goes whole to one of the splits and the others stay empty, so
    the number of splits says nothing: the rows in each are counted, which reads only the files' ends. Large
    tables go to four parts for each task, so that one of long texts does not hold up the others.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("size"))
    at = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("most"), F.count("*").alias("parts"), F.max("size").alias("size")).first()
    if at["n"] < FEW_ROWS and (at["size"] or 0) < FEW_BYTES or at["parts"] >= tasks and at["most"] * tasks <= 2 * at["n"]:
        return df
    return df.repartition(tasks * max(1, min(4, at["n"] // (PART_ROWS * tasks))))


def load_assets(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content binary) of files such as images and fonts."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def font_tables(assets: DataFrame) -> DataFrame:
    """(path, n_tables, tables) of TrueType fonts: the four-letter names in their table directories, others left out."""
    head = F.col("content").substr(1, 12)
    kind = F.hex(F.substring("content", 1, 4)).isin("00010000", "4F54544F")
    n = F.conv(F.hex(F.substring(head, 5, 2)), 16, 10).cast("int")
    fonts = assets.where(kind).withColumn("n_tables", n)
    names = F.expr("transform(sequence(0, n_tables - 1), i -> decode(substring(content, 13 + 16 * i, 4), 'UTF-8'))")
    return fonts.select("path", "n_tables", F.when(n > 0, names).otherwise(F.array().cast("array<string>")).alias("tables"))
