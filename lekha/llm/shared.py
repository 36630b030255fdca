"""Where intermediate results go, so that a lost executor does not cost them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch, unless the session sets another number than Spark's own: texts may be long.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Have the session send rows to Python in smaller batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, BATCH_ROWS)


_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or, where that is unset (as in tests), under the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    _made.append(f"{top.rstrip('/')}/lekha-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str = "step", codec: str = "zstd") -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many folders have been made here so far."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the folders made here after the first `since`, but for the last `keep`; to be called when the results that read them are done with."""
    jvm = spark.sparkContext._jvm
    end = len(_made) - keep
    for path in map(jvm.org.apache.hadoop.fs.Path, _made[since:end]):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since:end]
