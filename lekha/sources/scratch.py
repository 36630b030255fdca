"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or, where that is unset (as in tests), under the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/lekha-{uuid.uuid4().hex}"
