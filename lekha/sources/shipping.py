"""Getting this package to executors that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]


def ship_package(spark: SparkSession) -> None:
    """Send the package along with the job, once for each context, unless executors find it by PYTHONPATH."""
    context = spark.sparkContext
    if getattr(context, "_lekha_shipped", False):
        return
    context._lekha_shipped = True
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp()) / "lekha.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((_ROOT / "lekha").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(str(archive))
