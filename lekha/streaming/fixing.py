"""The same functions on streams: every operation looks at one row, so no state, watermark or window is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lekha.functions.spans import spans
from lekha.operators.tables import fix_columns


def fixed_stream(stream: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A stream with its string columns fixed, or those named."""
    return fix_columns(stream, columns)


def span_stream(stream: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, span_ord, is_bangla, raw, text) of each row's runs."""
    rows = stream.select(F.col(id_col), F.posexplode(spans(F.col(text_col))).alias("span_ord", "x"))
    return rows.select(id_col, "span_ord", "x.is_bangla", "x.raw", "x.text")


def write_fixed(stream: DataFrame, path: str, checkpoint: str, columns: list[str] | None = None) -> StreamingQuery:
    """Append the fixed rows to a Parquet folder, exactly once, until all that is there now is read."""
    out = fixed_stream(stream, columns).writeStream.format("parquet").outputMode("append")
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
