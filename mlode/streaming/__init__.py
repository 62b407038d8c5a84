"""M queries over streams.

Operators without a global order (SelectRows, AddColumn, TransformColumns, types,
expands, unpivot, splits, a join with a static table) run on a streaming DataFrame
as they are; positional operators refuse it. Grouping needs a window column and a
watermark, which ``windowed`` adds.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, width: str, late: str, slide: str | None = None, into: str = "window_start") -> DataFrame:
    """The stream with a watermark and the start of each row's time window (a row for each window it is in)."""
    moment = F.col(time).cast("timestamp")
    marked = stream.withColumn(time, moment).withWatermark(time, late)
    return marked.withColumn("__w", F.window(F.col(time), width, slide)).withColumn(into, F.col("__w.start"))


def run_stream(spark: SparkSession, text: str, stream: str, frame: DataFrame, bindings: dict[str, Any] | None = None) -> DataFrame:
    """The streaming DataFrame of an M query whose name `stream` is bound to a streaming DataFrame."""
    from mlode.api import run

    out = run(spark, text, {**(bindings or {}), stream: frame})
    if frame.isStreaming and not out.isStreaming:
        raise ValueError("the query doesn't read the stream")
    return out
