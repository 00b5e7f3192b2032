"""Event-time windows that read the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], measures: list[Column], *, late: str | None = None) -> DataFrame:
    """Measures by window and keys; ``late`` sets the watermark after which a stream drops rows and closes windows."""
    src = df.withWatermark(time, late) if late else df
    g = src.groupBy(F.window(time, width).alias("w"), *keys).agg(*measures)
    return g.select(F.col("w.start").alias("window_start"), *[c for c in g.columns if c != "w"])
