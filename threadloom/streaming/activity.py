"""Author activity as a stream: counts per author in event-time windows. An extra; batch operators cover the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", author: str = "author", ts: str = "ts") -> DataFrame:
    """(start, author, count) per tumbling window; events later than `late` behind the newest one are dropped, and a
    window is final, in append mode, once it is that far behind. Works on streams and tables alike."""
    counted = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), author).agg(F.count("*").alias("count"))
    return counted.select(F.col("w.start").alias("start"), author, "count")
