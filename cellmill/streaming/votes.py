"""An extension: vote counts kept up to date over a stream.

The batch engine has no streams; this serves tables that grow while they are
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_votes(events: DataFrame, time: str, label: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, label, n and score of each window; rows later than ``late``
    behind the newest are dropped, which bounds the state.  Works on a stream
    and on a table."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.where(F.col(label).isNotNull()).groupBy(F.window(time, window).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum("value").alias("score"))
    return out.select(F.col("w.start").alias("window_start"), "label", "n", "score")
