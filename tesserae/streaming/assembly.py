"""Streaming assembly: updates of matrix blocks summed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.schema import PLACE, value


def assemble_stream(updates: DataFrame, event_time: str | None = None, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Sums v (and w) and counts n of updates by place, by window with a watermark if they have a time.

    The place is (bi, bj, r, c), as far as the updates have these columns; works on batches too.
    """
    keys = [c for c in PLACE if c in updates.columns]
    sums = [*value(updates).sums(), F.count(F.lit(1)).alias("n")]
    names = [c for c in ("v", "w", "n") if c in (*updates.columns, "n")]
    if event_time is None:
        return updates.groupBy(*keys).agg(*sums)
    timed = updates.withWatermark(event_time, late) if updates.isStreaming else updates
    return timed.groupBy(F.window(event_time, window).alias("span"), *keys).agg(*sums).select(F.col("span.start").alias("start"), *keys, *names)
