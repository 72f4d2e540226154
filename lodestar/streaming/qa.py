"""Rolling quality metrics of an event stream, with late events dropped after the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rolling_metrics(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Count, missing values and mean by window and kind; works on batches and streams alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, window).alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), kind, "n", "n_missing", "mean")
