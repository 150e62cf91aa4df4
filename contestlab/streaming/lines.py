"""Line points over a stream of price ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_line_points(ticks: DataFrame, keys: list[str], ts: str = "ts", price: str = "odds", late: str = "1 hour", window: str | None = None) -> DataFrame:
    """Running first and last price per key (and event-time window) of a tick stream.

    The state is one struct pair per key; the watermark lets closed windows go. Works
    unchanged on a batch DataFrame.
    """
    src = ticks.withWatermark(ts, late) if ticks.isStreaming else ticks
    t = F.struct(F.col(ts).alias("ts"), F.col(price).alias("price"))
    by = [*[F.col(k) for k in keys], *([F.window(ts, window).alias("w")] if window else [])]
    out = src.groupBy(*by).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("ticks"))
    tail = [F.col("w.start").alias("window_start")] if window else []
    return out.select(*keys, *tail, F.col("first.price").alias("opening"), F.col("last.price").alias("closing"), "ticks")
