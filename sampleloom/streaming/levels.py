"""Peak and RMS per block of time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_levels(rows: DataFrame, window: str = "1 second", by: list[str] | None = None) -> DataFrame:
    """rows(track_id, ts, value) -> track_id, block_start, peak, rms over tumbling windows."""
    keys = by or ["track_id"]
    agg = rows.groupBy(*keys, F.window("ts", window).alias("w")).agg(F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return agg.select(*keys, F.col("w.start").alias("block_start"), "peak", "rms")


def stream_levels(rows_stream: DataFrame, window: str = "1 second", delay: str = "1 second", by: list[str] | None = None) -> DataFrame:
    """The same on a stream: a block comes out once no row of it can still come (append mode)."""
    return block_levels(rows_stream.withWatermark("ts", delay), window, by)
