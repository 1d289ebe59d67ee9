"""MIDI event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def midi_to_blocks(midi: DataFrame, duration_s: float | Column, rate: float, block: int = 8192) -> DataFrame:
    """track_id, block, events (offset in the block and message, in order); events at or past the end are in no block."""
    if not isinstance(duration_s, Column):
        if duration_s > rate:
            raise ValueError("duration_s is greater than the sample rate; were they swapped?")
        duration_s = F.lit(float(duration_s))
    frame = F.floor(F.col("time_s") * float(rate))
    at = midi.withColumn("frame", frame).filter((F.col("frame") >= 0) & (F.col("frame") < F.floor(duration_s * float(rate))))
    rows = at.select("track_id", F.floor(F.col("frame") / block).alias("block"), (F.col("frame") % block).cast("int").alias("offset"), "message")
    return rows.groupBy("track_id", "block").agg(F.array_sort(F.collect_list(F.struct("offset", "message"))).alias("events"))


def midi_delta_suspects(midi: DataFrame) -> DataFrame:
    """Tracks whose times look like deltas: over 100 events, more than one time, and one time of over 100 events."""
    by_time = midi.groupBy("track_id", "time_s").agg(F.count(F.lit(1)).alias("n"))
    per_track = by_time.groupBy("track_id").agg(F.sum("n").alias("num_events"), F.count(F.lit(1)).alias("num_times"), F.max("n").alias("most_at_once"))
    return per_track.filter("num_events > 100 and num_times > 1 and most_at_once > 100")


def midi_normalise(df: DataFrame, status: str = "status", data1: str = "data1", data2: str = "data2") -> DataFrame:
    """Three byte columns to message BINARY; a byte out of range is an error. A df with a binary message stays as it is."""
    if "message" in df.columns:
        if dict(df.dtypes)["message"] != "binary":
            raise TypeError("a MIDI message has to be binary, or three byte columns")
        return df
    ok = lambda c: F.when(F.col(c).between(0, 255), F.lpad(F.hex(F.col(c).cast("long")), 2, "0")).otherwise(F.raise_error(F.lit(f"{c} is not a byte")))
    return df.withColumn("message", F.unhex(F.concat(ok(status), ok(data1), ok(data2)))).drop(status, data1, data2)
